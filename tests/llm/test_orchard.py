"""Codes against all distances, the codebooks of both rounds, and odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from against_sql import both
from conftest import TESTDATA
from modgauge.llm import orchard


@pytest.mark.parametrize("seed,spread", [(1, 400), (2, 3), (3, 1)])
def test_search_finds_the_nearest_and_breaks_ties(seed, spread):
    """With few different numbers most distances are ties."""
    rng = np.random.default_rng(seed)
    books = rng.integers(-spread, spread + 1, (4, 40, 3))
    vectors = rng.integers(-spread, spread + 1, (500, 12))
    own = orchard.Orchard(books)
    code, distance = own.nearest(vectors)
    points = vectors.reshape(500, 4, 3)
    gaps = ((points[:, :, None] - books[None]) ** 2).sum(axis=3)
    assert np.array_equal(code, gaps.argmin(axis=2))  # argmin takes the first of equals
    assert np.array_equal(distance, gaps.min(axis=2))


def test_search_measures_few_entries():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (64, 4))
    books = centres[None]
    vectors = (centres[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4)))
    own = orchard.Orchard(books)
    own.nearest(vectors)
    assert own.measured < 0.35 * 64 * 2000, own.measured


def plain(rows, entries=64, rounds=2):
    """(id, code, error) of (id, vector) rows, and the digest, by all distances."""
    numbers = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    numbers = numbers.reshape(len(rows), orchard.PARTS, -1)
    starts, seen = [], set()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    for i in order:
        if rows[i][0] not in seen and len(starts) < entries:
            seen.add(rows[i][0])
            starts.append(numbers[i])
    books = np.array(starts)
    for _ in range(rounds + 1):
        gaps = ((numbers[:, None] - books[None]) ** 2).sum(axis=3)
        code, before = gaps.argmin(axis=1), books.copy()
        for p in range(orchard.PARTS):
            for e in range(len(books)):
                mine = numbers[code[:, p] == e, p]
                if len(mine):
                    books[e, p] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    text = ",".join(map(str, before.transpose(1, 0, 2).ravel().tolist()))
    error = gaps.min(axis=1).sum(axis=1)
    codes = ["".join(f"{c:02x}" for c in row) for row in code]
    return [(i, c, int(e)) for (i, _), c, e in zip(rows, codes, error, strict=True)], hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_its_sql(spark):
    got, expected = both(spark, "op11_orchard", f"{TESTDATA}/sf0.001")
    assert got == expected and got


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    nan, inf = float("nan"), float("inf")

    def vector():
        return [float(x) for x in rng.normal(size=16).astype(np.float32)]

    good = [(i, vector()) for i in range(30)]
    good += [(3, vector()), (3, vector()), (None, vector()), (None, vector()), (40, [0.0] * 16), (41, good[0][1])]
    labels = [None if i % 3 == 0 else i % 2 for i in range(len(good))]
    bad = [(50, None), (51, [None] + [1.0] * 15), (52, [nan] * 16), (53, [inf] * 16), (54, [1.0] * 32), (55, []),
           (56, [1.0] * 15), (57, [1e30] * 16)]
    rows = [(i, v, label, "x", "y") for (i, v), label in zip(good, labels, strict=True)]
    rows += [(i, v, 1, "x", "y") for i, v in bad]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string, error string")
    got = orchard.compress(table, F.col("label")).collect()
    expected, digest = plain(good)
    assert sorted(map(str, ((r.vec_id, r.code, r.error) for r in got))) == sorted(map(str, expected))
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for label, (_, _, error) in zip(labels, expected, strict=True):
        sums[label] = sums.get(label, 0) + error
    assert {r.label_error for r in got} == set(sums.values())
    assert orchard.compress(table.limit(0), F.col("label")).collect() == []
    assert orchard.compress(table.filter("vec_id = 56"), F.col("label")).collect() == []


def test_decoded_vectors_are_the_named_entries(spark):
    rows = [(i, [float(i % 5), 1.0] * 8) for i in range(20)]
    vectors = orchard.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    books = orchard.train(vectors, entries=5)
    decoded = orchard.decode(orchard.encode(vectors, books, "vec_id", "embedding"), books)
    assert all(r.approximation == r.embedding and r.error == 0 for r in decoded.collect())
