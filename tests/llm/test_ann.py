"""Search against brute force: recall, exact scores, ties and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from conftest import TESTDATA
from modgauge.llm import ann, queries


def brute(ids, vectors, is_query, k):
    v = vectors.astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for q in np.flatnonzero(is_query):
        scores = unit @ unit[q]
        order = sorted((-round(scores[i], 12), ids[i]) for i in range(len(ids)) if ids[i] != ids[q])
        found[ids[q]] = [i for _, i in order[:k]]
    return found


def test_recall_on_given_vectors(spark):
    folder = f"{TESTDATA}/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids = table.vec_id.to_numpy()
    expected = brute(ids, np.stack(table.embedding), ids % 50 == 0, 5)
    got = {}
    for r in queries.op3_ann(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(got) == set(expected)
    hits = sum(len(set(got[q].values()) & set(expected[q])) for q in expected)
    assert hits >= 0.99 * 5 * len(expected)


def test_bounds_leave_most_vectors_alone():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4000, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    turned = unit @ ann.rotation(64)
    own = ann.Searcher(np.arange(20) + 10_000, rng.normal(size=(20, 64)), 5, ann.EPSILON)
    for at in range(0, 4000, 500):
        part = slice(at, at + 500)
        codes = np.packbits(turned[part] > 0, axis=1)
        own.add(np.arange(4000)[part], v[part], codes, np.abs(turned[part]).sum(axis=1) / 8)
    assert own.reranked < 0.5 * 20 * 4000


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [3.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 0.0], 1),
        (3, [0.0, 1.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [nan, 1.0, 0.0], 1), (7, [inf, 1.0, 0.0], 1),
        (8, [None, 1.0, 0.0], 1), (None, [1.0, 1.0, 0.0], 1), (9, [1.0], 1), (10, [1e-30, 0.0, 0.0], None), (11, [-1e30, 0.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = ann.search(vectors, F.col("vec_id").isin(0, 3, 5), k=3).collect()
    by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert by == {
        (0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (10, 1.0),
        (3, 1): (0, 0.0), (3, 2): (1, 0.0), (3, 3): (2, 0.0),
    }
    few = ann.search(vectors.filter("vec_id < 2"), F.col("vec_id") == 0, k=5).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert ann.search(vectors.limit(0), F.lit(True), k=5).collect() == []


def test_query_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    one = sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 4 == 0, k=3).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 4 == 0, k=3).collect())) == one


def test_rows_that_repeat_an_id_raise_the_floor_once(spark):
    """Many rows of the nearest id must not keep the fifth nearest id out."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    query = np.array(rows[0][1])
    rows += [(1, (query + rng.normal(size=16) * 0.01).tolist()) for _ in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    best = {}
    for (i, _), score in zip(rows, unit @ unit[0], strict=True):
        if i:
            best[i] = max(best.get(i, -2), score)
    expected = sorted(best, key=lambda i: (-best[i], i))[:5]
    got = ann.search(vectors, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == expected and expected[0] == 1


def test_very_small_and_large_components(spark):
    small, large = 1e-200, 1e200
    rows = [(0, [3 * small, 4 * small]), (1, [4 * small, 3 * small]), (2, [3 * large, 4 * large]), (3, [1.0, 0.0]), (4, [1e300, 1e-300])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=5)
    by = {r.vec_id: r.score for r in got.collect()}
    assert {i: round(score, 12) for i, score in by.items()} == {1: 0.96, 2: 1.0, 3: 0.6, 4: 0.6}
