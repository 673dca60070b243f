"""Fingerprints from the definition, components against all pairs."""

import random
import re

import xxhash

from conftest import TESTDATA
from modgauge.llm import queries, simhash


def plain_fingerprint(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    n = max(1, len(words) - width + 1)
    shingles = [" ".join(words[i : i + width]) for i in range(n)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    """Smallest index reachable, by flooding over all pairs."""
    root = {}
    for start in range(len(fps)):
        if start in root:
            continue
        open_, root[start] = [start], start
        while open_:
            at = open_.pop()
            for other in range(len(fps)):
                if other not in root and (fps[at] ^ fps[other]).bit_count() <= radius:
                    root[other] = start
                    open_.append(other)
    return root


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 4, 5, 6, 40, 300):
        text = " ".join(rng.choice(["Éa", "the", "B C", "x y", "ñ"]) + rng.choice(["", "\t", "\x0b\n"]) for _ in range(n))
        for width in (4, 5):
            assert simhash.fingerprint(text.encode(), width) == plain_fingerprint(text, width)


def test_components_of_clustered_words(spark):
    rng = random.Random(7)
    fps = [0, (1 << 64) - 1]
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):  # walks of up to four bits, and some of five
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 4, 5])):
                at ^= 1 << bit
            fps.append(at)
    expected = plain_components(fps, 4)
    df = spark.createDataFrame([(simhash._signed(x),) for x in set(fps)], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(roots.get(simhash._signed(x), simhash._signed(x)), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))


def test_query_against_all_pairs(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(text, 4) for _, text in docs]
    expected = plain_components(fps, 4)
    got = {r.doc_id: r for r in queries.op1_simhash(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, (doc_id, _) in enumerate(docs):
        assert got[doc_id].fingerprint == f"{fps[i]:016x}"
        assert got[doc_id].component_id == docs[expected[i]][0]


def test_edge_rows_and_keeping_one(spark):
    text = "one two three four five six seven"
    rows = [
        (5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, "quite other words stand here today", "d"),
        (9, None, "e"), (8, "", "f"), (7, " \n", "g"), (None, "quite other words stand here today", "h"), (-2, "z " * 50_000, "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(5, 3), (3, 3), (None, 3), (None, None), (9, 7), (8, 7), (7, 7), (-2, -2)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(
        [(3, text), (0, rows[4][1]), (7, " \n"), (-2, rows[9][1])]
    )
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_rows_that_repeat_an_id_and_hostile_names(spark):
    """Which row stays does not depend on where the rows lie, and no column is overwritten."""
    rows = [(1, f"text number {i} of the same id", f"k{i}", i) for i in range(6)] + [(1, "a b", "k", 9), (1, "a b", "l", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string, _rest bigint")
    kept = {tuple(sorted(map(str, simhash.keep_one(docs.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(kept) == 1
    (row,) = simhash.keep_one(docs).collect()
    assert row.text == "a b" and (row._kept, row._rest) in {("k", 9), ("l", 8)}
