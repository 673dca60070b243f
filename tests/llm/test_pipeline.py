"""Every stage against a brute-force version of its own input."""

import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from conftest import TESTDATA
from modgauge.llm import bpe, mixing, quality
from test_linededup import plain_removed
from test_mixing import plain_slots
from test_quality import plain_counts
from test_simhash import plain_components, plain_fingerprint

FOLDER = f"{TESTDATA}/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert name == "bpe" or seen[-1].columns == columns
    start, good, lines, alone, mixed, tokens = (x.collect() for x in seen)

    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    verdict = {r.doc_id: r.judged.quality for r in quality.judge(docs, model).collect()}
    kept = {r.doc_id for r in start if not plain_counts(r.text)[5] and verdict[r.doc_id] >= quality.KEEP_AT}
    assert {r.doc_id for r in good} == kept

    gone = plain_removed([(r.doc_id, r.text) for r in good])
    expected = {}
    for r in good:
        out = gone.get((r.doc_id, r.text), set())
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in out)
        if text.strip():
            expected[r.doc_id] = (text, len(text) if out else r.n_chars)
    assert {r.doc_id: (r.text, r.n_chars) for r in lines} == expected

    order = sorted(lines, key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text, 4) for r in order], 4)
    assert {r.doc_id for r in alone} == {order[i].doc_id for i in set(roots.values())}

    assert sorted(map(tuple, mixed)) == sorted(map(tuple, alone))
    sizes = {}
    for r in alone:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}
    slots = plain_slots(blocks, {s: n**mixing.TEMPERATURE for s, n in sizes.items()})
    files = sorted((tmp_path / "mixing").glob("part-*"))
    names = [s for f in files for s in pq.read_table(f)["source"].to_pylist()]
    # Below a block for each source here: sources follow each other in slot order.
    assert max(sizes.values()) <= mixing.BLOCK and list(dict.fromkeys(names)) == slots

    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed}
    assert {r.doc_id for r in tokens} == set(texts)
    for r in tokens:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_places_in_the_mix(spark, monkeypatch):
    last = [x for x in corpus_pipeline.STAGES if x[0] in ("mixing", "bpe")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", last)
    folder = f"{TESTDATA}/sf0.01"
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = [r.doc_id for r in mixing.mix(docs).orderBy("_mix_slot", "_mix_place").select("doc_id").collect()]
    assert sorted(r.mix_position for r in rows) == list(range(len(rows)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_position)] == expected


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "s"), (None, "word " * 3, None), (2, "", "s"), (3, "\n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "doc_id", "text", "'en' AS lang", "source", "0L AS n_chars", "1 AS kept", "'x' AS line"
    )
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, FOLDER)
            assert name == "bpe" or out.columns == docs.columns
            out.collect()
