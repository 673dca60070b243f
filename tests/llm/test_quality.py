"""Counts against a plain version, the model by held-out accuracy."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from conftest import TESTDATA
from modgauge.llm import quality, queries


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_counts_and_verdicts(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op2_quality(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == plain_counts(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.quality >= quality.KEEP_AT)


def test_model_on_rows_it_has_not_seen(spark):
    """Trained on two labels of three, judged on the third."""
    folder = f"{TESTDATA}/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    judged = quality.judge(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model)
    seen = [
        (r.quality, r.judged.kept, r.judged.quality)
        for r in judged.collect()
        if not r.judged.base_failed  # those are out by the rule, whatever their label
    ]
    good = [kept for q, kept, _ in seen if q == 1]
    bad = [kept for q, kept, _ in seen if q == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.1
    # Calibrated: the mean probability is close to the share of good rows.
    assert abs(np.mean([p for _, _, p in seen]) - np.mean([q for q, _, _ in seen])) < 0.05


def test_edge_rows(spark):
    rng = random.Random(3)
    odd = [None, "", " \n\t", "a", "a b c d e f g h " * 30, "é漢 " * 9 + "\n\n\x0b#", "w" * 300_000, "x\n" * 50, "p q r s t u v w x " * 2]
    odd += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i if i % 5 else None, t, True, i) for i, t in enumerate(odd + odd[:3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean, n_words int")
    for model in (None, quality.Model(np.ones(quality.GROUPS * quality.GROUP_SIZE, np.float32), 1.0, 0.0)):
        judged = quality.judge(docs, model)
        assert judged.columns == [*docs.columns, "judged"]
        for r in judged.collect():
            assert tuple(r.judged[c] for c in COUNTS) == plain_counts(r.text)
            assert r.judged.kept == (not r.judged.base_failed)
    assert quality.judge(docs.limit(0), None).collect() == []
    # No labels, labels of one class, contradicting and null labels: no model.
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 0), (3, 1)], "doc_id bigint, quality int")
    assert quality.train(docs, some) is None
    assert quality.train(docs, some.limit(0)) is None


def test_words_of_equal_hash_are_different_words():
    """The words' hash is a polynomial modulo 2^64, in which the two spellings below collide."""
    word, other = "", ""
    a, b = "a", "b"
    for _ in range(10):  # Thue and Morse's sequence and its opposite
        a, b = a + b, b + a
    word, other = a, b
    filler = " ".join(f"w{i}" for i in range(30))
    text = f"{word} p q r s t u v {filler} {other} p q r s t u v {filler[:20]}"
    block = quality.Block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert block.repeated_words()[0] == plain_counts(text)[4]
    same = f"{word} p q r s t u v {filler} {word} p q r s t u v"
    block = quality.Block(np.frombuffer(same.encode(), np.uint8), np.array([0, len(same)]))
    assert block.repeated_words()[0] == plain_counts(same)[4] == 16


def test_a_column_may_be_called_judged(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").selectExpr("*", "1 AS judged", "2 AS Judged_")
    kept = corpus_pipeline.keep_good(spark, docs, f"{TESTDATA}/sf0.001")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


MEMORY = """
import random
from pathlib import Path
import numpy as np, pyarrow as pa
from modgauge.llm import quality

def held(name):
    return int(Path("/proc/self/status").read_text().split(name + ":")[1].split()[0]) / 1024

rng = random.Random(4)
words = [f"{rng.randrange(10**7)}" for _ in range(40_000)]
texts = [" ".join(rng.choices(words, k=450)) for _ in range(2000)]
column, model = pa.array(texts), quality.Model(np.ones(quality.GROUPS * quality.GROUP_SIZE, np.float32), 1.0, 0.0)
start = held("VmHWM")
quality._judged_column(column, model, 0.5)
print(held("VmHWM") - start)
quality._fit([(i, t.encode(), i % 2) for i, t in enumerate(texts)], 0.5)
print(held("VmHWM") - start)
"""


def test_memory_of_training_and_judging():
    """A worker holds a block's numbers, or little more than the n-grams of 7 MB of training texts."""
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, check=True).stdout
    judged, trained = map(float, out.split())
    assert judged < 60 and trained < 190
