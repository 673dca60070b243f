"""Counts and base score by definition, the model by its sum to one and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from conftest import TESTDATA
from modgauge.llm import lm, queries


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, docs):
    train = Counter()
    for doc_id, text in docs:
        if not held(doc_id):
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    expected = []
    for doc_id, text in docs:
        own = tokens(text)
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own)
        expected.append((doc_id, held(doc_id), len(own), sum(train[t] > 0 for t in own), n, base))
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def test_query_on_documents(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op10_lm(spark, folder).collect()
    check_base(rows, docs)
    unseen = [r for r in rows if r.held_out]
    model, base = (sum(r[c] for r in unseen) / sum(r.n_tokens for r in unseen) for c in ("score", "base_score"))
    assert model > base + 0.02  # log10 a token, on texts not trained on


def test_small_head_and_vocabulary_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "VOCAB", 8)
    monkeypatch.setattr(lm, "_LOCAL", 10)
    rows = [(i, f"the a{i % 7} of b{i % 3} THE x{i} " * (i % 4)) for i in range(60)]
    rows += [(None, "the end"), (None, None), (7, ""), (7, "dup dup"), (7, "dup dup"), (8, "w" * 200_000 + " é\x0bÉ")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id bigint, text string, score double, n int")
    scored = lm.score_documents(docs)
    check_base(scored.collect(), rows)
    assert all(r.score <= 0 for r in scored.collect())
    empty = lm.score_documents(docs.limit(0))
    assert empty.collect() == []


def test_no_training_rows(spark):
    ids = [i for i in range(60) if held(i)][:4]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    for r in lm.score_documents(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_model_is_normalised_and_learns_pairs(spark):
    text = "red green blue " * 30
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id bigint, text string")
    counts = lm.word_counts(docs)
    model = lm.train(docs, counts)
    table = 10 ** model.table()
    assert np.allclose(table.sum(axis=1), 1)
    at = {w: i for i, w in enumerate(model.words)}
    assert table[at[b"red"], at[b"green"]] > 0.8


def test_score_by_definition(spark, monkeypatch):
    """Every document's score from the model's table and plain counts; all words of a class share its mass."""
    monkeypatch.setattr(lm, "HEAD", 30)
    monkeypatch.setattr(lm, "VOCAB", 26)
    monkeypatch.setattr(lm, "CLASSES", 6)
    words = [f"{stem}{end}" for stem in ("a", "be", "cu", "do", "é") for end in ("ing", "er", "", "s", "一")]
    rows = [(i, " ".join(words[(i * 7 + j * j) % 25] for j in range(i % 23)) + (" unheard" if i % 5 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            train.update(t.encode() for t in tokens(text))
    training = docs.filter(~lm.is_held_out(docs.doc_id))
    counts = lm.word_counts(training)
    model = lm.train(training, counts)
    table, own = model.table(), {w: i for i, w in enumerate(model.words[: model.size])}
    assert model.size == 20 and len(table) == 26

    def class_of(word):
        return zlib.crc32(word[-2:]) % 6

    inside = [[n for w, n in train.items() if w not in own and class_of(w) == c] for c in range(6)]
    assert [sum(x) for x in inside] == model.class_total.tolist()
    assert [len(x) for x in inside] == model.class_distinct.tolist()
    # With what is kept for words never seen, a class shares its mass out completely.
    for x in inside:
        assert math.isclose(sum(n + 1 for n in x) + 1, sum(x) + len(x) + 1)

    def place(word):
        return own[word] if word in own else model.size + class_of(word)

    for r in lm.score(docs, counts, model).collect():
        before, total = b"\n", 0.0
        for t in tokens(dict(rows)[r.doc_id]):
            t = t.encode()
            total += table[place(before), place(t)]
            if t not in own:
                c = inside[class_of(t)]
                total += math.log10((train[t] + 1) / (sum(c) + len(c) + 1))
            before = t
        assert math.isclose(r.score, total, rel_tol=1e-9, abs_tol=1e-9)
