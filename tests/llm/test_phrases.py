"""Phrases against plain counting, whatever the sample proposes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from against_sql import both
from conftest import TESTDATA
from modgauge.llm import phrases

SCHEMA = "doc_id bigint, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = Counter()
    for _, lang, text in rows:
        text = (text or "").translate(LOWER)
        for cut in ",;:!?\n\x0b\x0c\r":
            text = text.replace(cut, ".")
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for m in (1, 2, 3):
                counts.update(("und" if lang is None else lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return counts


def plain(rows, least=10, top=2000):
    counts, out = counted(rows), []
    wanted = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for lang in {lang for lang, _ in counts}:
        n = sum(a for (other, p), a in counts.items() if other == lang and len(p) == 1)
        found = []
        for (other, p), a in wanted.items():
            if other != lang:
                continue
            longer = [b for (o, q), b in wanted.items() if o == lang and len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [
                (1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = phrases.collocations(docs, F.col("lang"), F.col("text"), F.col("doc_id"), **options)
    return sorted(map(tuple, found.collect()))


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "Ärger", "ärger", "x-y", "a b", "(q)", "日本", "kiln", "loom"] + [f"w{i}" for i in range(40)]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "; "]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randrange(0, 60)):
            text += rng.choice(["in front of", "kiln loom mill", *words[: rng.randrange(2, len(words))]]) + rng.choice(gaps)
        rows.append((i, rng.choice(["en", "en", "de", None, "und", ""]), text))
    return [*rows, *rows[:20], (None, "en", "of the of the " * 30), (7, None, None), (8, "en", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = corpus(seed)
    assert mined(spark, rows) == plain(rows)


@pytest.mark.parametrize("share", [1 << 40, 1])
def test_result_does_not_depend_on_the_sample(spark, monkeypatch, share):
    """An empty sample proposes nothing: all comes from border failures and further passes."""
    rows = corpus(3)
    monkeypatch.setattr(phrases, "SAMPLE", share)
    passes, count = [], phrases._counts
    monkeypatch.setattr(phrases, "_counts", lambda *a: passes.append(a) or count(*a))
    assert mined(spark, rows, least=5, top=30) == plain(rows, least=5, top=30)
    # A sample pass and full passes: three where nothing was proposed, one where the sample was everything.
    assert len(passes) == (4 if share > 1 else 2)


def test_query_equals_its_sql(spark):
    got, expected = both(spark, "op12_phrases", f"{TESTDATA}/sf0.001")
    assert got == expected and got


def test_expansion_counts_nothing_twice_even_when_bits_collide():
    """Every phrase is counted in exactly one pass, with sets of a few bits too."""
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(400)).encode()
    rng_bits = [phrases.np.frombuffer(rng.randbytes((1 << phrases.SLOT_BITS) // 8), phrases.np.uint8) for _ in range(4)]
    first = phrases.Proposals({1: rng_bits[0], 2: rng_bits[1]})
    second = phrases.Proposals({1: rng_bits[0] | rng_bits[2], 2: rng_bits[1] | rng_bits[3]})

    def passed(old, new):
        found = Counter()
        for length, level, _ in phrases._levels(text, 3, 3, old, new):
            for phrase, n, before in zip(level.texts.to_pylist(), level.counts.tolist(), level.before, strict=True):
                if not before and n:
                    found[length, phrase] += n
        return found

    one, two, alone = passed(None, first), passed(first, second), passed(None, second)
    assert not set(one) & set(two)
    assert one + two == alone


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    texts = [b"one two. three four, " * 20, b"", b"x" * 300, b"a b!c d"]
    pieces = [p.strip() for t in texts for p in t.translate(phrases._PIECES).split(b".")]
    joined = [p.strip() for s in phrases._stretches(texts) for p in s.split(b".")]
    assert [p for p in joined if p] == [p for p in pieces if p]
    assert max(map(len, phrases._stretches(texts))) < 400


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 2, "a b", big - 7), ("en", 1, "a", big), ("en", 1, "b", big + 5)]
    found = spark.createDataFrame(rows, "lang string, length int, phrase string, n bigint")
    counts = found.filter("length = 1").selectExpr("struct(lang, phrase) AS part", "n")
    row = phrases._scored(found.filter("length = 2"), counts).first()
    assert row.score == 1_000_000 * (big - 7) ** 2 // (big * (big + 5))


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    docs = spark.createDataFrame([(i, "en", "p q r", "x", "y") for i in range(12)], SCHEMA + ", phrase string, n string")
    got = phrases.collocations(docs, F.col("lang"), F.col("text"), F.col("doc_id")).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("p q r", 12, 12, 12, 36, 1_000_000)]
