"""Base spans against plain patterns, the added spans on planted cases."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from conftest import TESTDATA
from modgauge.llm import pii, queries


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text, kind):
    for m in re.finditer(pii.BASE[kind], text or "", re.A):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
            continue
        if kind == "phone" and not 9 <= len(digits) <= 15:
            continue
        yield f"{kind}:{m.start()}:{m.end()}"


def check(rows, texts):
    for r in rows:
        spans = [list(plain_spans(texts[r.doc_id], kind)) for kind in pii.BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans], texts[r.doc_id][:200]
        base = ",".join(s for found in spans for s in found)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (base, r.spans)
        assert r.spans == base or r.spans.startswith(base + ("," if base else ""))


def test_query_on_documents(spark):
    folder = f"{TESTDATA}/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    # The secrets of the given documents, none of which a base pattern knows.
    for r in rows:
        added = {x for x in r.spans.split(",") if x.split(":")[0] not in pii.BASE and x}
        secrets = [m.span(1) for m in re.finditer(r'(?:password=|token = ")([0-9a-f]{16,})', texts[r.doc_id])]
        assert {f"secret:{a}:{b}" for a, b in secrets} <= added
        assert all(x.startswith("secret") for x in added)


def odd_texts():
    rng = random.Random(9)
    parts = ["a@b", ".c", "@", "1.2.3.4", ".5.6.7", "999.1.1.1", "+1 (23) 456-789", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "00", " ", "-", "--", "é", "🙂", "x", "\n", "+", "(", "7" * 13, "_%", "256.0255.000000.1"]
    for _ in range(400):
        yield "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
    yield from ["a" * 60_000, "1" * 60_000, "a@" * 20_000, "1." * 30_000, "+1" * 20_000, "1 " * 40_000, "a@b." + "c." * 30_000, "+" + "1-" * 30_000]


def test_odd_texts_and_rows(spark):
    texts = {i: t for i, t in enumerate(odd_texts())}
    texts |= {1000: None, 1001: ""}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, email string")
    check(pii.find(docs, pii.train(docs)).collect(), {i: t or "" for i, t in texts.items()})
    twice = docs.filter("doc_id < 3").union(docs.filter("doc_id < 3")).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert len(pii.find(twice, {}).collect()) == 6
    assert pii.train(docs.limit(0)) == {}
    assert pii.find(docs.limit(0), {}).collect() == []


def test_votes_find_what_no_pattern_is_sure_of(spark):
    rng = random.Random(1)
    words = lambda: " ".join(rng.choice(["thon", "re", "las", "mit"]) for _ in range(6))
    true, false = [], []
    for i in range(80):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        h = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        true.append([f"api_key: '{h}'", f"password={h[:18]}", f"phone ({n(3)}) {n(3)}-{n(4)}", f"tel {n(3)}-{n(3)}-{n(4)}"][i % 4])
        false.append([f"page: thonline", f"in {n(4)}-{n(4)} years", f"width={n(6)}", f"{n(7)} and", "note: seemingly"][i % 5])
    rows = [(i, f"{words()} {t} {words()}") for i, t in enumerate(true)]
    rows += [(1000 + i, f"{words()} {t} {words()}") for i, t in enumerate(false)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs, pii.train(docs)).collect()}
    assert sum(bool(found[i]) for i in range(80)) >= 76
    assert not any(found[1000 + i] for i in range(80))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é write a.b@c.de or +1 222 333 4444 now"), (2, None), (3, "none")], "doc_id bigint, text string")
    found = docs.join(pii.find(docs, {}), "doc_id")
    got = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(found.text, found.spans).alias("t")).collect()}
    assert got == {1: "é write [email] or [phone] now", 2: None, 3: "none"}


def test_spans_reach_the_end_and_neighbours_are_apart(spark):
    rng = random.Random(4)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdefXYZ") for _ in range(k))
    phone = lambda: f"{n(3)}-{n(3)}-{n(4)}"
    rows = {i: f"call {phone()} now or password={h(18)} then" for i in range(60)}
    rows |= {100 + i: f"in {n(4)}-{n(4)} years width={n(6)} note: seemingly {n(7)} and" for i in range(60)}
    planted = [
        ["token=", h(400)], ["secret='", ".".join(h(300) for _ in range(3))], ["token=", h(90) + "=="],
        ["s3_secret=", h(40)], ["a_quite_long_name_that_goes_on_and_on_secret=", h(40)], ["token2=", h(40)], ["--password=", h(20)],
        ["", phone(), " ", phone()], ["phone ", phone(), " ", phone(), " ", phone(), " ", phone()],
        ["(", phone(), ") (", phone()], ["", f"({n(3)}) {n(3)}-{n(4)}", " ", f"{n(3)} {n(3)} {n(4)}"],
        ["", phone(), " 4210 ", phone()], ["ssn ", f"{n(3)}-{n(2)}-{n(4)}", " ", f"{n(3)}-{n(2)}-{n(4)}"],
    ]
    rows |= {1000 + i: "é at " + "".join(parts) + " end" for i, parts in enumerate(planted)}
    rows |= {2000: "a" * 60_000 + "=" + "b1" * 30_000, 2001: "1 " * 40_000, 2002: "12-" * 30_000, 2003: "1" * 60_000 + "a"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs, pii.train(docs)).collect()}
    for i, parts in enumerate(planted):
        kind = "secret" if "=" in parts[0] or "'" in parts[0] else "number"
        at, expected = 5, []
        for j, part in enumerate(parts):
            if j % 2:
                expected.append(f"{kind}:{at}:{at + len(part)}")
            at += len(part)
        assert got[1000 + i] == ",".join(expected), (rows[1000 + i][:300], got[1000 + i], expected)
    # Groups of four that are part of a longer number stay in one candidate.
    longer = ["3704 0044 0532 0130 00", "1177 3016 1111 1018 0000 0000", "1" * 70]
    frame = spark.createDataFrame([(f"at {x} end",) for x in longer], "text string")
    spans = [[(c.start, c.end) for c in r.c] for r in frame.select(pii.candidates(frame.text).alias("c")).collect()]
    assert spans == [[(3, 3 + len(x))] for x in longer]
    cards = " ".join(["4111 1111 1111 1111"] * 3)
    found = spark.createDataFrame([(cards,)], "text string").select(pii.candidates(F.col("text")).alias("c")).first().c
    assert [(c.start, c.end) for c in found] == [(0, 19), (20, 39), (40, 59)]


def test_keys_may_hold_any_letters(spark):
    texts = ["contraseña=Abc123xyz9qq", "mi_contraseña: 'k9f8e7d6c5b4a392'", "téléphone: rien"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.c for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert [(c.kind, texts[0][c.start : c.end]) for c in got[0] if c.kind == "secret"] == [("secret", "Abc123xyz9qq")]
    assert [texts[1][c.start : c.end] for c in got[1] if c.kind == "secret"] == ["k9f8e7d6c5b4a392"]


def test_many_matches_are_placed_like_few(spark):
    """Runs of matches carry their places and what stands before them over the runs' borders."""
    rng = random.Random(4)
    text = "".join(rng.choice(["a@b.cd", "é ", "word tel ", " ", "-", "x@y.zz "]) for _ in range(6000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.cd " * 32_000)], "doc_id bigint, text string")
    spans = pii.found(F.col("text"), pii.BASE["email"]).alias("s")
    started = time.monotonic()
    got = {r.doc_id: r.s for r in docs.select("doc_id", spans).collect()}
    assert time.monotonic() - started < 40
    plain, before, last = [], "", 0
    for m in re.finditer(pii.BASE["email"], text, re.A):
        gap = text[last : m.start()]
        if not re.fullmatch(r"[\x20().-]*", gap):
            before = gap[-pii.CONTEXT :]
        plain.append((m.start(), m.end(), m[0], before))
        last = m.end()
    assert len(plain) > 3 * pii._RUN
    assert [tuple(s) for s in got[1]] == plain
    assert [(s.start, s.end) for s in got[2]] == [(7 * i, 7 * i + 6) for i in range(32_000)]
