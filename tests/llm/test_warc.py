"""Archives written and read back, in one piece and in many."""

import gzip
import hashlib
import random

import pytest

from modgauge.llm import warc


def plain(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        other = first.get(body, page) if page is not None and len(body) >= 100 else page
        revisit = page is not None and other != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return out


def back(spark, path):
    return [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()
    ]


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("chunk", [warc.CHUNK, 37])
def test_round_trip(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rng = random.Random(2)
    bodies = [None, "", "a", "x" * 99, "x" * 100, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "WARC/1.1\r\n", "é漢🙂" * 80, "\n" * 150]
    bodies += ["".join(rng.choice("ab\r\n WARC/1.1é") for _ in range(rng.randrange(700))) for _ in range(30)]
    bodies.append("long " * 60_000 if chunk > 100 else "long " * 300)
    rows = [(i, f"http://e.x/{i}", b) for i, b in enumerate(bodies)]
    rows += [(100 + i, "u\r\nX: y", b) for i, b in enumerate(bodies)]
    rows += [(3, None, "again" * 40), (3, None, "again" * 40), (4, "", "again" * 40), (None, "n", "again" * 40), (None, "n", None)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, record_type string")
    warc.write(pages.repartition(3), f"{tmp_path}/w")
    assert sorted(back(spark, f"{tmp_path}/w"), key=key) == sorted(plain(rows), key=key)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    assert back(spark, f"{tmp_path}/w") == []


def test_standard_archive_compressed_by_record(spark, tmp_path):
    def member(kind, body, extra=""):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{len(body)}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return gzip.compress(head.encode() + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    data = member("warcinfo", b"software: x\r\n") + member("response", http + b"hello \xff\x00 WARC/1.1\r\n bytes") + member("request", b"GET /")
    (tmp_path / "a.warc.gz").write_bytes(data)
    payload = b"hello \xff\x00 WARC/1.1\r\n bytes"
    assert back(spark, str(tmp_path)) == [(None, len(payload), hashlib.sha256(payload).hexdigest(), "response", None)]
    bad = member("response", http + b"other", "WARC-Payload-Digest: sha256:" + "0" * 64 + "\r\n")
    (tmp_path / "a.warc.gz").write_bytes(bad)
    with pytest.raises(Exception, match="does not match"):
        back(spark, str(tmp_path))
