"""WARC archives as a chunked record table, written and read by Spark.

Chunks.  A payload is cut into pieces of at most CHUNK bytes, rows of (record id,
chunk number, bytes) that carry the digest of the payload up to and with that
piece, computed incrementally.  In the archive piece 1 is a `response` record and every
later one a `continuation` record (WARC 1.1 segmentation), so no writer or reader ever builds
a payload from its pieces.

Writing.  Every record is one row of a text sink, whose line feed is the record's
own last byte, compressed with gzip: any file system that Spark writes to will do, and files
are as many as tasks.

Reading.  Spark's text source splits files at the version line; gzip files are
not split further, so a record that holds a version line itself is put together again by its
Content-Length.  Standard archives compressed record by record are read the same
way.  Pieces of a record meet in one shuffle of pieces only, sorted by number, and their digest is
folded over them one at a time; whole records are digested where they are read.

Records of equal payloads of LEAST_REVISIT bytes or more: the one with the
smallest page_id is the response, the others are `revisit` records that refer to
it.  Rows that repeat that page_id are responses as well, and so are rows without
page_id, which are read back with a null page_id.  Null html is an empty payload, null url an empty one.
Control characters in a url become spaces.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from modgauge.llm.text import texts
from modgauge.operators.skew import join_keyed

VERSION = b"WARC/1.1\r\n"
CHUNK = 1 << 16
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string"
)


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    # Only payloads that occur under several ids need a partner at all.
    firsts = (
        rows.filter(long & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first < last")
        .select("digest", "first")
    )
    other = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    # A payload that very many pages share is dealt out over tasks.
    return join_keyed(rows, firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", other.alias("refers_to")
    )


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None, digest: str) -> str:
    """A record id; equal rows share it, and then their pieces are equal too."""
    return f"<{_ID}{'' if page_id is None else page_id}:{digest[:16]}>"


def _records(page_id, url, payload: bytes, digest: str, refers_to) -> Iterator[bytes]:
    own = _name(page_id, digest)
    fields = [
        ("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", " ", url or "")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to, digest)), ("WARC-Profile", PROFILE)]
        yield _record("revisit", [("WARC-Record-ID", own), *fields], http)
        return
    state, view = hashlib.sha256(), memoryview(payload)
    for number, at in enumerate(range(0, len(payload) or 1, CHUNK), 1):
        piece = view[at : at + CHUNK]
        state.update(piece)
        so_far = ("WARC-X-Digest-So-Far", f"sha256:{state.hexdigest()}")
        if len(payload) <= CHUNK:
            yield _record("response", [("WARC-Record-ID", own), *fields], http + bytes(piece))
        elif number == 1:
            segment = [("WARC-Segment-Number", "1"), so_far]
            yield _record("response", [("WARC-Record-ID", own), *fields, *segment], http + bytes(piece))
        else:
            segment = [
                ("WARC-Record-ID", f"{own[:-1]}#{number}>"),
                ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", str(number)),
                so_far,
            ]
            if at + CHUNK >= len(payload):
                segment.append(("WARC-Segment-Total-Length", str(len(http) + len(payload))))
            yield _record("continuation", segment, bytes(piece))


def write(pages: DataFrame, path: str) -> None:
    """One archive file for each task below `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, digests, others = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            rows, held = [], 0
            for row in zip(ids, urls, texts(batch.column(2)), digests, others, strict=True):
                for record in _records(*row):
                    rows.append(record[:-1])  # the sink writes the last line feed
                    held += len(record)
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                        rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    lines = classify(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").text(path)


class _Reader:
    """Puts the records of one file together from the texts between version lines."""

    def __init__(self, version: bytes):
        self.version = version
        self.head: dict[str, str] = {}
        self.body: list[bytes] = []
        self.missing = 0

    def feed(self, part: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.missing:  # the version line was part of the record's block
            self.body.append(self.version + part)
            self.missing -= len(self.version) + len(part)
        elif part.strip():
            head, gap, block = part.partition(b"\r\n\r\n")
            if not gap:
                return
            lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
            self.head = {name.strip().lower(): value.strip() for name, _, value in lines}
            self.body = [block]
            self.missing = int(self.head.get("content-length", 0)) - len(block)
        else:
            return
        if self.missing <= 0:
            size = int(self.head.get("content-length", 0))
            self.missing = 0
            yield self.head, b"".join(self.body)[:size]


def _page(value: str | None) -> int | None:
    """The page_id in a record id of ours."""
    found = re.fullmatch(rf"<{_ID}(-?\d+):[0-9a-f]*>", value or "")
    return int(found[1]) if found else None


def pieces(spark: SparkSession, path: str, version: bytes = VERSION) -> DataFrame:
    """(record, number, piece, last, digest_so_far, ...): a row for each record or segment.

    Records that are whole carry their digest and no bytes.
    """
    files = spark.read.option("lineSep", version.decode()).text(path)
    parts = files.select(F.col("value").cast("binary"), F.input_file_name().alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = _Reader(version), None
        for batch in batches:
            rows = []
            files_of = batch.column(1).to_pylist()
            for part, file in zip(texts(batch.column(0)), files_of, strict=True):
                if file != at:
                    reader, at = _Reader(version), file
                for head, block in reader.feed(part):
                    if row := _row(head, block):
                        rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    return parts.mapInArrow(run, _PIECE_COLUMNS)


_PIECE_COLUMNS = (
    "record string, number int, piece binary, so_far string, page_id bigint, url string, "
    "record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
)
_PIECES = pa.schema(
    [
        (name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (part.split() for part in _PIECE_COLUMNS.split(", "))
    ]
)


def _row(head: dict[str, str], block: bytes) -> dict | None:
    kind, number = head.get("warc-type"), int(head.get("warc-segment-number", 0))
    own = head.get("warc-record-id")
    if kind == "continuation":
        return {"record": head.get("warc-segment-origin-id"), "number": number, "piece": block,
                "so_far": head.get("warc-x-digest-so-far", "").partition(":")[2]}
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = head.get("warc-payload-digest", "").partition(":")[2]
    row = {"record": own, "number": number, "page_id": _page(own), "url": head.get("warc-target-uri"),
           "record_type": kind, "refers_to": _page(head.get("warc-refers-to")),
           "payload_digest": declared}
    if kind == "revisit":
        length = re.search(rb"(?i)^content-length: *(\d+)", http, re.M)
        row["payload_bytes"] = int(length[1]) if length else None
    elif number:
        row |= {"piece": payload, "so_far": head.get("warc-x-digest-so-far", "").partition(":")[2]}
    else:
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    if row["payload_digest"] != declared and declared:
        raise ValueError(f"payload of {own} does not match its digest")
    return row


def read(spark: SparkSession, path: str, version: bytes = VERSION) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of every record.

    A payload that does not match the digests its records carry is an error.
    """
    found = pieces(spark, path, version)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            rows = []
            columns = [batch.column(name) for name in _READ.names]
            for i, number in enumerate(batch.column(1).to_pylist()):
                if number in (0, 1):
                    row = {k: c[i].as_py() for k, c in zip(_READ.names, columns, strict=True)}
                if number == 0:  # whole
                    rows.append(row)
                    continue
                name = batch.column(0)[i].as_py()
                if open_ is None or open_.name != name:
                    rows += open_.finished() if open_ else []
                    open_ = _Open(name)
                if number == 1:
                    open_.rows.append(row)
                open_.add(number, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
        if open_:
            yield pa.RecordBatch.from_pylist(open_.finished(), schema=_READ)

    # Names are unique but for repeated rows, so this is even.
    ordered = found.repartition("record").sortWithinPartitions("record", "number")
    return ordered.mapInArrow(fold, RECORDS)


class _Open:
    """A segmented record while its pieces pass by in order.

    Rows that repeat a record bring every piece again, next to its equal.
    """

    def __init__(self, name: str):
        self.name, self.rows, self.number, self.size = name, [], 0, 0
        self.state = hashlib.sha256()

    def add(self, number: int, piece: bytes, so_far: str | None) -> None:
        if number == self.number:
            return
        if number != self.number + 1:
            raise ValueError(f"segment {number} of {self.name} has no segment before it")
        self.state.update(piece)
        self.size, self.number = self.size + len(piece), number
        if so_far and so_far != self.state.hexdigest():
            raise ValueError(f"segment {number} of {self.name} does not match its digest")

    def finished(self) -> list[dict]:
        digest = self.state.hexdigest()
        if any(row["payload_digest"] not in ("", digest) for row in self.rows):
            raise ValueError(f"payload of {self.name} does not match its digest")
        return [r | {"payload_bytes": self.size, "payload_digest": digest} for r in self.rows]


_READ = pa.schema(
    [
        (name, {"string": pa.string(), "bigint": pa.int64()}[kind])
        for name, kind in (part.split() for part in RECORDS.split(", "))
    ]
)
