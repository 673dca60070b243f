"""Vector code compression: product codes whose nearest entries are found by Orchard search.

A vector's components become whole numbers, floor(SCALE * x), and the vector is cut into
equal consecutive parts.  Every part position has a codebook of a fixed number of entries; a code
names the nearest entry of each part.  Codebooks start as the parts of the vectors with the
smallest ids, and each round of training replaces an entry by the rounded-down mean of the parts it is nearest to.

The nearest entry is found exactly, without looking at all entries.  Each entry keeps a list of
the others sorted by distance.  A search holds a current entry and walks that entry's list.  Every entry
met is marked and measured once; one that is nearer becomes the current one, and the walk goes
on in its list.  An entry further from the current one than twice the current distance cannot
be nearer, so there the walk ends.  On a tie the lower index wins; the walk includes entries at exactly
twice the distance, so that such an entry is always met.  All parts of a block walk in step.

A round is one pass over the vectors.  Tasks hand on sums of fixed size (entries times
dimension), which Spark adds up; only codebooks pass through the driver.

Rows whose vector is null or holds null, not-a-number or infinite components are left out.  So are
components of 2^19 or more in size, whose squared distances need not fit 64 bits, and vectors of another
length than the most frequent one that the parts divide.  Zero vectors take part.  Every row with a repeated id
is coded; in the first codebooks an id stands once, with its smallest vector.  Null ids come
after all others.  With fewer ids than entries the codebooks are smaller, and an
empty table gives no rows.  Null labels are one label.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modgauge.operators.skew import join_keyed
from modgauge.runtime import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

# Components from this size on are left out.
TOO_LARGE = float(1 << 19)

# Parts that walk in step.
_POINTS = 1 << 16


class Orchard:
    """Codebooks as (parts, entries, width) whole numbers, with their neighbour lists."""

    def __init__(self, books: np.ndarray):
        self.books = books
        gaps = np.stack([((b[:, None] - b[None]) ** 2).sum(axis=2) for b in books])
        self.lists = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, axis=2)
        self.measured = 0

    def _distance(self, points: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.measured += len(points)
        return ((points - self.books[part, entry]) ** 2).sum(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entry indexes and squared distances of whole-number vectors."""
        parts, entries, width = self.books.shape
        points = vectors.reshape(-1, width)
        n = len(points)
        part = np.tile(np.arange(parts), len(vectors))
        current = np.zeros(n, np.int64)
        distance = self._distance(points, part, current)
        marked = np.zeros((n, entries), bool)
        marked[:, 0] = True
        place = np.zeros(n, np.int64)  # in the current entry's list
        live = np.arange(n)
        while len(live):
            at = np.minimum(place[live], entries - 1)
            gap = self.gaps[part[live], current[live], at]
            live = live[(place[live] < entries) & (gap <= 4 * distance[live])]
            met = self.lists[part[live], current[live], place[live]]
            place[live] += 1
            fresh = ~marked[live, met]
            walker, met = live[fresh], met[fresh]
            marked[walker, met] = True
            found = self._distance(points[walker], part[walker], met)
            nearer = (found < distance[walker]) | (
                (found == distance[walker]) & (met < current[walker])
            )
            walker = walker[nearer]
            current[walker], distance[walker], place[walker] = met[nearer], found[nearer], 0
        return current.reshape(-1, parts), distance.reshape(-1, parts)


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows whose vector takes part, all of one length; reads the lengths once."""
    fits = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)
    )
    whole = vectors.filter(F.col("embedding").isNotNull() & fits)
    lengths = whole.groupBy(F.size("embedding").alias("length")).count()
    lengths = lengths.filter(f"length > 0 AND length % {parts} = 0")
    most = lengths.agg(F.max_by("length", F.struct("count", -F.col("length"))).alias("length")).first()
    return whole.filter(F.size("embedding") == F.lit(most["length"]).cast("int"))


def _whole_numbers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def _blocks(column: pa.Array, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole-number vectors) of a column, a bounded number of parts at a time."""
    rows = max(1, _POINTS // parts)
    for first in range(0, len(column), rows):
        yield first, _whole_numbers(column.slice(first, rows))


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks of the `entries` smallest ids in order; None without vectors."""
    ids = vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    chosen = [row.vec_id for row in ids.collect()]  # `entries` ids at most
    if not chosen:
        return None
    known = [i for i in chosen if i is not None]
    wanted = F.col("vec_id").isin(known)
    if len(known) < len(chosen):
        wanted = wanted | F.col("vec_id").isNull()
    rows = (
        vectors.filter(wanted)
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
        .orderBy(F.asc_nulls_last("vec_id"))
        .collect()
    )
    numbers = np.floor(SCALE * np.array([row.embedding for row in rows], np.float64)).astype(np.int64)
    return numbers.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s0, s1, ...): sums of the parts nearest to each entry, a row a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Orchard(books)
        counts = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for _, block in _blocks(batch.column(0), parts):
                codes, _ = own.nearest(block)
                place = (codes + np.arange(parts) * entries).ravel()
                counts += np.bincount(place, minlength=len(counts))
                np.add.at(sums, place, block.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((used // entries).astype(np.int32)),
                pa.array((used % entries).astype(np.int32)),
                pa.array(counts[used]),
                *[pa.array(sums[used, i]) for i in range(width)],
            ],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]],
        )

    fields = ", ".join(f"s{i} bigint" for i in range(width))
    return vectors.select("embedding").mapInArrow(run, f"part int, entry int, n bigint, {fields}")


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """(parts, entries, width) codebooks of usable vectors; None without any.

    An entry that no part is nearest to stays as it is.
    """
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        width = books.shape[2]
        totals = _sums(vectors, books).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
        )
        for row in totals.collect():  # parts * entries rows at most
            books[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, *kept: str) -> DataFrame:
    """(*kept, code, error): code as two hex digits a part, and the summed squared distance."""
    parts, entries, _ = books.shape
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Orchard(books)
        for batch in batches:
            codes, errors = [], []
            for _, block in _blocks(batch.column(0), parts):
                found, distance = own.nearest(block)
                codes += [row.tobytes().hex() for row in found.astype(np.uint8)]
                errors.append(distance.sum(axis=1))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                [*kept, "code", "error"],
            )

    chosen = vectors.select("embedding", *kept)
    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[1:])
    return chosen.mapInArrow(run, f"{held}code string, error bigint")


def decode(encoded: DataFrame, books: np.ndarray) -> DataFrame:
    """`encoded` with `approximation`: the entries its code names, scaled back."""
    table = F.array(
        *[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in b]) for b in books]
    )
    index = lambda p: F.conv(F.substr("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    places = F.sequence(F.lit(0), F.lit(len(books) - 1))
    picked = F.transform(places, lambda p: F.element_at(F.element_at(table, p + 1), index(p) + 1))
    return encoded.withColumn("approximation", F.flatten(picked))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    label: Column,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row.

    label_error is the error summed over all rows of the same label.
    """
    name = F.concat(F.lit("="), label.cast("string"))
    rows = usable(
        vectors.select("vec_id", "embedding", F.coalesce(name, F.lit("")).alias("label")), parts
    )
    books = train(rows, parts, entries, rounds)
    if books is None:
        nothing = "vec_id, '' AS code, 0L AS error, 0L AS label_error, '' AS codebooks_sha256"
        return rows.limit(0).selectExpr(*nothing.split(", "))
    coded, _ = written(encode(rows, books, "vec_id", "label"), rows=F.count("*"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_keyed(coded, sums, "label", "inner").select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
