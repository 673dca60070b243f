"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in `radius` bits or fewer exactly if some 64-bit word is
within half the radius of both.  So every fingerprint emits the words of that ball,
rows meet on equal words, and all that meet are linked.  The ball of 4 has 2,081
words, though, nearly all of which nobody else emits.  The 64 bits are therefore cut into three blocks: if
two fingerprints differ in 4 bits, they differ in at most 2 outside one of the
blocks, and their balls of 1 there meet.  That needs 1 + 64 - block words for each block,
131 in all, on 42 or 43 bits.  Only where two distinct fingerprints meet this way does the
ball go on into the block that was left out, to whole words.  Nothing is lost, and
a group on one whole word holds at most 2,081 fingerprints, all of them linked, so
neighbours in sorted order link the group without listing its pairs.  The groups on
partial words hold at most 44 * 2^22 whatever the corpus.  Equal fingerprints
are one row from the start.

Texts: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words with
repeats; fewer words are one shingle, none (null, empty or blank text) give fingerprint zero, which is
linked like any other.  A null doc_id never names a component while another
id is in it.  Repeated rows are members of one component.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.llm.components import components
from modgauge.llm.text import LOWER, free_name, texts
from modgauge.operators.skew import join_keyed
from modgauge.runtime import cut_lineage

WIDTH = 5
RADIUS = 4
BLOCKS = (22, 21, 21)
SEED = 42

# Shingles whose bits are counted at a time: memory for a text of any length.
_COUNTED = 1 << 14


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of one text."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    firsts = [0, *(ends[: len(words) - width] + 1).tolist()]
    lasts = ends[width - 1 :].tolist()
    n = len(lasts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _COUNTED):
        spans = zip(firsts[at : at + _COUNTED], lasts[at : at + _COUNTED], strict=True)
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in spans], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, key: Column | None = None) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long.

    `key` replaces the column doc_id as the row's name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, width) for text in texts(batch.column(1))]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    named = docs.select((F.col("doc_id") if key is None else key).alias("doc_id"), "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _balls(positions: list[int], radius: int) -> list[int]:
    """The XOR masks of at most `radius` bits among `positions`."""
    return [
        _signed(sum(1 << i for i in chosen))
        for size in range(radius + 1)
        for chosen in combinations(positions, size)
    ]


def links(fps: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within `radius` bits.

    Every pair within the radius is joined by a chain of such links, and each link is itself within
    the radius.  `fps` holds distinct values in `fp`.
    """
    if radius % 2 or sum(blocks) != 64:
        raise ValueError("the radius must be even and the blocks must make 64 bits")
    half = radius // 2
    outside = radius * (len(blocks) - 1) // len(blocks)
    first = -(-outside // 2)
    variants, start = [], 0
    for number, size in enumerate(blocks):
        own = list(range(start, start + size))
        others = [i for i in range(64) if i not in own]
        keep = _signed(sum(1 << i for i in others))
        start += size
        # The block that is left out is zero in the key; its number goes there.
        tag = _signed(number << own[0])
        variants += [(keep, mask, tag, number) for mask in _balls(others, first)]
    choices = F.array(
        *[
            F.struct(
                F.lit(keep).cast("bigint").alias("keep"),
                F.lit(mask).cast("bigint").alias("mask"),
                F.lit(tag).cast("bigint").alias("tag"),
                F.lit(number).cast("tinyint").alias("block"),
            )
            for keep, mask, tag, number in variants
        ]
    )
    emitted = fps.select("fp", F.explode(choices).alias("v")).select(
        "fp",
        F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.mask")).bitwiseOR(F.col("v.tag")).alias("key"),
        F.col("v.mask").alias("mask"),
        F.col("v.block").alias("block"),
    )
    met = emitted.withColumn("met", F.count("*").over(Window.partitionBy("key"))).filter("met > 1")
    # What is left of half the radius is spent inside the block that was left out.
    rest, start = [], 0
    for size in blocks:
        own = list(range(start, start + size))
        start += size
        rest.append([_balls(own, half - spent) for spent in range(first + 1)])
    spent = F.bit_count("mask")
    onward = F.coalesce(
        *[
            F.when((F.col("block") == b) & (spent == s), F.array(*[F.lit(m).cast("bigint") for m in rest[b][s]]))
            for b in range(len(blocks))
            for s in range(first + 1)
        ]
    )
    words = met.select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("base"), F.explode(onward).alias("more")
    ).select("fp", F.col("base").bitwiseXOR(F.col("more")).alias("word"))
    before = F.lag("fp").over(Window.partitionBy("word").orderBy("fp"))
    return (
        words.select("fp", before.alias("before"))
        .filter("before <> fp")
        .select(F.col("before").alias("a"), F.col("fp").alias("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, key: Column | None = None
) -> DataFrame:
    """(doc_id, fp, component_id): the component's smallest doc_id, for every row."""
    printed = cut_lineage(fingerprints(docs, width, key))[0]
    fps = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), radius))
    named = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    named = cut_lineage(named)[0]
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = join_keyed(named, ids, "root", "inner").select("fp", "component_id")
    return printed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group, with its columns as they were.

    The row with the smallest doc_id stays.  A row without doc_id is named by its
    text's digest and stays only if its group has no id.  Of rows that repeat a
    doc_id within a group the one with the smallest text stays, and of equal texts the one whose
    other columns have the smallest digest.  Columns may have any names.
    """
    nameless = F.concat(F.lit("~"), F.sha2(F.coalesce("text", F.lit("")), 256))
    # Digits of equal length, so that the order of the names is that of the ids.
    shifted = F.expr("CAST(CAST(doc_id AS DECIMAL(20, 0)) + 9223372036854775808 AS STRING)")
    named = F.lpad(shifted, 20, "0")
    key = F.coalesce(named, nameless)
    groups = near_duplicates(docs, width, radius, key)
    own, rest = free_name("_kept", docs.columns), free_name("_rest", docs.columns)
    chosen = groups.select(F.col("component_id").alias(own)).distinct()
    whole = [F.col(f"`{column}`") for column in docs.columns]
    marked = docs.withColumns({own: key, rest: F.xxhash64(*whole)}).join(chosen, own, "left_semi")
    first = F.min_by(F.struct(*whole), F.struct("text", rest)).alias(rest)
    return marked.groupBy(own).agg(first).select(f"{rest}.*")
