"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and a piece into words
between spaces and tabs.  A phrase is a run of words within a piece.  It is frequent if it occurs
at least `least` times among the texts of one language, overlaps included.

Mining.  A sample, one document in SAMPLE by the hash of its id, proposes phrases: those with at least their
share of `least` there.  What a full pass counts is the proposed phrases and their negative border:
phrases that are not proposed though both their shorter parts (all words but the last, all but
the first) are.  So the first pass counts every word, pairs of proposed words and, for three words,
phrases both of whose pairs are proposed.  A frequent phrase of the border is a failure of the sample:
phrases around it were not counted.  It joins the proposals, and another full pass
counts the border that this opens, and nothing counted before, until no border phrase fails.
There are at most as many passes as words in a phrase.

These passes count phrases by 64-bit hashes, as most phrases of a border are rare and their words need not
travel.  Two phrases on one hash can only raise a count, so no frequent phrase is missed.
A last pass takes up the words of those phrases whose hash is frequent and counts
them as they are, so all counts that leave this module are exact.

Sets of phrases reach the tasks as one bit set of SLOT_BITS bits for each length, by the hash.  Its size is
fixed; two phrases on one bit make a border larger, never smaller, so
however many phrases there are, none is lost.  Words are cut and joined in Arrow batches, a block of BLOCK_BYTES at a
time; equal phrases of a block are one row, and Spark adds these up before and after the shuffle.

Null text counts as empty; a null language is `und`.  Repeated rows count again.
Ties in the order go to the larger count, then to the smaller phrase in bytes.  An empty table has no
phrases.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from modgauge.llm.text import LOWER, flat
from modgauge.operators.skew import join_keyed
from modgauge.operators.topk import first_k_per_group
from modgauge.runtime import written

# Fixed values of the task.
WORDS = 3
LEAST = 10
DROP_PERCENT = 50
TOP = 2000
NO_LANG = "und"

# One document in so many proposes.
SAMPLE = 4
# Size of the bit set of each phrase length, as a power of two.
SLOT_BITS = 25
# Bytes of text that are counted at a time.
BLOCK_BYTES = 2 << 20

# Bytes between pieces; "." stands for all of them, as it is no part of a word, and a space for a tab.
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPACE, _DOT = ord(" "), ord(".")
_PIECES = bytes(_DOT if c in _CUTS else _SPACE if c == 0x09 else LOWER[c] for c in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


class Proposals:
    """For each phrase length a bit set over hashes; a length without one has no proposals."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.sets = sets

    def holds(self, length: int, slots: np.ndarray) -> np.ndarray:
        bits = self.sets.get(length)
        if bits is None:
            return np.zeros(len(slots), bool)
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _stretches(lang_texts: Iterable[bytes]) -> Iterator[bytes]:
    """Texts joined and cut to about BLOCK_BYTES, always between pieces."""
    held, size = [], 0
    for text in lang_texts:
        marked = text.translate(_PIECES)
        first = 0
        while len(marked) - first > BLOCK_BYTES:
            cut = marked.find(b".", first + BLOCK_BYTES)
            if cut < 0:
                break
            yield marked[first:cut]
            first = cut
        held.append(marked[first:])
        size += len(marked) - first
        if size >= BLOCK_BYTES:
            yield b".".join(held)
            held, size = [], 0
    if held:
        yield b".".join(held)


class _Level:
    """Phrases of one length in a block: texts, hashes, counts, and which one stands at each place.

    `at` is -1 where none stands.  `before` tells which were counted by an earlier pass.
    """

    def __init__(self, at, texts, hashes, counts, before):
        self.at, self.texts, self.hashes = at, texts, hashes
        self.counts, self.before = counts, before
        self.slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def places(self, chosen: np.ndarray) -> np.ndarray:
        """Where a chosen phrase stands and another one at the next place."""
        found = np.zeros(len(self.at), bool)
        here = self.at >= 0
        found[here] = chosen[self.at[here]]
        return found[:-1] & found[1:]


def _words(stretch: bytes, seed: int, before: bool) -> _Level:
    # Words side by side without the spaces; a "." is a word of its own.
    data = np.frombuffer(stretch, np.uint8)
    solid, dot = data != _SPACE, data == _DOT
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | dot[:-1] | dot[1:]
    held = data[solid]
    offsets = np.append(np.flatnonzero(begins[solid]), len(held)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(held)]
    coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers).dictionary_encode()
    listed = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(at, minlength=len(listed))
    if b"." in listed:
        cut = listed.index(b".")
        counts[cut] = 0
        at[at == cut] = -1
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in listed], np.uint64)
    return _Level(at, coded.dictionary, hashes, counts, np.full(len(listed), before))


def _longer(words: _Level, level: _Level, wanted: np.ndarray, before: np.ndarray) -> _Level:
    """Phrases one word longer, at the places where `wanted` holds."""
    place = np.flatnonzero(wanted)
    # A phrase is all its words but the last, and the last.
    last = words.at[place + len(words.at) - len(wanted)]
    coded = pa.array(level.at[place] * len(words.hashes) + last).dictionary_encode()
    keys = coded.dictionary.to_numpy(zero_copy_only=False)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = keys // len(words.hashes), keys % len(words.hashes)
    at = np.full(len(wanted), -1, np.int64)
    at[place] = which
    known = np.zeros(len(keys), bool)
    known[which] = before[place]
    texts = pc.binary_join_element_wise(
        level.texts.take(pa.array(start)),
        words.texts.take(pa.array(end)),
        pa.scalar(b" ", pa.binary()),
    )
    hashes = _mixed(level.hashes[start] * _ODD + words.hashes[end])
    return _Level(at, texts, hashes, np.bincount(which, minlength=len(keys)), known)


def _levels(
    stretch: bytes, seed: int, most: int, old: Proposals | None, new: Proposals | None
) -> Iterator[tuple[int, _Level, np.ndarray]]:
    """(length, phrases, which are proposed) of a block, as far as the proposals open them.

    Without `new`, in the sample, all phrases are opened.  `old` are the proposals of the passes before.
    """
    words = level = _words(stretch, seed, old is not None)
    for length in range(1, most + 1):
        n = len(level.slots)
        proposed = new.holds(length, level.slots) if new else np.ones(n, bool)
        yield length, level, proposed
        if length == most or len(level.at) < 2:
            return
        opened = level.before & old.holds(length, level.slots) if old else np.zeros(n, bool)
        level = _longer(words, level, level.places(proposed), level.places(opened))


def _by_block(
    docs: DataFrame, schema: str, rows, most: int, old: Proposals | None, new: Proposals | None
) -> DataFrame:
    """rows(lang, levels) of every block of one language's texts."""
    sent = docs.sparkSession.sparkContext.broadcast((old, new))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = sent.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            view = memoryview(data)
            by_lang: dict[str, list[int]] = {}
            for row, lang in enumerate(batch.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(row)
            for lang, own in by_lang.items():
                seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
                for stretch in _stretches(bytes(view[offsets[i] : offsets[i + 1]]) for i in own):
                    if stretch.strip(b" ."):
                        yield from rows(lang, _levels(stretch, seed, most, old, new))

    return docs.select("lang", "text").mapInArrow(run, schema)


# A counted key is a hash whose low bits hold the phrase's length and whether it was proposed.
_LENGTH, _PROPOSED = 7, 8


def _counts(
    docs: DataFrame, most: int, old: Proposals | None = None, new: Proposals | None = None
) -> DataFrame:
    """(length, slot, proposed, n) for each hash of all that one pass counts, over all of `docs`."""

    def rows(_: str, levels) -> Iterator[pa.RecordBatch]:
        for length, level, proposed in levels:
            kept = (level.counts > 0) & ~level.before
            marks = length + _PROPOSED * proposed[kept].astype(np.uint64)
            keys = level.hashes[kept] & ~np.uint64(_LENGTH + _PROPOSED) | marks.astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(level.counts[kept], pa.int64())], ["key", "n"]
            )

    counted = _by_block(docs, "key bigint, n bigint", rows, most, old, new)
    return counted.groupBy("key").agg(F.sum("n").alias("n")).selectExpr(
        f"CAST(key & {_LENGTH} AS INT) AS length",
        f"shiftrightunsigned(key, {64 - SLOT_BITS}) AS slot",
        f"key & {_PROPOSED} <> 0 AS proposed",
        "n",
    )


def _named(docs: DataFrame, most: int, chosen: Proposals) -> DataFrame:
    """(lang, length, phrase, n) of all chosen phrases; length 0 holds how many words a language has."""

    def table(lang, length, phrases, counts) -> pa.RecordBatch:
        fixed = [pa.scalar(lang, pa.string()), pa.scalar(length, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*(pa.repeat(x, len(phrases)) for x in fixed), phrases, pa.array(counts, pa.int64())],
            ["lang", "length", "phrase", "n"],
        )

    def rows(lang: str, levels) -> Iterator[pa.RecordBatch]:
        for length, level, wanted in levels:
            if length == 1:
                yield table(lang, 0, pa.array([b""], pa.binary()), [level.counts.sum()])
            kept = (level.counts > 0) & wanted
            yield table(lang, length, level.texts.filter(pa.array(kept)), level.counts[kept])

    named = _by_block(docs, "lang string, length int, phrase binary, n bigint", rows, most, None, chosen)
    return (
        named.groupBy("lang", "length", "phrase")
        .agg(F.sum("n").alias("n"))
        .withColumn("phrase", F.col("phrase").cast("string"))
    )


# Bits of one map that bitmap_construct_agg gathers.
_MAP_BITS = 1 << 15


def _with(known: Proposals | None, phrases: DataFrame, longest: int) -> Proposals:
    """The known proposals and `phrases`: a bit for each, gathered as bit maps."""
    empty = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    sets = {i: known.sets[i].copy() if known else empty.copy() for i in range(1, longest + 1)}
    place = (F.col("slot") % _MAP_BITS).alias("place")
    maps = (
        phrases.select("length", F.floor(F.col("slot") / _MAP_BITS).alias("map"), place)
        .groupBy("length", "map")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    for row in maps.collect():  # at most 2^SLOT_BITS bits for each length
        first = row.map * (_MAP_BITS // 8)
        sets[row.length][first : first + _MAP_BITS // 8] |= np.frombuffer(bytes(row.bits), np.uint8)
    return Proposals(sets)


def frequent(
    docs: DataFrame, lang: Column, text: Column, key: Column, least: int = LEAST, words: int = WORDS
) -> DataFrame:
    """(lang, length, phrase, n): all phrases of up to `words` words that occur `least` times or more.

    Length 0 holds how many words a language has.  `words` is 7 at most.  `key` tells documents apart for the sample.
    """
    lang = F.coalesce(lang.cast("string"), F.lit(NO_LANG))
    texts = docs.select(lang.alias("lang"), F.coalesce(text, F.lit("")).alias("text"), key.alias("key"))
    sample = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)
    # The sample's share of `least`, rounded down so that few frequent phrases are missed.
    proposed = _counts(sample, words - 1).filter(F.col("n") >= max(1, least // SAMPLE))
    old, new = None, _with(None, proposed, words - 1)
    counted = []
    while True:
        failed = ~F.col("proposed") & (F.col("length") < words)
        table, seen = written(
            _counts(texts, words, old, new).filter(F.col("n") >= least), failures=F.count_if(failed)
        )
        counted.append(table)
        if not seen["failures"]:
            break
        old, new = new, _with(new, table.filter(failed), words - 1)
    chosen = _with(None, reduce(DataFrame.unionByName, counted), words)
    exact = _named(texts, words, chosen).filter((F.col("n") >= least) | (F.col("length") == 0))
    return written(exact, rows=F.count("*"))[0]


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, l, r): the lowest-scoring cut of every candidate, exactly."""
    cuts = candidates.selectExpr(
        "lang", "phrase", "n AS a", "explode(sequence(1, length - 1)) AS k"
    ).selectExpr(
        "lang",
        "phrase",
        "a",
        "k",
        "struct(lang, substring_index(phrase, ' ', k) AS phrase) AS start",
        "struct(lang, substring(phrase, 2 + length(substring_index(phrase, ' ', k))) AS phrase) AS rest",
    )
    # A common word begins or ends very many phrases.
    cuts = join_keyed(cuts, counts.selectExpr("part AS start", "n AS l"), "start", "inner")
    cuts = join_keyed(cuts, counts.selectExpr("part AS rest", "n AS r"), "rest", "inner")
    big = "CAST({} AS DECIMAL(38, 0))".format
    score = f"{big(1000000)} * {big('a')} * {big('a')} DIV ({big('l')} * {big('r')})"
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (
        cuts.withColumn("score", F.expr(score))
        .groupBy("lang", "phrase", "a")
        .agg(lowest)
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    )


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate that holds the phrase."""
    parts = """
        flatten(transform(sequence(2, length - 1), w ->
          transform(sequence(1, length - w + 1), i -> array_join(slice(split(phrase, ' '), i, w), ' '))))
    """
    return (
        candidates.filter("length > 2")
        .selectExpr("lang", f"explode({parts}) AS phrase", "n")
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )


def collocations(
    docs: DataFrame,
    lang: Column,
    text: Column,
    key: Column,
    least: int = LEAST,
    words: int = WORDS,
    drop_percent: int = DROP_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two words and more.

    A phrase of a occurrences is cut where a * a / (l * r) is lowest, l and r being the counts of the two
    parts; ties go to the first cut.  A phrase inside a longer one that has drop_percent of its
    occurrences or more is left out.
    """
    found = frequent(docs, lang, text, key, least, words)
    candidates = found.filter("length >= 2")
    counts = found.filter("length >= 1").selectExpr("struct(lang, phrase) AS part", "n")
    covered = F.lit(100) * F.col("longer") >= F.lit(drop_percent) * F.col("a")
    left = (
        _scored(candidates, counts)
        .join(_inside(candidates), ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | ~covered)
        .drop("longer")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_k_per_group(left, ["lang"], order, top, ["phrase"])
    totals = found.filter("length = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
