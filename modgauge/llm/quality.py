"""Quality rules: fixed counts, and a calibrated logistic regression on hashed n-grams.

Every text gives four groups of n-grams: words, word pairs, 3 and 5 neighbouring
characters.  They are hashed to GROUP_SIZE slots a group, and a group's features are the
shares of its slots.  A logistic regression is trained on a bounded sample of
labelled rows (TRAIN_ROWS and TRAIN_BYTES for each class at most, taken by a hash of the id), three quarters
for the weights; on the rest, a slope and an offset make its output a probability at
the class shares of all labelled rows (Platt scaling).  Scoring is one pass in Arrow batches.

Null text counts as empty: it has no words and fails the base rule.  Labels that
are null, name no id, or contradict each other are left out of training.  With no
label of one class there is no model, and the base rule alone decides.  Repeated rows
are judged alike.  Extra columns of `docs` are kept by `judge`; the results come back in one
column, whose name the caller may choose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from modgauge.llm.text import SPACE, blocks, flat, texts

# Fixed values of the rules.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
KEEP_AT = 0.5  # least probability of good quality

# The bounds of the training sample, for each class.
TRAIN_ROWS = 1500
TRAIN_BYTES = 16 << 20

# Slots of training texts that are in memory as products at a time.
_SLOTS = 1 << 18

# Bytes of text that are judged at a time: numpy holds about a hundred times as much meanwhile.
JUDGE_BYTES = 1 << 18

GROUP_SIZE = 1 << 16
GROUPS = 4
SCALE = 4.0
EPOCHS = 60

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, quality double"
)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x100000001B3
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Model:
    """Weights by slot, and the slope and offset that calibrate their sum."""

    weights: np.ndarray
    slope: float
    offset: float


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD
    h = (h ^ (h >> np.uint64(32))) * _ODD2
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            size = max(n, 2 * JUDGE_BYTES)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Block:
    """Word hashes and n-gram slots of the texts of one block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.docs = len(offsets) - 1
        space = SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        solid = ~space
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = space[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = space[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        up, down = _powers.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = _mixed((sums[ends] - sums[self.starts]) * down[self.starts])
        # Words before each text's start; a text's words are [words[i], words[i+1]).
        self.words = np.searchsorted(self.starts, offsets)
        self.solid, self.ends = solid, ends

    def word_numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words and no others."""
        begin = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(begin), pa.py_buffer(self.data[self.solid])]
        )
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, and where each text begins."""
        view = self.data.tobytes()
        cuts = self.offsets.tolist()
        parts = [view[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        begin = np.cumsum([0, *(len(part) // 4 for part in parts)])
        return np.frombuffer(b"".join(parts), np.uint32), begin

    def counted(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def repeated_words(self) -> np.ndarray:
        """Words of each text inside a window that the text holds twice or more."""
        n = len(self.starts)
        found = np.zeros(self.docs, np.int64)
        if n < WINDOW:
            return found
        text_of = np.repeat(np.arange(self.docs), np.diff(self.words))
        # Runs of 2, 4 and 8 words are numbered from pairs of runs half as long.
        keys, size = self.word_numbers(), 1
        while size < WINDOW:
            pairs = keys[:-size] * (n + 1) + keys[size:]
            keys, size = np.unique(pairs, return_inverse=True)[1], 2 * size
        within = np.flatnonzero(text_of[: n - WINDOW + 1] == text_of[WINDOW - 1 :])
        keys = keys[within] * (self.docs + 1) + text_of[within]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(n + 1, np.int64)
        first = within[twice]
        np.add.at(change, first, 1)
        np.add.at(change, first + WINDOW, -1)
        covered = np.zeros(n + 1, np.int64)
        np.cumsum(np.cumsum(change[:-1]) > 0, out=covered[1:])
        return covered[self.words[1:]] - covered[self.words[:-1]]

    def slots(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each group: slots in order, and each text's first and last of them."""
        h = self.hashes
        shift = np.uint64(64 - 16)
        out = [((h >> shift).astype(np.int64), self.words[:-1], self.words[1:])]
        pairs = (_mixed(h[:-1] * _ODD + h[1:]) >> shift).astype(np.int64)
        last = np.maximum(self.words[1:] - 1, self.words[:-1])
        out.append((pairs, self.words[:-1], last))
        points, begin = self.characters()
        for n in (3, 5):
            size = max(0, len(points) - n + 1)
            grams = np.zeros(size, np.uint64)
            for j in range(n):
                grams = grams * np.uint64(_BASE) + points[j : j + size].astype(np.uint64)
            grams = _mixed(grams) >> shift
            out.append((grams.astype(np.int64), begin[:-1], np.maximum(begin[1:] - n + 1, begin[:-1])))
        return [(slots + g * GROUP_SIZE, a, b) for g, (slots, a, b) in enumerate(out)]


def _scores(block: Block, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(block.docs)
    for slots, first, last in block.slots():
        n = len(slots)
        sums = np.zeros(n + 1)
        np.cumsum(weights[slots], out=sums[1:])
        found = sums[np.minimum(last, n)] - sums[np.minimum(first, n)]
        total += found * SCALE / np.maximum(last - first, 1)
    return total


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of one text and their shares."""
    block = Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    slots, shares = [], []
    for found, first, last in block.slots():
        own, counts = np.unique(found[first[0] : last[0]], return_counts=True)
        slots.append(own)
        shares.append(counts * (SCALE / max(1, counts.sum())))
    return np.concatenate(slots).astype(np.int32), np.concatenate(shares).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: list[tuple[int, bytes, int]], good_share: float) -> Model:
    """Full-batch Adam on three rows of four, calibration on the others.  Empties `rows`."""
    rows.sort()
    held = np.arange(len(rows)) % 4 == 3
    label = np.array([quality for _, _, quality in rows], float)
    # Slots and shares of all rows, one after another.  A text has fewer n-grams than this, and room that is
    # not written to takes no memory; arrays of this size go back to the system when the model is done.
    room = sum(3 * len(text) + 2 for _, text, _ in rows)
    slots, shares = np.empty(room, np.int32), np.empty(room, np.float32)
    ends = np.zeros(len(rows) + 1, np.int64)
    for i, (_, text, _) in enumerate(rows):
        own, part = _features(text)
        ends[i + 1] = ends[i] + len(own)
        slots[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]] = own, part
    rows.clear()
    # Runs of rows of about _SLOTS slots: only one run's products are in memory at a time.
    run = ends[1:] // _SLOTS
    edges = np.flatnonzero(np.diff(run, prepend=-1, append=run[-1] + 1)).tolist()

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            owner = np.repeat(np.arange(first, last, dtype=np.int32), np.diff(ends[first : last + 1]))
            yield owner, slots[ends[first] : ends[last]], shares[ends[first] : ends[last]]

    def sums(weights: np.ndarray) -> np.ndarray:
        z = np.zeros(len(label))
        for owner, at, share in runs():
            z += np.bincount(owner, share * weights[at], len(label))
        return z

    # Every class weighs the same while the weights are fitted.
    balance = np.zeros(len(label))
    for side in (0, 1):
        chosen = (label == side) & ~held
        balance[chosen] = 0.5 / max(1, chosen.sum())
    weights = np.zeros(GROUPS * GROUP_SIZE)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, EPOCHS + 1):
        error = balance * (_sigmoid(sums(weights)) - label)
        gradient = np.zeros_like(weights)
        for owner, at, share in runs():
            gradient += np.bincount(at, share * error[owner], len(weights))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.3 / (1 + step / 20)
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    z = sums(weights)
    # Platt scaling on the held-out rows, weighted to the shares of all labels.
    check = held if len(set(label[held])) == 2 else np.ones(len(label), bool)
    z, label = z[check], label[check]
    share = np.where(label == 1, good_share, 1 - good_share)
    sizes = np.where(label == 1, (label == 1).sum(), (label == 0).sum())
    mass = share / sizes
    target = np.where(label == 1, 1 - 1 / (sizes + 2), 1 / (sizes + 2))
    spread = max(z.std(), 1e-6)
    slope, offset = 1 / spread, 0.0
    for _ in range(50):  # Newton
        p = _sigmoid(slope * z + offset)
        g = np.array([(mass * (p - target) * z).sum(), (mass * (p - target)).sum()])
        w = mass * p * (1 - p)
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]])
        h += np.diag([1e-4 * spread**2, 1e-4])
        move = np.linalg.solve(h, g)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return Model(weights.astype(np.float32), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None where one class has no labelled text."""
    known = (
        labels.select("doc_id", "quality")
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .select("doc_id", "quality")
    )
    shares = dict(known.groupBy("quality").count().collect())
    if len(shares) < 2:
        return None
    order = F.xxhash64("doc_id")
    sample = None
    for side in (0, 1):
        part = known.filter(F.col("quality") == side).orderBy(order, "doc_id").limit(TRAIN_ROWS)
        sample = part if sample is None else sample.unionByName(part)
    good_share = shares[1] / (shares[0] + shares[1])
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # As many of a class as TRAIN_BYTES hold, in the order of the hash.
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    held = size.over(Window.partitionBy("quality").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("held", held).filter(F.col("held") <= TRAIN_BYTES).select("doc_id", "text", "quality")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, quality = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows += zip(ids, texts(batch.column(1)), quality, strict=True)
        if len({row[2] for row in rows}) == 2:
            model = _fit(rows, good_share)
            yield pa.RecordBatch.from_pydict(
                {"weights": [model.weights.tobytes()], "slope": [model.slope], "offset": [model.offset]}
            )

    found = (
        chosen.coalesce(1)
        .mapInArrow(fit, "weights binary, slope double, offset double")
        .collect()  # one row of fixed size
    )
    if not found:
        return None
    row = found[0]
    return Model(np.frombuffer(bytes(row.weights), np.float32), row.slope, row.offset)


def judge(
    docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, into: str = "judged"
) -> DataFrame:
    """Every row of `docs` with all its columns, and the columns of RESULT in `into`."""
    columns = docs.columns
    if into.lower() in {column.lower() for column in columns}:
        raise ValueError(f"the rows have a column {into!r} of their own")
    fields = pa.schema(
        [
            (name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind])
            for name, kind in (part.split() for part in RESULT.split(", "))
        ]
    )
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judged_column(batch.column(at), model, keep_at)
            arrays = [pa.array(values, field.type) for values, field in zip(found, fields, strict=True)]
            judged = pa.StructArray.from_arrays(arrays, fields=list(fields))
            yield pa.RecordBatch.from_arrays([*batch.columns, judged], [*columns, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    inner = ", ".join(part.replace(" ", ": ") for part in RESULT.split(", "))
    return docs.mapInArrow(run, f"{schema}, `{into}` struct<{inner}>")


def _judged_column(column: pa.Array, model: Model | None, keep_at: float) -> list[np.ndarray]:
    """The columns of RESULT for a column of texts, a block at a time."""
    data, offsets = flat(column)
    parts = []
    for first, last in blocks(offsets, JUDGE_BYTES):
        start, end = offsets[first], offsets[last]
        parts.append(_judged(data[start:end], offsets[first : last + 1] - start, model, keep_at))
    return [np.concatenate(values) for values in zip(*parts, strict=True)] or [[]] * len(RESULT.split(", "))


def _judged(data, offsets, model, keep_at) -> list[np.ndarray]:
    block = Block(data, offsets)
    n_words = np.diff(block.words)
    chars = block.counted(block.solid & (data & 0xC0 != 0x80))
    symbols = block.counted(_IS_SYMBOL[data])
    view = data.tobytes()
    ends = offsets.tolist()
    dup = np.array([_dup_lines(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
    repeated = block.repeated_words()
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    if model is None:
        quality = np.where(failed, 0.0, 1.0)
    else:
        quality = _sigmoid(model.slope * _scores(block, model.weights) + model.offset)
    kept = ~failed & (quality >= keep_at)
    return [n_words, chars, symbols, dup, repeated, failed, kept, quality]
