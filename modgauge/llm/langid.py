"""Language of texts by a convolutional network over bytes, trained in numpy.

A text is cut into windows of WINDOW bytes, from its first byte to its last; the last window is
filled up with zero bytes.  Filters of several widths read the window: a filter of width w has a weight for
every byte at each of its w places, so its value at a position is the sum of w looked-up numbers.  Each
filter keeps its largest value over the window (max pooling), values below zero count as zero, and a
softmax layer turns them into probabilities of the languages.  A text's probabilities are the mean
over its windows, weighted by their bytes; the largest is the prediction, a tie goes to the
smaller name.

Training takes a bounded sample of labelled texts: TRAIN_TEXTS different texts of each
language at most, by a hash of the text, and of each WINDOWS_PER_TEXT windows at most, spread over the whole
text.  Windows are cut where the texts lie, so one task fits the network (Adam on cross-entropy, every
language weighing the same) on a bounded number of bytes.  Prediction is one pass over all texts in Arrow batches,
a bounded number of windows at a time.

A null text, or one without a letter, is `und` with score 0; so is every text when no language could be
learned.  Rows without language, and texts without a letter, teach nothing.  A null id counts as the empty string where
rows are split by id.  Repeated rows are predicted alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modgauge.llm.text import flat
from modgauge.operators.topk import first_k_per_group
from modgauge.runtime import written

UNKNOWN = "und"

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width

_SIZE = len(WIDTHS) * FILTERS
_REACH = max(WIDTHS) - 1
# The first filter that reads the byte j places on; filters stand in the order of their widths.
_FIRST = [FILTERS * sum(w <= j for w in WIDTHS) for j in range(_REACH + 1)]

# The bounds of the training sample.
TRAIN_TEXTS = 500
WINDOWS_PER_TEXT = 6

EPOCHS = 4
BATCH = 64
SEED = 20240607

# Windows whose filter values are in memory at a time.
_AT_ONCE = 16

# Rows of the sample's keys that may be broadcast; beyond, they are joined by shuffle.
_BROADCAST_ROWS = 500_000


@dataclass
class Network:
    """tables[j] is (256, filters that read the byte j places on); dense has a row more for the bias."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        tables = [rng.normal(0, 0.15, (256, _SIZE - first)) for first in _FIRST]
        dense = rng.normal(0, 1 / np.sqrt(_SIZE), (_SIZE + 1, len(langs)))
        parts = [*tables, np.zeros(_SIZE), dense]
        *tables, bias, dense = (p.astype(np.float32) for p in parts)
        return cls(langs, tables, bias, dense)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense]

    def to_bytes(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parameters())

    @classmethod
    def from_bytes(cls, langs: list[str], held: bytes) -> Network:
        own, at = cls.fresh(langs), 0
        for p in own.parameters():
            p[...] = np.frombuffer(held, np.float32, p.size, at).reshape(p.shape)
            at += p.nbytes
        return own

    def values(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, filters) values of the filters, byte by byte."""
        total = np.take(self.tables[0], windows[:, :WINDOW], axis=0)
        for j in range(1, _REACH + 1):
            total[..., _FIRST[j] :] += np.take(self.tables[j], windows[:, j : j + WINDOW], axis=0)
        return total

    def gradients(self, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted cross-entropy; only the position that a filter kept has a part in it."""
        values = self.values(windows)
        place = values.argmax(axis=1)
        raw = np.take_along_axis(values, place[:, None], axis=1)[:, 0] + self.bias
        hidden = np.maximum(raw, 0)
        error = _softmax(hidden @ self.dense[:-1] + self.dense[-1])
        error[np.arange(len(label)), label] -= 1
        error *= weight[:, None]
        dense = np.concatenate([hidden.T @ error, error.sum(axis=0, keepdims=True)])
        back = (error @ self.dense[:-1].T) * (raw > 0)
        rows = np.arange(len(windows))[:, None]
        tables = []
        for j, first in enumerate(_FIRST):
            size = _SIZE - first
            byte = windows[rows, place[:, first:] + j].astype(np.int64)
            slot = (byte * size + np.arange(size)).ravel()
            tables.append(np.bincount(slot, back[:, first:].ravel(), 256 * size).reshape(256, size))
        return [*tables, back.sum(axis=0), dense]


class Reader:
    """A trained network with tables over pairs of bytes, so that half the look-ups do."""

    def __init__(self, network: Network):
        self.network = network
        self.pairs = []  # (places on, table over two bytes with a column for every filter)
        for j in range(0, _REACH + 1, 2):
            both = np.zeros((256, 256, _SIZE), np.float32)
            both[:, :, _FIRST[j] :] += network.tables[j][:, None]
            if j < _REACH:
                both[:, :, _FIRST[j + 1] :] += network.tables[j + 1][None]
            self.pairs.append((j, both.reshape(-1, _SIZE)))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        network = self.network
        best = np.empty((len(windows), _SIZE), np.float32)
        padded = np.pad(windows, ((0, 0), (0, 1))).astype(np.int64)
        pair = padded[:, :-1] << 8 | padded[:, 1:]
        for i in range(0, len(windows), _AT_ONCE):
            # Positions first: sums and maxima then run over contiguous numbers.
            own = np.ascontiguousarray(pair[i : i + _AT_ONCE].T)
            total = None
            for j, table in self.pairs:
                found = np.take(table, own[j : j + WINDOW], axis=0, mode="clip")
                total = found if total is None else np.add(total, found, out=total)
            best[i : i + _AT_ONCE] = total.max(axis=0)
        hidden = np.maximum(best + network.bias, 0).astype(np.float64)
        # Filter by filter: a matrix product's sums would depend on how many windows there are.
        z = np.tile(network.dense[-1].astype(np.float64), (len(windows), 1))
        for value, weights in zip(hidden.T, network.dense[:-1].astype(np.float64), strict=True):
            z += value[:, None] * weights
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(langs: list[str], windows: np.ndarray, label: np.ndarray) -> Network:
    """Adam over shuffled batches, the same in every process."""
    own = Network.fresh(langs)
    rng = np.random.default_rng(SEED)
    sizes = np.bincount(label, minlength=len(langs))
    weight = (len(label) / len(langs) / np.maximum(sizes, 1))[label].astype(np.float32)
    mean = [np.zeros_like(p) for p in own.parameters()]
    square = [np.zeros_like(p) for p in own.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 / (1 + epoch)
        order = rng.permutation(len(label))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            step += 1
            found = own.gradients(windows[rows], label[rows], weight[rows] / len(rows))
            for p, g, m, s in zip(own.parameters(), found, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return own


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(windows, WINDOW + _REACH) bytes from `starts`, zero from `ends` on."""
    place = starts[:, None] + np.arange(WINDOW + _REACH)
    inside = place < ends[:, None]
    return np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sample_windows(texts: DataFrame) -> DataFrame:
    """(lang, hash, place, window): some windows of each text, evenly spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            rows, places, found = [], [], []
            for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                many = -(-(end - start) // WINDOW)
                few = min(many, WINDOWS_PER_TEXT)
                for place in sorted({i * many // few for i in range(few)}):
                    at = start + place * WINDOW
                    rows.append(row)
                    places.append(place)
                    found.append(data[at : min(at + WINDOW, end)].tobytes())
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own),
                    batch.column(1).take(own),
                    pa.array(places, pa.int64()),
                    pa.array(found, pa.binary()),
                ],
                ["lang", "hash", "place", "window"],
            )

    return texts.select("lang", "hash", "text").mapInArrow(
        run, "lang string, hash bigint, place bigint, window binary"
    )


def train(docs: DataFrame, lang: Column, text: Column, may_learn: Column) -> Network | None:
    """The network, from rows where `may_learn` holds; None where no row teaches a language."""
    known = docs.select(
        lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("hash"), may_learn.alias("ok")
    ).filter(F.col("ok") & F.col("lang").isNotNull() & has_letter(F.col("text")))
    # A text counts once however often it is repeated.
    keys = known.groupBy("lang", "hash").agg(F.count("*").alias("copies"))
    keys, seen = written(
        first_k_per_group(keys, ["lang"], [F.asc("hash")], TRAIN_TEXTS, ["hash"]).select("lang", "hash"),
        rows=F.count("*"),
    )
    if seen["rows"] <= _BROADCAST_ROWS:
        keys = F.broadcast(keys)
    cut = _sample_windows(known.join(keys, ["lang", "hash"]))
    cut = cut.groupBy("lang", "hash", "place").agg(F.min("window").alias("window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(column.to_pylist() for column in batch.columns), strict=True)
        if not rows:
            return
        rows.sort()
        langs = sorted({row[0] for row in rows})
        number = {name: i for i, name in enumerate(langs)}
        data = b"".join(row[3].ljust(WINDOW + _REACH, b"\0") for row in rows)
        windows = np.frombuffer(data, np.uint8).reshape(-1, WINDOW + _REACH)
        own = fit(langs, windows, np.array([number[row[0]] for row in rows]))
        yield pa.RecordBatch.from_pydict({"langs": [langs], "weights": [own.to_bytes()]})

    found = cut.coalesce(1).mapInArrow(run, "langs array<string>, weights binary").collect()
    # One row: some hundred thousand numbers, and as many columns as languages.
    return Network.from_bytes(list(found[0].langs), bytes(found[0].weights)) if found else None


def _judged(reader: Reader, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages) mean probabilities; texts must hold a byte."""
    many = -(-np.diff(offsets) // WINDOW)
    total = np.zeros((len(many), len(reader.network.langs)))
    owner = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    starts = offsets[:-1][owner] + nth * WINDOW
    ends = np.minimum(starts + WINDOW, offsets[1:][owner])
    for first in range(0, len(owner), 16 * _AT_ONCE):
        part = slice(first, first + 16 * _AT_ONCE)
        p = reader.probabilities(windows_of(data, starts[part], ends[part]))
        np.add.at(total, owner[part], p * (ends[part] - starts[part])[:, None])
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def predict(docs: DataFrame, text: Column, network: Network | None, *kept: str) -> DataFrame:
    """(*kept, lang_pred, score) of every row."""
    if network is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        langs = pa.array([*network.langs, UNKNOWN], pa.string())
        for batch in batches:
            data, offsets = flat(batch.column(0))
            spoken = np.diff(offsets) > 0
            best = np.full(batch.num_rows, len(network.langs))
            score = np.zeros(batch.num_rows)
            if spoken.any():
                # Silent texts have no bytes, so the others' bytes lie side by side.
                found = _judged(reader, data, np.append(offsets[:-1][spoken], offsets[-1]))
                best[spoken] = found.argmax(axis=1)
                score[spoken] = np.clip(found.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], langs.take(pa.array(best)), pa.array(score)],
                [*kept, "lang_pred", "score"],
            )

    heard = F.when(has_letter(text), text).otherwise(F.lit("")).alias("_text")
    chosen = docs.select(heard, *kept)
    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[1:])
    return chosen.mapInArrow(run, f"{held}lang_pred string, score double")


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents, trained on the other folds' languages."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    network = train(rows, F.col("lang"), F.col("text"), ~F.col("held_out"))
    return predict(rows, F.col("text"), network, "doc_id", "held_out")
