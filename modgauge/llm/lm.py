"""Log-bilinear language model trained by noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased, and one end after them.  Three
passes over the texts, all of them whole:

1. Every word is counted (maps add up locally, one shuffle).
2. The most frequent words, the end among them, and CLASSES classes for all other words form the
   model's vocabulary of VOCAB; a word's class is the hash of its last bytes, so every
   word has one, seen or not.  The pairs of neighbours in the vocabulary are counted over all
   training texts.  A log-bilinear model predicts a token from the one before it:
   score(w | v) = (R_v T) . Q_w + b_w.  It is trained in numpy by noise-contrastive
   estimation against unigram noise.  The noise is taken in expectation instead of by draws, so
   each step is a few matrix products over the pair counts and every training token counts.
3. One more matrix product gives the normalised log-probabilities of all tokens
   in all contexts, which each worker builds for itself and texts are scored by.

A word of a class has the probability of the class times its share
(count + 1) / (N' + V' + 1) in the class, where N' and V' are the class's training tokens and different
words; so the probabilities of all words, known or not, sum to 1.  What is gathered of the words inside
the classes grows with the corpus.  Counts of the HEAD most frequent words travel to the
workers; all rarer words of a text meet their counts in a join.

Null text counts as empty: one token, the end.  A null doc_id is a training row.
Repeated rows count and are scored as often as they occur.  With no training
row the base score is 0 and so is the model's.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from modgauge.llm.text import LOWER, texts
from modgauge.runtime import cut_lineage

VOCAB = 2048  # model vocabulary, the end and the classes of other words included
CLASSES = 384  # classes of the words that have no place of their own
SUFFIX = 2  # last bytes of a word that choose its class
DIM = 32
NOISE = 10  # noise words for each true one
STEPS = 100

# Words whose counts every worker holds: at most so many, of at most so many bytes.
HEAD = 1 << 18
HEAD_BYTES = 64

# Distinct words a worker counts before it passes the counts on.
_LOCAL = 400_000

END = b"\n"  # no word holds a line feed


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size is bounded by VOCAB, DIM, HEAD and HEAD_BYTES."""

    words: list[bytes]  # head, most frequent first, the end among them
    counts: np.ndarray
    size: int  # words that have a place of their own: the first of the head
    total: int  # N
    distinct: int  # V
    left: np.ndarray  # R T
    right: np.ndarray  # Q
    bias: np.ndarray
    class_total: np.ndarray  # N', V' of the words in each class
    class_distinct: np.ndarray

    def table(self) -> np.ndarray:
        """Normalised log10 probabilities, a row for each context."""
        scores = self.left @ self.right.T + self.bias
        top = scores.max(axis=1, keepdims=True)
        log_sum = top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        return ((scores - log_sum) / np.log(10)).astype(np.float64)


class _Places(dict):
    """Place of a word in the vocabulary: its own, or behind all of those, its class's."""

    def __init__(self, words: list[bytes], classes: int):
        super().__init__((word, i) for i, word in enumerate(words))
        self.first, self.classes, self.by_suffix = len(words), classes, {}

    def of(self, word: bytes) -> int:
        place = self.get(word)
        if place is None:
            suffix = word[-SUFFIX:]
            place = self.by_suffix.get(suffix)
            if place is None:  # at most 256 ** SUFFIX entries
                place = self.by_suffix[suffix] = self.first + crc32(suffix) % self.classes
        return place


def _class(token: Column, classes: int) -> Column:
    """As _Places does for a word without a place of its own."""
    n = F.octet_length(token)
    return F.crc32(F.when(n <= SUFFIX, token).otherwise(F.substring(token, n - SUFFIX + 1, F.lit(SUFFIX)))) % classes


def is_held_out(doc_id: Column) -> Column:
    """Fixed rule: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of `docs`, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = pa.array(seen.keys(), pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], ["token", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(text.translate(LOWER).split())
                seen[END] += 1
                if len(seen) > _LOCAL:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = docs.select("text").mapInArrow(run, "token binary, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame) -> list[tuple[bytes, int]]:
    """All words with a count so high that at most HEAD words reach it."""
    # Classes of counts: exact to 1024, then 64 for each doubling.
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(
        1024 + F.floor(64 * F.log2(F.col("n") / 1024))
    )
    short = counts.filter(F.octet_length("token") <= HEAD_BYTES).withColumn("level", level)
    sizes = dict(short.groupBy("level").count().collect())  # a few thousand rows
    reached, least = 0, None
    for at in sorted(sizes, reverse=True):
        reached += sizes[at]
        if reached > HEAD:
            break
        least = at
    if least is None:
        return []
    rows = short.filter(F.col("level") >= least).select("token", "n").collect()
    return sorted(((bytes(r.token), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def pair_counts(docs: DataFrame, words: list[bytes], classes: int) -> DataFrame:
    """(code, n): neighbours v, w in the vocabulary of words and classes, code = v * its size + w.

    The end stands before every first word.
    """
    size = len(words) + classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(words, classes)
        known, end = places.of, places[END]
        seen = np.zeros(size * size, np.int64)
        codes, waiting = [], 0
        for batch in batches:
            for text in texts(batch.column(0)):
                words_of = text.translate(LOWER).split()
                line = np.full(len(words_of) + 2, end, np.int64)
                line[1:-1] = [known(word) for word in words_of]
                codes.append(line[:-1] * size + line[1:])
                waiting += len(words_of)
                if waiting > _LOCAL:
                    seen += np.bincount(np.concatenate(codes), minlength=size * size)
                    codes, waiting = [], 0
        if codes:
            seen += np.bincount(np.concatenate(codes), minlength=size * size)
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 100_000):
            some = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["code", "n"])

    counted = docs.select("text").mapInArrow(run, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def fit(pairs: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R T, Q, b) by noise-contrastive estimation on a square table of pair counts."""
    size = len(pairs)
    rng = np.random.default_rng(17)
    total = max(pairs.sum(), 1)
    pairs = (pairs / total).astype(np.float32)
    before = pairs.sum(axis=1, keepdims=True)
    noise = pairs.sum(axis=0) + 0.01 / size
    noise = (noise / noise.sum()).astype(np.float32)
    level = np.log(NOISE * noise)
    params = [
        rng.normal(0, 0.1, (size, DIM)).astype(np.float32),  # R
        np.eye(DIM, dtype=np.float32),  # T
        rng.normal(0, 0.1, (size, DIM)).astype(np.float32),  # Q
        np.log(noise),  # b
    ]
    means = [np.zeros_like(p) for p in params]
    squares = [np.zeros_like(p) for p in params]
    expected = NOISE * before * noise
    for step in range(1, steps + 1):
        r, t, q, b = params
        context = r @ t
        true = 1 / (1 + np.exp(-np.clip(context @ q.T + b - level, -30, 30)))
        # Of the objective's negative: true pairs pull up, expected noise pushes down.
        slope = expected * true - pairs * (1 - true)
        d_context = slope @ q
        gradients = [d_context @ t.T, r.T @ d_context, slope.T @ context, slope.sum(axis=0)]
        rate = np.float32(0.05 / (1 + step / 40))
        for p, g, mean, square in zip(params, gradients, means, squares, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    r, t, q, b = params
    return r @ t, q, b


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of the training rows `docs`, whose word counts are `counts`."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = totals[0] or 0, totals[1]
    head = _head(counts)
    words = [word for word, _ in head]
    chosen = max(1, min(VOCAB - CLASSES, len(words)))
    if END not in words[:chosen]:  # the end always belongs
        ends = counts.filter(F.col("token") == F.lit(END)).select("n").first()
        head = [(END, ends[0] if ends else 0), *[x for x in head if x[0] != END]]
        words = [word for word, _ in head]
    number = np.array([n for _, n in head], np.int64)
    size = chosen + CLASSES
    # All words by class, less those that have a place of their own.
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    sums = counts.groupBy(_class(F.col("token"), CLASSES).alias("class")).agg(F.sum("n"), F.count("*"))
    for row in sums.collect():  # a row a class
        class_total[row[0]], class_distinct[row[0]] = row[1], row[2]
    for word, n in head[:chosen]:
        if n:
            class_total[crc32(word[-SUFFIX:]) % CLASSES] -= n
            class_distinct[crc32(word[-SUFFIX:]) % CLASSES] -= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size)
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            pairs[codes] = batch.column(1).to_numpy(zero_copy_only=False)
        found = fit(pairs.reshape(size, size))
        names = ["left", "right", "bias"]
        yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in zip(names, found, strict=True)})

    # At most size * size rows, whatever the corpus, so one task can hold them.
    table = pair_counts(docs, words[:chosen], CLASSES).repartition(1)
    row = table.mapInArrow(run, "left binary, right binary, bias binary").first()
    if row is None:  # no training rows
        left, right, bias = fit(np.zeros((size, size)))
    else:
        left, right, bias = (np.frombuffer(bytes(x), np.float32) for x in row)
    return Model(
        words,
        number,
        chosen,
        total,
        distinct,
        left.reshape(size, DIM),
        right.reshape(size, DIM),
        bias,
        class_total,
        class_distinct,
    )


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    words, number, chosen = model.words, model.counts, model.size
    class_scale = np.log10(model.class_total + model.class_distinct + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {word: i for i, word in enumerate(words)}
        places = _Places(words[:chosen], len(class_scale))
        get, place, end = known.get, places.of, known[END]
        logs = np.append(np.log10(number + 1.0), 0.0)  # the last: not in the head
        positive = np.append(number > 0, False)
        table = model.table()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, keys, repeats, docs_at, stats = [], [], [], [], []
            for i, text in enumerate(texts(batch.column(2))):
                found = text.translate(LOWER).split()
                line = np.full(len(found) + 2, end, np.int64)
                line[1:-1] = [get(word, -1) for word in found]
                heads = line[1:]
                rare = heads < 0
                ids = np.full(len(line), end, np.int64)
                ids[1:-1] = [place(word) for word in found]
                classed = ids[1:] >= chosen
                model_score = table[ids[:-1], ids[1:]].sum()
                model_score += logs[heads[classed]].sum() - class_scale[ids[1:][classed] - chosen].sum()
                rows.append(row)
                keys.append(b" %d" % row)
                repeats.append(0)
                docs_at.append(i)
                stats.append((len(heads), int(positive[heads].sum()), float(logs[heads].sum()), float(model_score)))
                if rare.any():
                    counted = Counter(found[j] for j in np.flatnonzero(rare[:-1]).tolist())
                    rows += [row] * len(counted)
                    keys += counted.keys()
                    repeats += counted.values()
                    docs_at += [None] * len(counted)
                    stats += [(0, 0, 0.0, 0.0)] * len(counted)
                row += 1
            at = pa.array(docs_at, pa.int64())
            n, k, base, lm = zip(*stats, strict=True) if stats else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(repeats, pa.int64()),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(n, pa.int64()),
                    pa.array(k, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(lm, pa.float64()),
                ],
                ["row", "token", "repeats", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm"],
            )

    partial = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        is_held_out(F.col("doc_id")).alias("held_out"),
        "text",
    ).mapInArrow(
        run,
        "row bigint, token binary, repeats bigint, doc_id bigint, held_out boolean, "
        "n_tokens bigint, n_known bigint, base double, lm double",
    )
    log = F.col("repeats") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    found = partial.join(counts, "token", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n") > 0, F.col("repeats")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + log).alias("base"),
        F.sum(F.col("lm") + log).alias("score"),
    )
    scale = float(np.log10(model.total + model.distinct + 1))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, score all rows."""
    training = docs.filter(~is_held_out(F.col("doc_id")))
    counts = cut_lineage(word_counts(training))[0]
    return score(docs, counts, train(training, counts))
