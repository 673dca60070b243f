"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: a vector is scaled to length one and rotated at random; a code keeps the
sign of every coordinate, packed, and one correction scalar, the inner product of
the rotated vector with its own signs.  The inner product with a query is
estimated from the signs and that scalar without bias, and its error has the bound
sqrt((1 - f^2) / f^2 / (D - 1)) * EPSILON, with f the scalar: it is exceeded for
about one vector in a thousand at EPSILON = 3.  A vector is reranked, by the exact
cosine of the original vectors in double precision, if its estimate plus the
bound reaches the k-th best exact cosine so far.  The rows with the best estimates of a block are
reranked first, so that this floor is high when the others are looked at.  Every row is indexed and every query sees every row.

Queries go to the index in blocks of about QUERY_BLOCK, each one pass over the
codes; a task keeps k rows for each query, and the tasks' rows are merged in one
shuffle.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id or of another dimension than most.  Rows that repeat an id are one
candidate, with their best score; as a query the smallest such vector is taken.  Ties go to the smaller id.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.runtime import cut_lineage

EPSILON = 3.0
QUERY_BLOCK = 4096
SEED = 20240521

# Rows whose estimates are in memory at a time, and numbers of vectors that are reranked at a time.
_ROWS = 1024
_NUMBERS = 1 << 21


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, components as doubles."""
    embedding = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), embedding.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(finite & F.exists("embedding", lambda x: x != 0))
    )
    dims = whole.groupBy(F.size("embedding").alias("dim")).count()
    most = dims.agg(F.max_by(F.col("dim"), F.struct(F.col("count"), -F.col("dim"))))
    return whole.filter(F.size("embedding") == most.scalar())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def index(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, code, scalar) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            turned = _unit(v) @ rotation(v.shape[1])
            codes = np.packbits(turned > 0, axis=1)
            scalar = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scalar)],
                ["vec_id", "embedding", "code", "scalar"],
            )

    return vectors.mapInArrow(
        run, "vec_id bigint, embedding array<double>, code binary, scalar double"
    )


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about one.

    A power of two leaves all other digits alone, so cosines of ordinary vectors are the same to the
    last digit, and those of very small or large ones do not vanish or overflow.
    """
    _, exponent = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v, -exponent)


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Searcher:
    """The k best ids so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, epsilon: float):
        self.ids, self.k, self.epsilon = ids, k, epsilon
        self.queries = _scaled(queries)
        self.norms = _dots(self.queries, self.queries)
        self.turned = (_unit(queries) @ rotation(queries.shape[1])).T.astype(np.float32)
        self.best = np.full((len(ids), k), -np.inf)
        self.best_ids = np.full((len(ids), k), -1, np.int64)
        self.reranked = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalar: np.ndarray) -> None:
        dim = vectors.shape[1]
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        factor = (1 / (np.sqrt(dim) * scalar)).astype(np.float32)
        estimate = signs @ self.turned
        estimate *= factor[:, None]
        error = self.epsilon * np.sqrt(np.maximum(1 - scalar**2, 0) / max(dim - 1, 1)) / scalar
        # A query is no neighbour of itself: its own rows are out.
        place = np.searchsorted(self.ids, ids)
        place[place == len(self.ids)] = 0
        own = np.flatnonzero(self.ids[place] == ids)
        estimate[own, place[own]] = -np.inf
        vectors = _scaled(vectors)
        norms = _dots(vectors, vectors)
        few = min(self.k, len(ids))
        seeds = np.argpartition(estimate, len(ids) - few, axis=0)[len(ids) - few :]
        query = np.tile(np.arange(len(self.ids)), few)
        row = seeds.ravel()
        real = estimate[row, query] > -np.inf
        self._rerank(row[real], query[real], ids, vectors, norms)
        estimate[seeds, np.arange(len(self.ids))] = -np.inf
        # The floor is the k-th best of different ids, so rows that repeat an id raise it only once.
        estimate += error.astype(np.float32)[:, None]
        row, query = np.nonzero(estimate >= (self.best[:, -1] - 1e-5).astype(np.float32))
        real = estimate[row, query] > -np.inf
        row, query = row[real], query[real]
        size = max(1, _NUMBERS // dim)
        for at in range(0, len(row), size):
            self._rerank(row[at : at + size], query[at : at + size], ids, vectors, norms)

    def _rerank(self, row, query, ids, vectors, norms) -> None:
        """Exact cosines of rows with queries; the k best of each query's ids stay."""
        self.reranked += len(row)
        scale = np.sqrt(norms[row] * self.norms[query])
        scores = np.einsum("ij,ij->i", vectors[row], self.queries[query]) / scale
        # Those that may stay are summed in the order of the components, as the score is defined.
        close = scores >= self.best[query, -1] - 1e-9
        row, query, scale = row[close], query[close], scale[close]
        if not len(row):
            return
        scores = np.clip(_dots(vectors[row], self.queries[query]) / scale, -1, 1)
        touched = np.unique(query)
        held, nth = np.nonzero(np.isfinite(self.best[touched]))
        held = touched[held]
        query = np.concatenate([query, held])
        scores = np.concatenate([scores, self.best[held, nth]])
        found = np.concatenate([ids[row], self.best_ids[held, nth]])
        # One entry for each query and id, then the first k of each query.
        order = np.lexsort((-scores, found, query))
        query, scores, found = query[order], scores[order], found[order]
        first = np.ones(len(query), bool)
        first[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
        query, scores, found = query[first], scores[first], found[first]
        order = np.lexsort((found, -scores, query))
        query, scores, found = query[order], scores[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.best[touched], self.best_ids[touched] = -np.inf, -1
        self.best[query[top], rank[top]] = scores[top]
        self.best_ids[query[top], rank[top]] = found[top]


def search(
    vectors: DataFrame, is_query: Column, k: int, epsilon: float = EPSILON
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every query row.

    Queries are the usable rows where `is_query` holds; candidates are all usable
    rows but those with the query's own id.
    """
    indexed, seen = cut_lineage(
        index(usable(vectors)).withColumn("asks", is_query), asked=F.count_if("asks")
    )
    asked = indexed.filter("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-seen["asked"] // QUERY_BLOCK))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = []
    for block in range(blocks):
        # About QUERY_BLOCK vectors by the hash's evenness, however many rows there are.
        rows = asked.filter(place == block).orderBy("vec_id").collect() if seen["asked"] else []
        found.append(_pass(indexed, rows, k, epsilon))
        if blocks > 1:
            found[-1] = cut_lineage(found[-1])[0]
    merged = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pass(indexed: DataFrame, rows: list, k: int, epsilon: float) -> DataFrame:
    ids = np.array([r.vec_id for r in rows], np.int64)
    queries = np.array([r.embedding for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        own = Searcher(ids, queries, k, epsilon)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8)
                own.add(
                    part.column(0).to_numpy(zero_copy_only=False),
                    _matrix(part.column(1)),
                    codes.reshape(part.num_rows, -1),
                    part.column(3).to_numpy(zero_copy_only=False),
                )
        query, place = np.nonzero(np.isfinite(own.best))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own.ids[query]),
                pa.array(own.best_ids[query, place]),
                pa.array(own.best[query, place]),
            ],
            ["query_id", "vec_id", "score"],
        )

    return indexed.select("vec_id", "embedding", "code", "scalar").mapInArrow(
        run, "query_id bigint, vec_id bigint, score double"
    )
