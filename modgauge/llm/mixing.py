"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a random but fixed order, are cut into blocks of BLOCK.  A
source of weight w owns a share w of all slots: its block k (from 0) is released at slot
floor(k / w) and due by slot ceil((k + 1) / w), and every slot takes the released block
that is due first.  Then after any number t of slots each source has had
less than one block more or less than w * t (and 1e-9, see below).

Weights are whole shares of PERIOD, which is so long that rounding moves a source by less than
1e-9 blocks in 4 * 10^9 slots.  The schedule follows from slot to slot: the driver finds it, with two heaps, and
holds a number for each block, that is for every BLOCK rows.  When a source runs out, a new phase begins with the
others' weights scaled up.  There is a phase for each source at most; rows are neither
dropped nor repeated.  At most MAX_SOURCES sources have weights of their own; all beyond, the
smallest, share one pool.

The order inside a source is that of a hash of doc_id (and text, where there is one), found by ranking
small hash ranges and adding up their sizes, so that a source of any size is
ranked in parallel.  Null source is a source of its own; null and repeated doc_id are
ordered by their text.  Empty tables give no rows.  `mix` keeps all columns as they are; its own
names begin with `_mix`.
"""

from __future__ import annotations

import math
from array import array
from heapq import heapify, heappop, heappush
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64
PERIOD = 1 << 62
MAX_SOURCES = 500
TEMPERATURE = 0.5  # without given weights a source weighs its size to this power
RANGE_ROWS = 50_000  # rows of a hash range, about

OTHERS = "\x00others"
NO_SOURCE = "\x00none"


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole shares of the period, each at least 1 (largest remainders)."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    shares = {s: max(1, math.floor(x)) for s, x in exact.items()}
    left = period - sum(shares.values())
    for s in sorted(exact, key=lambda s: (shares[s] - exact[s], s))[: max(left, 0)]:
        shares[s] += 1
    for _ in range(-left):  # what shares raised to 1 take, the largest give
        shares[max(shares, key=lambda s: (shares[s], s))] -= 1
    return shares


def one_period(shares: dict[str, int], left: dict[str, int] | None = None) -> list[str]:
    """Earliest deadline first among released blocks, for one period of slots.

    With `left`, the blocks of each source, it ends where a source that has none left is due.
    """
    period = sum(shares.values())
    done = dict.fromkeys(shares, 0)
    waiting, released = [(0, s) for s in shares], []
    heapify(waiting)
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            s = heappop(waiting)[1]
            heappush(released, (-(-(done[s] + 1) * period // shares[s]), s))
        chosen = heappop(released)[1]
        if left is not None and done[chosen] == left[chosen]:
            break
        done[chosen] += 1
        slots.append(chosen)
        if done[chosen] < shares[chosen]:
            heappush(waiting, (done[chosen] * period // shares[chosen], chosen))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """The phases of a mix of so many blocks of each source.

    Each has its first slot, its period, and for each source its blocks [first, last) and
    the slots of one period.
    """
    left = {s: n for s, n in blocks.items() if n}
    used = dict.fromkeys(left, 0)
    start, found = 0, []
    while left:
        shares = whole_shares({s: weights[s] for s in left}, max(PERIOD, 2 * len(left)))
        slots = one_period(shares, left)
        rounds = min(n // shares[s] for s, n in left.items())
        taken = {s: rounds * e for s, e in shares.items()}
        length = rounds * len(slots)
        for s in slots:  # the round in which a source runs out
            if taken[s] == left[s]:
                break
            taken[s] += 1
            length += 1
        at = {s: array("q") for s in shares}
        for t, s in enumerate(slots):
            at[s].append(t)
        found.append(
            {"start": start, "period": len(slots), "slots": at,
             "first": {s: used[s] for s in left}, "last": {s: used[s] + taken[s] for s in left}}
        )
        start += length
        for s, n in taken.items():
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return found


def _pool(source: Column, named: list[str]) -> Column:
    name = F.coalesce(source.cast("string"), F.lit(NO_SOURCE))
    return F.when(name.isin(named), name).otherwise(OTHERS)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of `docs`, with _mix_pool, _mix_block, _mix_slot and _mix_place.

    (_mix_slot, _mix_place) is the order of the mix: the block's slot, and the row's
    place in its block.  Sources that `weights` does not name share the pool of others, with the least weight given.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    sizes = docs.groupBy(name.alias("name")).count()
    if weights is None:
        top = sizes.orderBy(F.desc("count"), "name").limit(MAX_SOURCES).collect()
        given = {r.name: r["count"] ** TEMPERATURE for r in top}
    else:
        if len(weights) > MAX_SOURCES or any(not w > 0 for w in weights.values()):
            raise ValueError(f"give at most {MAX_SOURCES} weights, all positive")
        given = dict(weights)
    pool = _pool(F.col("source"), list(given))
    rows = dict(sizes.groupBy(F.when(F.col("name").isin(list(given)), F.col("name")).otherwise(OTHERS)).sum("count").collect())
    given[OTHERS] = min(given.values(), default=1.0)
    plan = phases({s: -(-n // block) for s, n in rows.items()}, given)
    total = sum(rows.values())

    more = [F.col("text")] if "text" in docs.columns else []
    bits = max(0, math.ceil(math.log2(max(total, 1) / RANGE_ROWS)))
    digest = F.xxhash64("doc_id", *more)
    hashed = docs.withColumn("_mix_pool", pool).withColumn("_mix_hash", digest)
    hashed = hashed.withColumn("_mix_range", F.shiftrightunsigned("_mix_hash", 64 - bits) if bits else F.lit(0).cast("bigint"))
    keys = ["_mix_pool", "_mix_range"]
    narrow = docs.select(pool.alias("_mix_pool"), digest.alias("_mix_hash"))
    narrow = narrow.select("_mix_pool", (F.shiftrightunsigned("_mix_hash", 64 - bits) if bits else F.lit(0).cast("bigint")).alias("_mix_range"))
    before = Window.partitionBy("_mix_pool").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = narrow.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before")
    )
    inside = Window.partitionBy(*keys).orderBy("_mix_hash", "doc_id", *more)
    ranked = (
        hashed.withColumn("_mix_row", F.row_number().over(inside))
        .join(ranges, keys)
        .withColumn("_mix_rank", F.col("_mix_before") + F.col("_mix_row") - 1)
        .withColumn("_mix_block", F.floor(F.col("_mix_rank") / block))
    )
    table = [
        (s, p["first"][s], p["last"][s], p["start"], p["period"], p["slots"][s].tolist())
        for p in plan
        for s in p["slots"]
        if p["slots"][s]
    ]
    # At most MAX_SOURCES + 1 phases, and a slot for each block.
    schedule = F.broadcast(
        spark.createDataFrame(
            table,
            "_mix_pool string, _mix_first bigint, _mix_last bigint, _mix_start bigint, "
            "_mix_period bigint, _mix_slots array<bigint>",
        )
    )
    number = F.col("_mix_block") - F.col("_mix_first")
    size = F.size("_mix_slots")
    slot = (
        F.col("_mix_start")
        + F.floor(number / size) * F.col("_mix_period")
        + F.col("_mix_slots")[(number % size).cast("int")]
    )
    return ranked.join(
        schedule,
        (ranked["_mix_pool"] == schedule["_mix_pool"])
        & (F.col("_mix_block") >= F.col("_mix_first"))
        & (F.col("_mix_block") < F.col("_mix_last")),
    ).select(
        *[ranked[c] for c in docs.columns],
        ranked["_mix_pool"],
        "_mix_block",
        slot.cast("bigint").alias("_mix_slot"),
        (F.col("_mix_rank") % block).alias("_mix_place"),
    )


def in_order(mixed: DataFrame, slots: int, partitions: int, columns: list[str]) -> DataFrame:
    """The mix as one sequence: partitions, and so files, are stretches of slots in order."""
    part = F.least(F.floor(F.col("_mix_slot") * partitions / max(slots, 1)), F.lit(partitions - 1))
    return (
        mixed.repartitionById(partitions, part.cast("int"))
        .sortWithinPartitions("_mix_slot", "_mix_place")
        .select(*columns)
    )
