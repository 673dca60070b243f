"""Joining rows to a keyed table when a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is hot when it owns more than 1/HOT_PARTS of the rows, so there are
# fewer than HOT_PARTS hot keys whatever the data: small enough to broadcast.
HOT_PARTS = 1000

# Rows of one key that fit a task; a hot key is dealt out over as many tasks as it
# holds this many rows.
TASK_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _salts): over how many tasks the rows of a hot key are dealt out."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    limit = F.greatest(F.coalesce(total, F.lit(0)) / HOT_PARTS, F.lit(TASK_ROWS))
    return counts.filter(F.col("_rows") > limit).select(
        key, F.ceil(F.col("_rows") / TASK_ROWS).cast("int").alias("_salts")
    )


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, how: str) -> DataFrame:
    """rows.join(keyed, key, how), where `keyed` holds every key at most once.

    Rows of a hot key are dealt out over tasks in proportion to their number, and
    only that key's entry is copied to all of them.  AQE cannot do this by itself
    when `keyed` comes straight from an aggregation: it splits a partition only if both
    sides of the join are plain shuffles.
    """
    hot = F.broadcast(hot_keys(rows, key))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").select(
        *[F.col(c) for c in rows.columns],
        F.pmod(F.xxhash64(*rows.columns), salts).cast("int").alias("_salt"),
    )
    copied = keyed.join(hot, key, "left").select(
        *[F.col(c) for c in keyed.columns],
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"),
    )
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
