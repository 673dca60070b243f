"""Numbering the rows of a table in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.runtime import Rounds, written

# monotonically_increasing_id holds the partition above its low 33 bits, the row below.
_ROW_BITS = 33


def numbered(
    df: DataFrame,
    order: list[Column],
    name: str = "number",
    rounds: Rounds | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """`df` with `name`, counting from 0 without gaps in `order`.

    First pass: rows are dealt out by ranges of the order, sorted there, and written with
    their place in their partition.  Second pass: the rows of each partition are counted, and every row gets
    the sum of the partitions before its own.  Only that table of a row for each partition is ever in one
    task.  Rows that tie in `order` are numbered in any order among themselves.  With `weight`, a
    whole number, a row takes up as many numbers and gets its first.
    """
    place = F.monotonically_increasing_id().alias("_place")
    size = F.lit(1) if weight is None else weight
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("*", size.cast("bigint").alias("_weight"), place)
    stored, _ = (rounds.written if rounds else written)(ranged, rows=F.count("*"))
    part = F.shiftright("_place", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(part.alias("_part")).agg(F.sum("_weight").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    if weight is None:
        within = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    else:
        above = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum("_weight").over(above), F.lit(0))
    placed = stored.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(*df.columns, (F.col("_before") + within).cast("bigint").alias(name))
