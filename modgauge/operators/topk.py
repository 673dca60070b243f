"""First k rows per group without ever gathering a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def first_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, spread: list[str]
) -> DataFrame:
    """Rows with the k smallest `order` values in each group, ranked in `rank`.

    A group is cut into SALTS parts by a hash of the `spread` columns; each part
    keeps its first k rows, and the group's first k are chosen among those.
    Spark also limits both rankings before their shuffle, so a group holding
    most of the table ends in one task as at most SALTS * k rows.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    within_part = Window.partitionBy(*group, "_salt").orderBy(*order)
    within_group = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("rank", F.row_number().over(within_part))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(within_group))
        .filter(F.col("rank") <= k)
        .drop("_salt")
    )
