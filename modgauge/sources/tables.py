"""Reading the two graph tables, and checking them against their contract."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table lacks a required column or holds it with another type."""


def read_table(spark: SparkSession, source: str, contract: T.StructType) -> DataFrame:
    """A catalog table by name, or a Parquet folder by path, cut to its contract."""
    is_path = "/" in source
    df = spark.read.parquet(source) if is_path else spark.table(source)
    return conform(df, contract)


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Project to the contract's columns; the scan then reads only those.

    Whole-number columns may be narrower than the contract says; anything else
    that is missing or differs is reported at once instead of in a late task.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        f"{actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in contract.fields
        if f.name not in actual or not _fits(actual[f.name], f.dataType)
    ]
    if problems:
        raise ContractError("; ".join(problems))
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields]
    )


def _fits(actual: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.LongType):
        return isinstance(actual, T.IntegralType)
    return actual == wanted


def _complete(contract: T.StructType) -> Column:
    return reduce(
        and_, [F.col(f.name).isNotNull() for f in contract.fields if not f.nullable]
    )


def complete_rows(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Rows that honour the contract."""
    return conform(df, contract).filter(_complete(contract))


def rejected_rows(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The other rows: a required column is NULL."""
    return conform(df, contract).filter(~_complete(contract))


def contract_report(name: str, df: DataFrame, contract: T.StructType) -> DataFrame:
    """Row and NULL counts of every contract column, in one pass over the table."""
    columns = [f.name for f in contract.fields]
    counted = conform(df, contract).agg(
        F.count("*").alias("row_count"),
        *[F.count(c).alias(c) for c in columns],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(not f.nullable).alias("required"),
                (F.col("row_count") - F.col(f.name)).alias("null_count"),
            )
            for f in contract.fields
        ]
    )
    return counted.select(F.explode(per_column).alias("c"), "row_count").select(
        F.lit(name).alias("table_name"),
        "c.column_name",
        "c.data_type",
        "row_count",
        "c.null_count",
        (~F.col("c.required") | (F.col("c.null_count") == 0)).alias("honoured"),
    )


def count_rows(spark: SparkSession, source: DataFrame | str | None) -> Column:
    """Row count of a DataFrame or catalog table as a scalar; 0 without the table."""
    if isinstance(source, str):
        source = spark.table(source) if spark.catalog.tableExists(source) else None
    if source is None:
        return F.lit(0).cast("bigint")
    return source.agg(F.count("*")).scalar()

