"""Graph tables: file edges, module edges, fan-out, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modgauge.functions.paths import module_of
from modgauge.sources.tables import count_rows


def file_edges(refs: DataFrame) -> DataFrame:
    """References per (source_file, target_file), same-file pairs included."""
    return refs.groupBy("source_file", "target_file").agg(
        F.count("*").alias("ref_count")
    )


def _roll_up(df: DataFrame, **measures: Column) -> DataFrame:
    """Aggregate rows with files to cross-module edges.

    Whether an edge crosses modules is decided on the aggregated rows: a filter
    on the keys would be pushed below and derive both modules a second time.
    """
    crosses = F.bool_or(F.col("src_module") != F.col("dst_module"))
    return (
        df.withColumn("src_module", module_of(F.col("source_file")))
        .withColumn("dst_module", module_of(F.col("target_file")))
        .groupBy("src_module", "dst_module")
        .agg(
            *[measure.alias(name) for name, measure in measures.items()],
            crosses.alias("crosses"),
        )
        .filter("crosses")
        .drop("crosses")
    )


def module_edges(refs: DataFrame) -> DataFrame:
    """Cross-module edges: summed references and number of distinct file pairs."""
    return _roll_up(
        file_edges(refs), ref_count=F.sum("ref_count"), file_pairs=F.count("*")
    )


def module_links(refs: DataFrame) -> DataFrame:
    """module_edges without file_pairs, which the checks do not read.

    Rolls references straight up to modules: map-side aggregation leaves a
    task with at most one row per module pair, so the shuffle over distinct
    file pairs that module_edges needs never happens.
    """
    return _roll_up(refs.select("source_file", "target_file"), ref_count=F.count("*"))


def fan_out(edges: DataFrame) -> DataFrame:
    """Number of modules each module depends on; modules with none are absent."""
    return edges.groupBy("src_module").agg(F.count("*").alias("fan_out"))


def graph_stats(
    spark: SparkSession, defs: DataFrame | str | None, refs: DataFrame | str | None
) -> DataFrame:
    """One row (nodes, edges); a table that does not exist counts 0."""
    return spark.range(1).select(
        count_rows(spark, defs).alias("nodes"), count_rows(spark, refs).alias("edges")
    )
