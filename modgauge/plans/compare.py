"""Findings over time: differences between two runs, history, quality rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.functions.severity import CRITICAL, INFO, WARNING
from modgauge.plans.report import report_summary


def findings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, diff_key, category, file, name): what appeared and what went away.

    Both sides reach the shuffle as one row per key and task, so a finding
    that repeats a billion times costs no more than one that does not.
    """

    def keyed(findings: DataFrame, is_new: bool) -> DataFrame:
        return findings.select(
            "diff_key",
            "category",
            F.col("location.file").alias("file"),
            F.col("location.name").alias("name"),
            F.lit(is_new).alias("in_new"),
        )

    sides = keyed(old, False).unionByName(keyed(new, True))
    return (
        sides.groupBy("diff_key", "category", "file", "name")
        .agg(F.bool_or("in_new").alias("now"), F.bool_or(~F.col("in_new")).alias("before"))
        .filter(F.col("now") != F.col("before"))
        .select(
            F.when(F.col("now"), "new").otherwise("resolved").alias("change"),
            "diff_key",
            "category",
            "file",
            "name",
        )
    )


def history_rows(findings: DataFrame, run_ts: Column) -> DataFrame:
    """Rows to append to the history table after a run."""
    return report_summary(findings).select(
        run_ts.alias("run_ts"), "category", "finding_count", "worst_severity"
    )


def findings_trend(history: DataFrame) -> DataFrame:
    """History with the change against the category's previous run."""
    runs = Window.partitionBy("category").orderBy("run_ts")
    previous = F.lag("finding_count").over(runs)
    return history.select(
        "run_ts",
        "category",
        "finding_count",
        previous.alias("previous_count"),
        (F.col("finding_count") - previous).alias("change"),
    )


def code_quality(findings: DataFrame) -> DataFrame:
    """Rows in the shape merge-request quality widgets read."""
    # How severities are called there.
    level = (
        F.when(F.col("severity") == CRITICAL, "critical")
        .when(F.col("severity") == WARNING, "minor")
        .when(F.col("severity") == INFO, "info")
    )
    return findings.select(
        "description",
        F.col("category").alias("check_name"),
        F.col("finding_id").alias("fingerprint"),
        level.alias("severity"),
        F.struct(
            F.col("location.file").alias("path"),
            F.struct(F.coalesce("location.line", F.lit(1)).alias("begin")).alias("lines"),
        ).alias("location"),
    )
