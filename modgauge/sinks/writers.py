"""Writing findings and reports; every writer is a distributed Spark write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modgauge.operators.numbering import numbered
from modgauge.plans.report import LINE_KEYS, reading_order


def finding_json() -> Column:
    """A finding as one JSON object.

    An absent line is written as null; `related` holds only its category's fields.
    """
    head = F.to_json(F.struct(F.col("finding_id").alias("id"), "severity", "category"))
    location = F.to_json(F.col("location"), {"ignoreNullFields": "false"})
    wording = F.to_json(F.struct("description", "remediation"))
    return F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1),
        F.lit(',"location":'),
        location,
        F.lit(","),
        F.substr(wording, F.lit(2), F.length(wording) - 2),
        F.lit(',"related":'),
        F.to_json("related"),
        F.lit("}"),
    )


def findings_json(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", finding_json().alias("json"))


def write_findings(
    findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "error"
) -> None:
    """Parquet, ORC or any other structured format; "json" writes report objects."""
    if fmt == "json":
        findings.select(finding_json().alias("value")).write.mode(mode).text(path)
    else:
        findings.write.mode(mode).format(fmt).save(path)


def write_report(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Report lines as text files whose name order is the reading order."""
    lines.orderBy(*LINE_KEYS).select("line").write.mode(mode).text(path)


def report_document(
    findings: DataFrame,
    stats: DataFrame,
    repository: str = "unknown",
    version: str = "1",
    timestamp: str | None = None,
) -> DataFrame:
    """Report metadata as one JSON row; the findings stay in their own files."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return stats.select(
        F.to_json(
            F.struct(
                F.lit(version).alias("version"),
                (now if timestamp is None else F.lit(timestamp)).alias("timestamp"),
                F.lit(repository).alias("repository"),
                F.struct("nodes", "edges").alias("graph_stats"),
                findings.agg(F.count("*")).scalar().alias("finding_count"),
            )
        ).alias("json")
    )


def document_lines(
    findings: DataFrame,
    stats: DataFrame,
    repository: str = "unknown",
    version: str = "1",
    timestamp: str | None = None,
) -> DataFrame:
    """(line_no, line): the report as one JSON document, its metadata and then a finding a line.

    Findings stand in reading order.  Each but the first brings the comma before it, which its number
    tells, so no line needs to know its neighbour.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    head = stats.select(
        F.lit(0).cast("bigint").alias("line_no"),
        F.regexp_replace(
            F.to_json(
                F.struct(
                    F.lit(version).alias("version"),
                    (now if timestamp is None else F.lit(timestamp)).alias("timestamp"),
                    F.lit(repository).alias("repository"),
                    F.struct("nodes", "edges").alias("graph_stats"),
                )
            ),
            r"\}$",
            ',"findings":[',
        ).alias("line"),
    )
    body = numbered(
        findings.select("category", "location", "related", "finding_id", finding_json().alias("json")),
        reading_order(),
    ).select(
        (F.col("number") + 1).alias("line_no"),
        F.concat(F.when(F.col("number") > 0, ",").otherwise(""), F.col("json")).alias("line"),
    )
    tail = body.agg((F.count("*") + 1).alias("line_no"), F.lit("]}").alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_document(lines: DataFrame, path: str, mode: str = "error") -> None:
    """document_lines as text files that, put together in the order of their names, are the document."""
    lines.orderBy("line_no").select("line").write.mode(mode).text(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Add a run's compare.history_rows to the history kept below `path`.

    Every run is a partition, replaced as a whole: a run that is appended again, after a
    failure or a second thought, counts once, and other runs are left alone.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a history, as compare.findings_trend takes them."""
    schema = "category string, finding_count bigint, worst_severity string, run_ts string"
    stored = spark.read.schema(schema).parquet(path)
    return stored.select("run_ts", "category", "finding_count", "worst_severity")
