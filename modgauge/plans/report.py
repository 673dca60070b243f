"""Summaries, report lines and the pass/fail gate over a findings table.

Counts come from a table of four rows, so findings are read once for all of them,
and without their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.functions import texts
from modgauge.functions.severity import severity_label
from modgauge.plans.findings import (
    ARCHITECTURAL_DRIFT,
    CATEGORIES,
    CIRCULAR_DEPENDENCY,
    DEAD_CODE,
    HIGH_COUPLING,
)
from modgauge.operators.numbering import numbered
from modgauge.runtime import cut_lineage

# Row label in the summary, section heading, advice sentence.
SUMMARY_LABELS = {
    DEAD_CODE: "Dead Code",
    CIRCULAR_DEPENDENCY: "Circular Dependencies",
    HIGH_COUPLING: "High Coupling Modules",
    ARCHITECTURAL_DRIFT: "Architectural Drift",
}
HEADINGS = {
    DEAD_CODE: "Dead Code",
    CIRCULAR_DEPENDENCY: "Circular Dependencies",
    HIGH_COUPLING: "Module Coupling",
    ARCHITECTURAL_DRIFT: "Architectural Drift",
}
ADVICE = {
    DEAD_CODE: texts.ADVICE_DEAD_CODE,
    CIRCULAR_DEPENDENCY: texts.ADVICE_CYCLES,
    HIGH_COUPLING: texts.ADVICE_COUPLING,
    ARCHITECTURAL_DRIFT: texts.ADVICE_DRIFT,
}

# Sections of the report; the categories' own sections lie in between.
HEADER, SUMMARY, ADVICE_SECTION = 0, 1, 2 + len(CATEGORIES)


def tallies(findings: DataFrame) -> DataFrame:
    """(category, critical, warning, info): four rows at most, all that counts need.

    Reads nothing of a finding but its category and severity.
    """
    rank = F.col("severity_rank")
    return findings.groupBy("category").agg(
        F.count_if(rank == 2).alias("critical"),
        F.count_if(rank == 1).alias("warning"),
        F.count_if(rank == 0).alias("info"),
    )


def _counts(counted: DataFrame) -> DataFrame:
    """Tallies as they are, or those of findings."""
    return counted if "critical" in counted.columns else tallies(counted)


def report_summary(findings: DataFrame) -> DataFrame:
    """(category_no, category, finding_count, worst_severity) of all four categories.

    Takes findings or their tallies, as the functions below do.
    """
    listed = F.posexplode(F.array(*[F.lit(c) for c in CATEGORIES]))
    categories = findings.sparkSession.range(1).select(listed.alias("category_no", "category"))
    rank = F.when(F.col("critical") > 0, 2).when(F.col("warning") > 0, 1).otherwise(0)
    return categories.join(_counts(findings), "category", "left").select(
        "category_no",
        "category",
        F.coalesce(F.col("critical") + F.col("warning") + F.col("info"), F.lit(0)).alias("finding_count"),
        severity_label(rank).alias("worst_severity"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: how many findings of each severity, and the worst of all."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("critical", "warning", "info")}
    total = sums["critical"] + sums["warning"] + sums["info"]
    worst = F.when(sums["critical"] > 0, 2).when(sums["warning"] > 0, 1).otherwise(0)
    return _counts(findings).agg(
        *[value.alias(f"{name}_count") for name, value in sums.items()],
        total.alias("total_count"),
        severity_label(worst).alias("worst_severity"),
    )


def recommendations(findings: DataFrame) -> DataFrame:
    """(advice_no, category, advice): one entry per category that has findings.

    Only when something is a warning or worse.  The count includes infos.
    """
    counted = cut_lineage(_counts(findings))[0]  # four rows, read twice
    urgent = severity_counts(counted).select(
        (F.col("critical_count") + F.col("warning_count") > 0)
    )
    advice_no = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category_no"))
    return (
        report_summary(counted)
        .filter((F.col("finding_count") > 0) & urgent.scalar())
        .withColumn("advice_no", advice_no)  # four rows at most
        .select(
            "advice_no",
            "category",
            _by_category(
                lambda c: F.format_string(ADVICE[c], F.col("advice_no"), F.col("finding_count"))
            ).alias("advice"),
        )
    )


def ci_gate(findings: DataFrame) -> DataFrame:
    """One row (critical_count, gate_failed); the caller turns it into an exit code."""
    return severity_counts(findings).select(
        "critical_count", (F.col("critical_count") > 0).alias("gate_failed")
    )


def _by_category(value) -> Column:
    chain = F
    for category in CATEGORIES:
        chain = chain.when(F.col("category") == category, value(category))
    return chain


def finding_lines() -> Column:
    """The two report lines of a finding, as one text.

    Findings may be equal in all they say, so their lines could not be told apart by
    sort keys if they were rows of their own.
    """
    place = F.coalesce(
        F.concat(F.col("location.file"), F.lit(":"), F.col("location.line").cast("string")),
        F.col("location.file"),
    )
    return F.concat_ws(
        "\n",
        F.format_string(
            "- **%s** [`%s`](%s) — %s",
            F.upper("severity"),
            F.col("location.name"),
            place,
            F.col("description"),
        ),
        F.format_string("  - _Suggestion_: %s", F.col("remediation")),
    )


# Lines carry sort keys, not line numbers: numbering a section of billions of
# findings would have to pass through one task, sorting by keys does not.
LINE_KEYS = (
    "section_no",
    "block_no",
    "order_rank",
    "order_file",
    "order_line",
    "order_name",
    "finding_id",
    "line_no",
)
_LAST_LINE = 2**63 - 1


def _lines(df: DataFrame, section: Column, block: int, lines: Column, **keys: Column) -> DataFrame:
    defaults = {
        "order_rank": F.lit(0).cast("bigint"),
        "order_file": F.lit(""),
        "order_line": F.lit(0).cast("bigint"),
        "order_name": F.lit(""),
        "finding_id": F.lit(""),
    }
    return df.select(
        section.cast("int").alias("section_no"),
        F.lit(block).alias("block_no"),
        *[keys.get(name, default).alias(name) for name, default in defaults.items()],
        F.posexplode(lines).alias("line_no", "line"),
    )


def report_lines(
    findings: DataFrame,
    stats: DataFrame,
    repository: str = "unknown",
    timestamp: str = "",
    version: str = "1",
) -> DataFrame:
    """The Markdown report as one row per line; sort by LINE_KEYS to read it.

    A finding is one row of two lines.
    """
    counted = cut_lineage(tallies(findings))[0]
    summary = report_summary(counted)
    totals = severity_counts(counted)
    section_of = _by_category(lambda c: F.lit(2 + CATEGORIES.index(c)))
    heading = _by_category(lambda c: F.lit("## " + HEADINGS[c]))
    label = _by_category(lambda c: F.lit(SUMMARY_LABELS[c]))
    blank = F.lit("")

    header = _lines(
        stats,
        F.lit(HEADER),
        0,
        F.array(
            F.lit("# Code Health Report"),
            blank,
            F.lit(f"**Repository**: {repository}"),
            F.lit(f"**Timestamp**: {timestamp}"),
            F.format_string(
                "**Graph Size**: %s nodes, %s edges", F.col("nodes"), F.col("edges")
            ),
            F.lit(f"**Report Version**: {version}"),
            blank,
        ),
    )
    summary_head = _lines(
        totals,
        F.lit(SUMMARY),
        0,
        F.array(
            F.lit("## Summary"),
            blank,
            F.lit("| Category | Count | Worst Severity |"),
            F.lit("|---|---|---|"),
        ),
    )
    summary_rows = _lines(
        summary,
        F.lit(SUMMARY),
        1,
        F.array(
            F.format_string(
                "| %s | %s | %s |", label, F.col("finding_count"), F.col("worst_severity")
            )
        ),
        order_rank=F.col("category_no").cast("bigint"),
    )
    summary_total = _lines(
        totals,
        F.lit(SUMMARY),
        2,
        F.array(
            F.format_string(
                "| **Total** | **%s** | %s critical, %s warning, %s info |",
                F.col("total_count"),
                F.col("critical_count"),
                F.col("warning_count"),
                F.col("info_count"),
            ),
            blank,
        ),
    )
    filled = summary.filter(F.col("finding_count") > 0)
    section_heads = _lines(filled, section_of, 0, F.array(heading, blank))
    body = _lines(
        findings,
        section_of,
        1,
        F.array(finding_lines()),
        # Largest fan-out first; other categories sort by place.
        order_rank=-F.coalesce(F.col("related.fan_out"), F.lit(0)),
        order_file=F.col("location.file"),
        order_line=F.coalesce(F.col("location.line"), F.lit(_LAST_LINE)),
        order_name=F.col("location.name"),
        finding_id=F.col("finding_id"),
    )
    section_tails = _lines(filled, section_of, 2, F.array(blank))
    advice = recommendations(counted)
    advice_head = _lines(
        totals.filter(F.col("critical_count") + F.col("warning_count") > 0),
        F.lit(ADVICE_SECTION),
        0,
        F.array(F.lit("## Recommendations"), blank),
    )
    advice_rows = _lines(
        advice,
        F.lit(ADVICE_SECTION),
        1,
        F.array(F.col("advice"), blank),
        order_rank=F.col("advice_no").cast("bigint"),
    )
    all_clear = _lines(
        totals.filter(F.col("total_count") == 0),
        F.lit(ADVICE_SECTION),
        0,
        F.array(F.lit("## All Clear"), blank, F.lit(texts.ALL_CLEAR)),
    )
    return reduce(
        DataFrame.unionByName,
        [
            header,
            summary_head,
            summary_rows,
            summary_total,
            section_heads,
            body,
            section_tails,
            advice_head,
            advice_rows,
            all_clear,
        ],
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(section_no, line_no, line): report_lines cut at line ends and numbered from 1 without gaps.

    The lines of a finding stay together, equal findings included, as rows are numbered first, each
    taking up as many numbers as it has lines.
    """
    cut = F.split("line", "\n")
    placed = numbered(lines, [F.col(key) for key in LINE_KEYS], "first", weight=F.size(cut))
    return placed.select("section_no", "first", F.posexplode(cut).alias("at", "line")).select(
        "section_no", (F.col("first") + F.col("at") + 1).alias("line_no"), "line"
    )


def reading_order() -> list[Column]:
    """Sort keys of findings: by category, most dependencies first, then by place."""
    place = F.coalesce("location.line", F.lit(_LAST_LINE))
    return [
        F.asc(_by_category(lambda c: F.lit(CATEGORIES.index(c)))),
        F.desc(F.coalesce("related.fan_out", F.lit(0))),
        F.asc("location.file"),
        F.asc(place),
        F.asc("location.name"),
        F.asc("finding_id"),
    ]
