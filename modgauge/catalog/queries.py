"""Queries over the code graph that sources.derived builds from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from modgauge.config import BoundaryRule, Ignore, Rules, Thresholds
from modgauge.functions.globs import matches_glob
from modgauge.functions.paths import module_of
from modgauge.operators import cycles, graph
from modgauge.operators.coupling import coupling, coupling_dependencies
from modgauge.operators.dead_code import (
    dead_code,
    dead_code_severity,
    dead_code_total,
    unreferenced,
)
from modgauge.operators.drift import drift, governing_rule, import_allowed
from modgauge.operators.drift_index import governing_rules
from modgauge.operators.evidence import pair_cycle_evidence
from modgauge.plans import compare, report
from modgauge.plans.analysis import analyze
from modgauge.runtime import cut_lineage, ensure_checkpoint_dir
from modgauge.schema import DEFINITIONS, REFERENCES
from modgauge.sinks.writers import (
    append_history,
    document_lines,
    findings_json,
    read_history,
    report_document,
    write_findings,
)
from modgauge.sources.derived import definitions, references
from modgauge.sources.tables import contract_report, rejected_rows

Query = Callable[[SparkSession, str], DataFrame]

# Wide to narrow: a file of the first rule never reaches the second.
OVERLAPPING_RULES = Rules(
    boundaries=(
        BoundaryRule("Numbered", "src/mod1?/**", ("src/mod1[0-4]/**", "**/index.ts")),
        BoundaryRule("Sources", "src/**", ("src/**/*[!0].rs", "*.go", "src/a**")),
        BoundaryRule("Closed", "**/*.test.*"),
    ),
    thresholds=Thresholds(coupling_warning_fan_out=5, coupling_critical_fan_out=12),
    ignore=Ignore(dead_code=("**/*.test.*", "src/types/**"), drift=("src/models/**",)),
)

GLOBS = {
    "any_depth": "src/domain/**",
    "by_suffix": "**/*.test.*",
    "star_crosses": "*.rs",
    "one_character": "src/mod?/f1.rs",
    "character_set": "src/mod1[0-3]/**",
    "negated_set": "src/mod1[!0-3]/*",
    "middle_folders": "src/**/f7.rs",
    "exact_file": "src/main.rs",
    "braces_are_plain": "src/{domain,types}/f1.rs",
    "malformed": "src/mod1**",
}


def _all_files(refs: DataFrame) -> DataFrame:
    return refs.select(F.explode(F.array("source_file", "target_file")).alias("file")).distinct()


def module_of_files(spark: SparkSession, folder: str) -> DataFrame:
    return _all_files(references(spark, folder)).select(
        "file", module_of(F.col("file")).alias("module")
    )


def file_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.file_edges(references(spark, folder))


def module_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.module_edges(references(spark, folder, "dense"))


def module_links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.module_links(references(spark, folder))


def fan_out(spark: SparkSession, folder: str) -> DataFrame:
    return graph.fan_out(graph.module_links(references(spark, folder)))


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_stats(spark, definitions(spark, folder), references(spark, folder))


def schema_contract(spark: SparkSession, folder: str) -> DataFrame:
    return contract_report(
        "definitions", definitions(spark, folder), DEFINITIONS
    ).unionByName(contract_report("references", references(spark, folder), REFERENCES))


def dead_code_unreferenced(spark: SparkSession, folder: str) -> DataFrame:
    return unreferenced(definitions(spark, folder), references(spark, folder))


def dead_code_query(spark: SparkSession, folder: str) -> DataFrame:
    return dead_code(definitions(spark, folder), references(spark, folder))


def dead_code_ignoring(spark: SparkSession, folder: str) -> DataFrame:
    return dead_code(
        definitions(spark, folder), references(spark, folder), OVERLAPPING_RULES
    )


def dead_code_severity_query(spark: SparkSession, folder: str) -> DataFrame:
    severity = dead_code_severity(F.col("name"), F.col("kind"))
    return definitions(spark, folder).select("*", severity.alias("severity"))


def dead_code_total_query(spark: SparkSession, folder: str) -> DataFrame:
    return dead_code_total(dead_code_query(spark, folder))


def glob_match(spark: SparkSession, folder: str) -> DataFrame:
    return _all_files(references(spark, folder)).select(
        "file", *[matches_glob(F.col("file"), g).alias(name) for name, g in GLOBS.items()]
    )


def drift_boundary_of_file(spark: SparkSession, folder: str) -> DataFrame:
    rule = governing_rule(F.col("file"), OVERLAPPING_RULES.effective_boundaries)
    return (
        _all_files(references(spark, folder))
        .withColumn("rule", rule)
        .select("file", "rule.index", F.col("rule.name").alias("boundary_name"))
        .withColumnRenamed("index", "rule_index")
    )


def drift_import_allowed(spark: SparkSession, folder: str) -> DataFrame:
    allowed = import_allowed(
        F.col("source_file"), F.col("target_file"), Rules().effective_boundaries
    )
    return graph.file_edges(references(spark, folder)).select(
        "source_file", "target_file", allowed.alias("import_allowed")
    )


def architectural_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift(references(spark, folder))


def drift_overlapping_rules(spark: SparkSession, folder: str) -> DataFrame:
    return drift(references(spark, folder), OVERLAPPING_RULES)


def pair_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return cycles.pair_cycles(graph.module_links(references(spark, folder, "dense")))


def _cycles(spark: SparkSession, folder: str, name: str) -> DataFrame:
    links, _ = cut_lineage(graph.module_links(references(spark, folder, name)))
    return cycles.long_cycles(links)


def _readable(found: DataFrame) -> DataFrame:
    return found.select(
        F.array_join("path", " -> ").alias("path"), "length", "total_refs"
    )


def long_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return _readable(_cycles(spark, folder, "layered"))


def long_cycles_ring(spark: SparkSession, folder: str) -> DataFrame:
    return _readable(_cycles(spark, folder, "sparse"))


def cycle_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Each cycle written from each of its modules, with the key they all share."""
    path, at = F.col("path"), F.col("offset")
    rotated = F.concat(
        F.slice(path, at + 1, F.size(path)), F.slice(path, F.lit(1), at)
    )
    return (
        _cycles(spark, folder, "layered")
        .select("path", F.posexplode("path").alias("offset", "module"))
        .withColumn("rotated", rotated)
        .select(
            F.array_join("rotated", " -> ").alias("written"),
            F.array_join(cycles.canonical_cycle(F.col("rotated")), " -> ").alias("cycle_key"),
        )
    )


def cycle_weakest_edge(spark: SparkSession, folder: str) -> DataFrame:
    weakest = cycles.weakest_edges(_cycles(spark, folder, "layered"))
    return weakest.withColumn("path", F.array_join("path", " -> "))


def pair_cycle_evidence_query(spark: SparkSession, folder: str) -> DataFrame:
    refs = references(spark, folder, "dense")
    pairs = cycles.pair_cycles(graph.module_links(refs))
    return pair_cycle_evidence(graph.file_edges(refs), pairs)


def coupling_query(spark: SparkSession, folder: str) -> DataFrame:
    links, _ = cut_lineage(graph.module_links(references(spark, folder)))
    return coupling(links).withColumn("dependencies", F.array_join("dependencies", ","))


def coupling_dependencies_query(spark: SparkSession, folder: str) -> DataFrame:
    links, _ = cut_lineage(graph.module_links(references(spark, folder)))
    return coupling_dependencies(links)


def _findings(
    spark: SparkSession, folder: str, name: str = "layered", **options
) -> DataFrame:
    return analyze(
        definitions(spark, folder), references(spark, folder, name), **options
    )


def _flat(findings: DataFrame) -> DataFrame:
    return findings.select(
        "finding_id",
        "diff_key",
        "severity",
        "severity_rank",
        "category",
        "location.*",
        "description",
        "remediation",
        *[
            F.col(f"related.{field}").alias(f"related_{field}")
            for field in ("other_module", "cycle_count", "module_name", "fan_out")
        ],
        F.array_join("related.dependencies", ",").alias("related_dependencies"),
        *[
            F.col(f"related.{field}").alias(f"related_{field}")
            for field in (
                "target_name",
                "target_file",
                "boundary_name",
                "boundary_rule",
                "kind",
            )
        ],
    )


def all_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        analyze(definitions(spark, folder), references(spark, folder))
    )


def findings_custom_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(
        analyze(
            definitions(spark, folder),
            references(spark, folder),
            OVERLAPPING_RULES,
            only=" coupling,architectural_drift, dead_code ,unknown",
        )
    )


def findings_min_severity(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_findings(spark, folder, min_severity="Critical"))


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.report_summary(_findings(spark, folder))


def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return report.severity_counts(_findings(spark, folder))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return report.recommendations(_findings(spark, folder))


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return report.report_lines(
        _findings(spark, folder), graph_stats(spark, folder), "derived", "now", "1"
    )


def ci_gate(spark: SparkSession, folder: str) -> DataFrame:
    return report.ci_gate(_findings(spark, folder))


def findings_json_query(spark: SparkSession, folder: str) -> DataFrame:
    return findings_json(_findings(spark, folder))


def code_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = compare.code_quality(_findings(spark, folder))
    return rows.select(
        "description",
        "check_name",
        "fingerprint",
        "severity",
        F.col("location.path").alias("path"),
        F.col("location.lines.begin").alias("begin_line"),
    )


def findings_diff(spark: SparkSession, folder: str) -> DataFrame:
    return compare.findings_diff(
        _findings(spark, folder, "layered"), _findings(spark, folder, "sparse")
    )


def rules_from_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Findings under rules read from a document: defaults, unknown keys, own values."""
    document = {
        "boundaries": [],
        "thresholds": {"coupling_warning_fan_out": 5, "coupling_critical_fan_out": 12, "spare": 1},
        "ignore": {"dead_code": ["**/*.test.*", "src/types/**"], "drift": None, "coupling": ["**"]},
        "unknown": {"a": 1},
    }
    rules = Rules.from_mapping(document)
    return _flat(_findings(spark, folder, rules=rules, only="dead_code,coupling,architectural_drift"))


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break the contract: numbers that end in 7 lose their name, in 3 their file."""
    defs = definitions(spark, folder)
    number = F.regexp_extract("name", "([0-9]+)", 1)
    holes = defs.select(
        F.when(number.endswith("7"), F.lit(None)).otherwise(F.col("name")).alias("name"),
        F.when(number.endswith("3"), F.lit(None)).otherwise(F.col("file")).alias("file"),
        "kind",
        "line",
    )
    return rejected_rows(holes, DEFINITIONS)


def report_document_query(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder)
    return report_document(found, graph_stats(spark, folder), "derived", "1", "now")


def findings_trend(spark: SparkSession, folder: str) -> DataFrame:
    runs = [("2024-01-01", "layered"), ("2024-02-01", "sparse")]
    rows = [
        compare.history_rows(_findings(spark, folder, name), F.lit(day)) for day, name in runs
    ]
    return compare.findings_trend(rows[0].unionByName(rows[1]))


def _rules_by_file() -> Rules:
    """A rule for each of fifty files of a hundred modules, some wide ones around them."""
    by_file = [
        BoundaryRule(
            f"m{m}f{f}",
            f"src/mod{m}/f{f}.rs",
            (f"src/mod{m}/**", f"src/mod{(m + 1) % 100}/f{f}*", "**/index.ts"),
        )
        for f in range(50)
        for m in range(100)
    ]
    first = BoundaryRule("Tens", "src/mod7/f1?.rs", ("src/types/**",))
    last = (BoundaryRule("Go", "**/*.go"), BoundaryRule("Rest", "src/**", ("src/mod1*/**",)))
    return Rules(boundaries=(first, *by_file, *last), ignore=Ignore(drift=("src/models/**",)))


def drift_many_rules(spark: SparkSession, folder: str) -> DataFrame:
    """5,003 boundary rules, met as rows."""
    return drift(references(spark, folder), _rules_by_file())


def drift_boundary_many_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rule that governs each file, of 5,003."""
    files = _all_files(references(spark, folder))
    boundaries = _rules_by_file().effective_boundaries
    return governing_rules(files, "file", boundaries).select(
        "file", F.col("rule").alias("rule_index"), "boundary_name"
    )


def drift_long_allow_list(spark: SparkSession, folder: str) -> DataFrame:
    """One rule whose allowed imports name every second file of every module."""
    allowed = [f"src/mod{m}/f{f}.rs" for m in range(100) for f in range(0, 50, 2)]
    rule = BoundaryRule("Listed", "src/mod*", tuple(allowed))
    return drift(references(spark, folder), Rules(boundaries=(rule,)))


def report_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown report with its line numbers."""
    lines = report.report_lines(
        _findings(spark, folder), graph_stats(spark, folder), "derived", "now", "1"
    )
    return report.numbered_lines(lines)


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """The report as the lines of one JSON document."""
    return document_lines(_findings(spark, folder), graph_stats(spark, folder), "derived", "1", "now")


def findings_history(spark: SparkSession, folder: str) -> DataFrame:
    """The trend over a stored history of two runs, the second of which was appended twice."""
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid4()}"
    runs = [("2024-01-01", "layered"), ("2024-02-01", "layered"), ("2024-02-01", "sparse")]
    for day, name in runs:
        append_history(compare.history_rows(_findings(spark, folder, name), F.lit(day)), path)
    return compare.findings_trend(read_history(spark, path))


def findings_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Findings written and read back, in three formats."""
    path = f"{ensure_checkpoint_dir(spark)}/findings-{uuid4()}"
    found = cut_lineage(_findings(spark, folder))[0]
    for fmt in ("parquet", "orc", "json"):
        write_findings(found, f"{path}/{fmt}", fmt)
    tables = [spark.read.schema(found.schema).format(fmt).load(f"{path}/{fmt}") for fmt in ("parquet", "orc")]
    objects = spark.read.schema(found.drop("finding_id", "diff_key", "severity_rank").schema.add("id", "string"))
    tables.append(objects.json(f"{path}/json").withColumnRenamed("id", "finding_id"))
    parts = [
        table.select(
            F.lit(fmt).alias("format"),
            "finding_id",
            "severity",
            "category",
            "location.*",
            "description",
            "remediation",
            F.array_join("related.dependencies", ",").alias("dependencies"),
        )
        for fmt, table in zip(("parquet", "orc", "json"), tables, strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Query] = {
    "module_of_files": module_of_files,
    "file_edges": file_edges,
    "module_edges": module_edges,
    "module_links": module_links,
    "fan_out": fan_out,
    "graph_stats": graph_stats,
    "schema_contract": schema_contract,
    "dead_code_unreferenced": dead_code_unreferenced,
    "dead_code": dead_code_query,
    "dead_code_ignoring": dead_code_ignoring,
    "dead_code_severity": dead_code_severity_query,
    "dead_code_total": dead_code_total_query,
    "glob_match": glob_match,
    "drift_boundary_of_file": drift_boundary_of_file,
    "drift_import_allowed": drift_import_allowed,
    "architectural_drift": architectural_drift,
    "drift_overlapping_rules": drift_overlapping_rules,
    "pair_cycles": pair_cycles,
    "long_cycles": long_cycles,
    "long_cycles_ring": long_cycles_ring,
    "cycle_canonical": cycle_canonical,
    "cycle_weakest_edge": cycle_weakest_edge,
    "pair_cycle_evidence": pair_cycle_evidence_query,
    "coupling": coupling_query,
    "coupling_dependencies": coupling_dependencies_query,
    "all_findings": all_findings,
    "findings_custom_rules": findings_custom_rules,
    "findings_min_severity": findings_min_severity,
    "report_summary": report_summary,
    "severity_counts": severity_counts,
    "recommendations": recommendations,
    "report_lines": report_lines,
    "ci_gate": ci_gate,
    "findings_json": findings_json_query,
    "code_quality": code_quality,
    "findings_diff": findings_diff,
    "findings_trend": findings_trend,
    "rules_from_mapping": rules_from_mapping,
    "rejected_rows": rejected,
    "report_document": report_document_query,
    "drift_many_rules": drift_many_rules,
    "drift_boundary_many_rules": drift_boundary_many_rules,
    "drift_long_allow_list": drift_long_allow_list,
    "report_numbered": report_numbered,
    "report_json": report_json,
    "findings_history": findings_history,
    "findings_stored": findings_stored,
}
