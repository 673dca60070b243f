import glob
import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from modgauge import analyze
from modgauge.plans.compare import code_quality, findings_diff, findings_trend, history_rows
from modgauge.plans.findings import at_least
from modgauge.plans.report import (
    LINE_KEYS,
    ci_gate,
    numbered_lines,
    recommendations,
    report_lines,
    report_summary,
    severity_counts,
)
from modgauge.operators.graph import graph_stats
from modgauge.schema import FINDINGS
from modgauge.sinks.writers import (
    append_history,
    document_lines,
    findings_json,
    read_history,
    report_document,
    write_document,
    write_findings,
    write_report,
)


SENTENCES = {
    "dead_code": (
        "Class `Relic` in src/old/relic.rs has no references in the codebase.",
        "Public class `Relic` is exported but never used. Consider removing it or documenting "
        "its purpose if it is part of a public API surface.",
    ),
    "circular_dependency": (
        "Circular dependency between `domain` and `x`: 2 cross-references "
        "(domain -> x, x -> domain).",
        "Extract shared code into a third module that both `domain` and `x` depend on "
        "(dependency inversion principle). Alternatively, use an event/callback pattern to "
        "break the direct coupling.",
    ),
    "high_coupling": (
        "Module `wide` has a fan-out of 8, depending on 8 other modules: `t0`, `t1`, `t2`, "
        "`t3`, `t4`, `t5`, `t6`, `t7`.",
        "Module `wide` has moderate coupling (8 dependencies). Review whether all dependencies "
        "are necessary. Consider using dependency injection or the mediator pattern to reduce "
        "direct coupling.",
    ),
    "architectural_drift": (
        '`caller0` (in src/domain/a.rs, governed by "Domain Layer" boundary) imports `B` from '
        "`src/x/b.rs`, which is outside the allowed import scope.",
        "Move `B` to a location within the allowed boundary, or refactor to use an "
        'interface/abstraction defined within the "Domain Layer" boundary. Consider applying '
        'the dependency inversion principle: define a trait or protocol inside "Domain Layer" '
        "that `B` in `src/x/b.rs` can implement.",
    ),
}
ADVICE_LINES = [
    "1. **Remove dead code**: 1 unused definitions found. Start with public API surfaces "
    "(critical) and work inward. Run this check regularly in CI to prevent accumulation.",
    "2. **Break circular dependencies**: 1 cycle(s) detected. Apply the dependency inversion "
    "principle — introduce interfaces or abstract modules that both sides depend on instead "
    "of each other.",
    "3. **Reduce module coupling**: 1 module(s) with high fan-out. Consider the facade pattern "
    "for high-coupling modules to reduce direct dependency count and improve change isolation.",
    "4. **Enforce architecture boundaries**: 1 drift violation(s) found. Add explicit boundary "
    "rules to the configuration and run this in CI to prevent new violations from being merged.",
]


@pytest.fixture
def graph(definitions_of, references_of):
    defs = definitions_of(
        [("Foo", "src/a/foo.rs", "class", 3), ("main", "src/a/run.rs", "function", None)]
    )
    refs = references_of(
        [
            ("src/a/x.rs", "src/b/y.rs"),
            ("src/b/y.rs", "src/a/x.rs"),
            ("src/domain/d.rs", "src/a/x.rs"),
        ]
    )
    return defs, refs


@pytest.fixture
def findings(graph):
    return analyze(*graph)


def lines_of(findings, stats, **options):
    lines = report_lines(findings, stats, **options)
    return [r["line"] for r in lines.orderBy(*LINE_KEYS).select("line").collect()]


def test_all_checks_meet_in_one_table(findings):
    assert findings.columns == FINDINGS.fieldNames()
    got = {(r["category"], r["severity"], r["location"]["name"]) for r in findings.collect()}
    assert got == {
        ("dead_code", "critical", "Foo"),
        ("dead_code", "info", "main"),
        ("circular_dependency", "warning", "a <-> b"),
        ("architectural_drift", "warning", "caller2"),
    }


def test_selection_and_minimum_severity(graph):
    assert {r["category"] for r in analyze(*graph, only="dead_code").collect()} == {"dead_code"}
    assert analyze(*graph, only="nothing").isEmpty()
    assert analyze(*graph, min_severity="CRITICAL").count() == 1
    assert analyze(*graph, min_severity="warning").count() == 3
    assert analyze(*graph, min_severity="odd").count() == 4


def test_rows_with_nulls_stay_out_of_the_checks_that_read_them(graph, references_of):
    defs, refs = graph
    refs = refs.unionByName(references_of([(None, "src/a/x.rs"), ("src/domain/d.rs", None)]))
    assert analyze(defs, refs).count() == 4


def test_ids_are_stable_and_distinct(graph):
    first = {r["finding_id"] for r in analyze(*graph).collect()}
    again = {r["finding_id"] for r in analyze(*graph).collect()}
    assert first == again and len(first) == 4


def test_summary_counts_gate(findings):
    assert [tuple(r) for r in report_summary(findings).orderBy("category_no").collect()] == [
        (0, "dead_code", 2, "critical"),
        (1, "circular_dependency", 1, "warning"),
        (2, "high_coupling", 0, "info"),
        (3, "architectural_drift", 1, "warning"),
    ]
    assert tuple(severity_counts(findings).first()) == (1, 2, 1, 4, "critical")
    assert tuple(ci_gate(findings).first()) == (1, True)
    assert tuple(ci_gate(findings.filter("severity <> 'critical'")).first()) == (0, False)
    assert severity_counts(findings.limit(0)).first()["worst_severity"] == "info"


def test_recommendations(findings):
    rows = recommendations(findings).orderBy("advice_no").collect()
    assert [r["category"] for r in rows] == [
        "dead_code",
        "circular_dependency",
        "architectural_drift",
    ]
    assert rows[0]["advice"].startswith("1. **Remove dead code**: 2 unused definitions found.")
    assert rows[2]["advice"].startswith("3. **Enforce architecture boundaries**: 1 drift")
    assert recommendations(findings.filter("severity = 'info'")).isEmpty()


def test_report(spark, graph, findings):
    stats = graph_stats(spark, *graph)
    lines = lines_of(findings, stats, repository="demo", timestamp="T", version="7")
    text = "\n".join(lines)
    assert lines[:7] == [
        "# Code Health Report",
        "",
        "**Repository**: demo",
        "**Timestamp**: T",
        "**Graph Size**: 2 nodes, 3 edges",
        "**Report Version**: 7",
        "",
    ]
    assert "| Dead Code | 2 | critical |" in lines
    assert "| High Coupling Modules | 0 | info |" in lines
    assert "| **Total** | **4** | 1 critical, 2 warning, 1 info |" in lines
    assert [x for x in lines if x.startswith("## ")] == [
        "## Summary",
        "## Dead Code",
        "## Circular Dependencies",
        "## Architectural Drift",
        "## Recommendations",
    ]
    assert (
        "- **CRITICAL** [`Foo`](src/a/foo.rs:3) — Class `Foo` in src/a/foo.rs has no "
        "references in the codebase.\n  - _Suggestion_: Public class `Foo`" in text
    )
    assert "- **INFO** [`main`](src/a/run.rs) — " in text


def test_report_when_clear_or_only_informed(spark, graph, findings):
    stats = graph_stats(spark, *graph)
    clear = lines_of(findings.limit(0), stats)
    assert "## All Clear" in clear and "## Recommendations" not in clear
    informed = lines_of(findings.filter("severity = 'info'"), stats)
    assert not {"## All Clear", "## Recommendations"} & set(informed)


def test_json(findings):
    rows = {
        json.loads(r["json"])["location"]["name"]: json.loads(r["json"])
        for r in findings_json(findings).collect()
    }
    assert rows["main"]["location"] == {"file": "src/a/run.rs", "line": None, "name": "main"}
    assert rows["main"]["related"] == {"kind": "function"}
    assert rows["a <-> b"]["related"] == {"other_module": "b", "cycle_count": 2}
    assert list(rows["Foo"]) == [
        "id",
        "severity",
        "category",
        "location",
        "description",
        "remediation",
        "related",
    ]


def test_sinks(spark, graph, findings, tmp_path):
    write_findings(findings, str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.count() == 4
    write_findings(stored, str(tmp_path / "json"), fmt="json")
    assert spark.read.text(str(tmp_path / "json")).count() == 4
    stats = graph_stats(spark, *graph)
    write_report(report_lines(stored, stats), str(tmp_path / "report"))
    text = spark.read.text(str(tmp_path / "report"))
    assert text.filter("value = '# Code Health Report'").count() == 1
    document = json.loads(report_document(stored, stats, "demo").first()["json"])
    assert document["graph_stats"] == {"nodes": 2, "edges": 3}
    assert (document["repository"], document["finding_count"]) == ("demo", 4)


def test_diff_ignores_lines(graph, definitions_of, references_of):
    defs, refs = graph
    moved = definitions_of(
        [("Foo", "src/a/foo.rs", "class", 99), ("New", "src/a/new.rs", "enum", 1)]
    )
    rows = findings_diff(analyze(defs, refs), analyze(moved, refs)).collect()
    assert {(r["change"], r["name"]) for r in rows} == {("new", "New"), ("resolved", "main")}


def test_trend(findings):
    history = history_rows(findings, F.lit("d1")).unionByName(
        history_rows(at_least(findings, "critical"), F.lit("d2"))
    )
    rows = {
        (r["run_ts"], r["category"]): (r["previous_count"], r["change"])
        for r in findings_trend(history).collect()
    }
    assert rows[("d1", "dead_code")] == (None, None)
    assert rows[("d2", "dead_code")] == (2, -1)
    assert rows[("d2", "high_coupling")] == (0, 0)


def test_code_quality(findings):
    rows = {r["description"][:5]: r for r in code_quality(findings).collect()}
    assert rows["Class"]["severity"] == "critical"
    assert rows["Circu"]["severity"] == "minor"
    assert rows["Class"]["location"]["lines"]["begin"] == 3
    assert rows["Circu"]["location"]["lines"]["begin"] == 1


def test_lines_of_equal_findings_follow_each_other(spark, definitions_of, references_of, tmp_path):
    defs = definitions_of([("Twin", "src/m/t.rs", "class", 4)] * 3)
    refs = references_of([("src/domain/a.rs", "src/x/b.rs", "B")])
    refs = refs.unionByName(refs).unionByName(refs)
    found = analyze(defs, refs)
    path = str(tmp_path / "report")
    write_report(report_lines(found, graph_stats(spark, defs, refs)), path)
    lines = [r[0] for r in spark.read.text(path).collect() if r[0].startswith(("- **", "  - _"))]
    kinds = ["bullet" if line.startswith("- **") else "suggestion" for line in lines]
    assert kinds == ["bullet", "suggestion"] * 6


def test_sentences_are_what_they_should_be(definitions_of, references_of):
    """Written out here, as the SQL oracle shares the templates with the checks."""
    defs = definitions_of([("Relic", "src/old/relic.rs", "class", 7)])
    refs = references_of(
        [("src/domain/a.rs", "src/x/b.rs", "B")]
        + [("src/x/b.rs", "src/domain/a.rs", "A")]
        + [("src/wide/w.rs", f"src/t{i}/f.rs") for i in range(8)]
    )
    found = analyze(defs, refs)
    said = {r["category"]: (r["description"], r["remediation"]) for r in found.collect()}
    assert said == SENTENCES
    assert [r["advice"] for r in recommendations(found).orderBy("advice_no").collect()] == ADVICE_LINES


def test_counts_read_no_texts(graph):
    found = analyze(*graph)
    for small in (report_summary(found), severity_counts(found), ci_gate(found)):
        plan = plan_of(small)
        assert "sha2" not in plan and "has no references" not in plan


def test_document_is_one_json_value(spark, graph, findings, tmp_path):
    stats = graph_stats(spark, *graph)
    for name, found in (("all", findings.repartition(5)), ("none", findings.limit(0))):
        path = str(tmp_path / name)
        write_document(document_lines(found, stats, 'a "demo"', "7", "T"), path)
        files = sorted(glob.glob(f"{path}/part-*"))
        document = json.loads("".join(open(file, encoding="utf-8").read() for file in files))
        assert {k: v for k, v in document.items() if k != "findings"} == {
            "version": "7", "timestamp": "T", "repository": 'a "demo"', "graph_stats": {"nodes": 2, "edges": 3},
        }
        objects = [json.loads(r["json"]) for r in findings_json(found).collect()]
        assert sorted(map(str, document["findings"])) == sorted(map(str, objects))
    names = [f["location"]["name"] for f in json.loads(
        "\n".join(r["line"] for r in document_lines(findings, stats).orderBy("line_no").collect())
    )["findings"]]
    assert names == ["Foo", "main", "a <-> b", "caller2"]


def test_numbered_lines_are_the_report(spark, graph, findings):
    lines = report_lines(findings, graph_stats(spark, *graph), "demo", "T", "7")
    got = sorted(map(tuple, numbered_lines(lines.repartition(6)).select("line_no", "line").collect()))
    assert [n for n, _ in got] == list(range(1, len(got) + 1))
    assert [line for _, line in got] == "\n".join(lines_of(findings, graph_stats(spark, *graph), repository="demo", timestamp="T", version="7")).split("\n")


def test_numbered_lines_of_equal_findings(spark, definitions_of, references_of):
    defs = definitions_of([("Twin", "src/m/t.rs", "class", 4)] * 3)
    refs = references_of([("src/domain/a.rs", "src/x/b.rs", "B")] * 2)
    found = analyze(defs, refs)
    rows = numbered_lines(report_lines(found, graph_stats(spark, defs, refs))).orderBy("line_no").collect()
    kinds = [r["line"][:4] for r in rows if r["line"].startswith(("- **", "  - _"))]
    assert kinds == ["- **", "  - "] * 5


def test_a_run_appended_twice_counts_once(spark, findings, tmp_path):
    path = str(tmp_path / "history")
    append_history(history_rows(findings, F.lit("2024-01-01")), path)
    append_history(history_rows(findings.limit(0), F.lit("2024-02-01")), path)
    append_history(history_rows(at_least(findings, "critical"), F.lit("2024-02-01")), path)
    history = read_history(spark, path)
    assert {r["run_ts"]: r["n"] for r in history.groupBy("run_ts").agg(F.sum("finding_count").alias("n")).collect()} == {
        "2024-01-01": 4, "2024-02-01": 1,
    }
    assert history.count() == 8
    assert {(r["run_ts"], r["change"]) for r in findings_trend(history).filter("category = 'dead_code'").collect()} == {
        ("2024-01-01", None), ("2024-02-01", -1),
    }
