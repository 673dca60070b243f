import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from modgauge.config import Ignore, Rules
from modgauge.operators import skew
from modgauge.operators.dead_code import dead_code, dead_code_total, unreferenced
from modgauge.plans.findings import dead_code_findings

DEFINITIONS = [
    ("Foo", "src/a/foo.rs", "class", 1),
    ("bar", "src/a/bar.rs", "function", None),
    ("bar", "src/b/bar.rs", "method", 3),
    ("main", "src/a/run.rs", "function", 1),
    ("test_x", "src/a/t.rs", "class", 2),
    ("latest", "src/a/l.rs", "function", 4),
    ("Used", "src/a/u.rs", "struct", 1),
    ("Used", "src/z/u.rs", "enum", 1),
    ("Hidden", "src/a/mod.rs", "class", 1),
    ("LIMIT", "src/a/c.rs", "constant", 1),
]
USED = [("src/q/a.rs", "src/z/u.rs", "Used")]


def test_severities(definitions_of, references_of):
    found = dead_code(definitions_of(DEFINITIONS), references_of(USED)).collect()
    assert {(r["name"], r["file"]): r["severity"] for r in found} == {
        ("Foo", "src/a/foo.rs"): "critical",
        ("bar", "src/a/bar.rs"): "warning",
        ("bar", "src/b/bar.rs"): "warning",
        ("main", "src/a/run.rs"): "info",
        ("test_x", "src/a/t.rs"): "info",
        ("latest", "src/a/l.rs"): "warning",
    }


def test_null_target_empties_the_result(definitions_of, references_of):
    defs = definitions_of(DEFINITIONS)
    refs = references_of(USED + [("src/q/a.rs", "src/z/u.rs", None)])
    assert dead_code(defs, refs).isEmpty()


def test_without_references_everything_reportable_is_dead(definitions_of, references_of):
    assert dead_code(definitions_of(DEFINITIONS), references_of([])).count() == 8


@pytest.mark.parametrize("targets", [[], ["x"], ["x", None], [None]])
def test_null_rules_equal_not_in(spark, definitions_of, references_of, targets):
    defs = definitions_of([("x", "f", "class", 1), ("y", "f", "class", 1), (None, "f", "class", 1)])
    refs = references_of([("a", "b", t) for t in targets])
    defs.createOrReplaceTempView("defs_v")
    refs.createOrReplaceTempView("refs_v")
    expected = spark.sql(
        "SELECT name FROM defs_v WHERE name NOT IN (SELECT target_name FROM refs_v)"
    )
    got = unreferenced(defs, refs).select("name")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_ignore_globs(definitions_of, references_of):
    rules = Rules(ignore=Ignore(dead_code=("src/a/**", "broken**"), drift=("src/b/**",)))
    found = dead_code(definitions_of(DEFINITIONS), references_of(USED), rules)
    assert [r["file"] for r in found.collect()] == ["src/b/bar.rs"]


def test_texts(definitions_of, references_of):
    found = dead_code_findings(dead_code(definitions_of(DEFINITIONS), references_of(USED)))
    by_name = {r["location"]["file"]: r for r in found.collect()}
    foo, bar = by_name["src/a/foo.rs"], by_name["src/a/bar.rs"]
    assert foo["description"] == "Class `Foo` in src/a/foo.rs has no references in the codebase."
    assert foo["remediation"].startswith("Public class `Foo` is exported but never used.")
    assert bar["remediation"].startswith("Function `bar` appears unused.")
    assert foo["related"]["kind"] == "class"
    assert foo["severity_rank"] == 2
    assert bar["location"]["line"] is None


def test_total_escalates(definitions_of, references_of):
    for count, level in ((19, "info"), (20, "warning"), (49, "warning"), (50, "critical")):
        defs = definitions_of([(f"n{i}", "f.rs", "class", 1) for i in range(count)])
        row = dead_code_total(dead_code(defs, references_of([]))).first()
        assert tuple(row) == (count, level)


def test_referenced_names_need_not_fit_a_broadcast(spark, definitions_of, references_of):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(dead_code(definitions_of(DEFINITIONS), references_of(USED)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only the hot names, fewer than a thousand, are ever broadcast.
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("BroadcastHashJoin") == 2
    assert plan.count("BroadcastHashJoin [name") == plan.count("LeftOuter, BuildRight") == 2


def test_common_definition_name_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 1000)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        defs = spark.range(0, 40000, 1, 8).selectExpr(
            "IF(id % 3 > 0, 'hot', concat('n', id)) AS name",
            "concat('src/m/f', id) AS file",
            "'function' AS kind",
            "id AS line",
        )
        refs = spark.range(2000).selectExpr(
            "'a' AS source_file",
            "'b' AS source_name",
            "'c' AS target_file",
            "concat('n', id * 3) AS target_name",
        )
        salts = {r["name"]: r["_salts"] for r in skew.hot_keys(defs, "name").collect()}
        assert salts == {"hot": 27}  # a task for every thousand rows
        found = dead_code(defs, refs)
        hot = found.filter("name = 'hot'")
        assert found.count() == 40000 - 2000
        per_task = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 40000 - 13334
        # 27 parts, placed by hash: none of the 8 tasks holds as much as a third.
        assert len(per_task) == 8 and max(per_task) < sum(per_task) / 3
        # Hot but referenced: all its definitions are alive.
        alive = refs.unionByName(refs.limit(1).withColumn("target_name", F.lit("hot")))
        assert dead_code(defs, alive).count() == 13334 - 2000
    finally:
        for key in settings:
            spark.conf.unset(key)
