import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from modgauge.config import Thresholds
from modgauge.operators.bitset import key_bits, may_hold
from modgauge.operators.coupling import coupling, coupling_dependencies
from modgauge.operators.evidence import pair_cycle_evidence
from modgauge.operators.cycles import pair_cycles
from modgauge.operators.graph import fan_out, file_edges, module_edges, module_links
from modgauge.plans.findings import coupling_findings
from modgauge.sinks.writers import findings_json


def fan(module, n):
    return [(module, f"d{i:04d}", 1) for i in range(n)]


def test_thresholds(edges_of):
    edges = edges_of(fan("a", 7) + fan("b", 8) + fan("c", 14) + fan("d", 15))
    got = {r["module"]: (r["fan_out"], r["severity"]) for r in coupling(edges).collect()}
    assert got == {"b": (8, "warning"), "c": (14, "warning"), "d": (15, "critical")}


def test_critical_not_above_warning(edges_of):
    limits = Thresholds(coupling_warning_fan_out=3, coupling_critical_fan_out=2)
    got = coupling(edges_of(fan("a", 3)), limits).collect()
    assert [r["severity"] for r in got] == ["critical"]


@pytest.mark.parametrize("n,ending", [(10, "`d0009`."), (11, "`d0009` and 1 more.")])
def test_listed_dependencies(edges_of, n, ending):
    row = coupling_findings(coupling(edges_of(fan("a", n)))).first()
    assert row["description"].startswith(
        f"Module `a` has a fan-out of {n}, depending on {n} other modules: `d0000`, `d0001`"
    )
    assert row["description"].endswith(ending)
    assert row["related"]["dependencies"] == [f"d{i:04d}" for i in range(n)]
    assert (row["location"]["file"], row["location"]["name"]) == ("a/", "a")


@pytest.mark.parametrize("n", [1005, 5000])
def test_every_dependency_of_a_huge_module_is_kept(edges_of, n):
    edges, names = edges_of(fan("a", n)), [f"d{i:04d}" for i in range(n)]
    row = coupling(edges).first()
    assert (row["fan_out"], row["dependencies"]) == (n, names)
    finding = coupling_findings(coupling(edges))
    assert finding.first()["related"]["dependencies"] == names
    assert json.loads(findings_json(finding).first()["json"])["related"]["dependencies"] == names
    assert {r["dependency"] for r in coupling_dependencies(edges).collect()} == set(names)


def test_edges_are_dropped_before_they_are_listed(edges_of):
    plan = plan_of(coupling(edges_of(fan("a", 9) + fan("b", 2))))
    listing = plan.index("collect_list")
    dropping = plan.index("getbit")
    assert listing < dropping  # a plan is printed from its last step to its first
    assert "Exchange" in plan[listing:dropping]


def test_bits_hold_every_key_and_drop_most_others(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) AS key")
    bits = key_bits(keys, "key")
    rows = spark.range(20_000).selectExpr("concat('k', id) AS key").filter(may_hold(bits, F.col("key")))
    passed = {r["key"] for r in rows.collect()}
    assert {f"k{i}" for i in range(2000)} <= passed and len(passed) < 2200
    none = key_bits(keys.limit(0), "key")
    assert keys.filter(may_hold(none, F.col("key"))).count() == 0


def test_graph_tables(references_of):
    refs = references_of(
        [("src/a/1.rs", "src/b/1.rs")] * 3
        + [("src/a/2.rs", "src/b/1.rs"), ("src/a/1.rs", "src/a/2.rs")]
        + [("src/a/1.rs", "src/a/1.rs"), ("x.rs", "lib/y.rs"), ("x.rs", None)]
    )
    assert {tuple(r) for r in module_edges(refs).collect()} == {
        ("a", "b", 4, 2),
        ("root", "lib", 1, 1),
    }
    assert {tuple(r) for r in module_links(refs).collect()} == {
        ("a", "b", 4),
        ("root", "lib", 1),
    }
    assert ("src/a/1.rs", "src/a/1.rs", 1) in {tuple(r) for r in file_edges(refs).collect()}
    assert {tuple(r) for r in fan_out(module_links(refs)).collect()} == {("a", 1), ("root", 1)}


def test_evidence_takes_the_heaviest_file_pairs(references_of):
    refs = references_of(
        [("src/a/1.rs", "src/b/1.rs")] * 3
        + [("src/a/2.rs", "src/b/1.rs")] * 2
        + [("src/a/3.rs", "src/b/1.rs")] * 2
        + [("src/b/1.rs", "src/a/9.rs"), ("src/a/1.rs", "src/c/1.rs")]
    )
    pairs = pair_cycles(module_links(refs))
    rows = pair_cycle_evidence(file_edges(refs), pairs, k=2).collect()
    assert {(r["rank"], r["source_file"], r["target_file"], r["ref_count"]) for r in rows} == {
        (1, "src/a/1.rs", "src/b/1.rs", 3),
        (2, "src/a/2.rs", "src/b/1.rs", 2),
        (1, "src/b/1.rs", "src/a/9.rs", 1),
    }
