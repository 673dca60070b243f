"""Rules as rows against the same rules in one expression, and thousands of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from modgauge.config import BoundaryRule, Ignore, Rules
from modgauge.functions.globs import matches_glob
from modgauge.operators import drift as plain
from modgauge.operators.drift import drift, governing_rule
from modgauge.operators.drift_index import drift_by_index, governing_rules
from modgauge.operators.glob_index import glob_table, matches

PARTS = ["app", "core", "lib.d", "x", "a b", "Ä"]
NAMES = ["f1.rs", "f2.test.ts", "index.ts", "noending", ".hidden", "end.", "f[1].go"]
GLOBS = [
    "**", "*", "", "app/**", "**/f1.rs", "*.ts", "app/*/f?.rs", "**/*.test.*", "core/lib.d/index.ts", "co*", "*x*",
    "app/[a-c]*", "**/lib.d/**", "?pp/**", "end.", "*end.", "**/end.", "*.", "[", "a**", "app/x/", "**/app/**/f1.rs",
    "Ä/**", "a b/*", "f[[]1].go", ".hidden", "**/.hidden",
]


def paths(seed, n=150):
    rng = random.Random(seed)
    found = {"", "/", "a", "/app/f1.rs", "./app/f1.rs", "app//f1.rs", "f1.rs", "app/x/"}
    while len(found) < n:
        found.add("/".join([*rng.choices(PARTS, k=rng.randrange(0, 4)), rng.choice(NAMES)]))
    return sorted(found)


def test_index_matches_what_each_glob_matches(spark):
    files = spark.createDataFrame([(p,) for p in paths(1)] + [(None,)], "path string")
    got = {(r["path"], r["rule"]) for r in matches(files, "path", glob_table(spark, enumerate(GLOBS))).collect()}
    expected = set()
    tests = [matches_glob(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(GLOBS)]
    for r in files.select("path", *tests).collect():
        expected |= {(r["path"], i) for i in range(len(GLOBS)) if r[f"g{i}"]}
    assert got == expected


def random_rules(seed):
    rng = random.Random(seed)
    boundaries = tuple(
        BoundaryRule(f"r{i}", rng.choice(GLOBS), tuple(rng.sample(GLOBS, rng.randrange(0, 4)))) for i in range(6)
    )
    return Rules(boundaries=boundaries, ignore=Ignore(drift=tuple(rng.sample(GLOBS[3:], seed % 3))))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_chain(spark, references_of, seed):
    rng, files = random.Random(seed), paths(seed, 60)
    rows = [(rng.choice(files), rng.choice([*files, None])) for _ in range(400)]
    refs = references_of(rows + rows[:50] + [(None, "app/f1.rs")])
    rules = random_rules(seed)
    expected = sorted(map(str, drift(refs, rules).collect()))
    assert sorted(map(str, drift_by_index(refs, rules).collect())) == expected
    assert expected


def test_first_rule_governs(spark):
    files = spark.createDataFrame([(p,) for p in paths(4)] * 2, "path string")
    rules = random_rules(5).boundaries
    rule = governing_rule(F.col("path"), rules)
    chain = files.distinct().select("path", rule["index"], rule["name"], rule["pattern"]).filter(rule.isNotNull())
    assert {tuple(r) for r in governing_rules(files, "path", rules).collect()} == {tuple(r) for r in chain.collect()}


def test_thousands_of_rules_are_planned_in_seconds(spark, references_of, tmp_path):
    boundaries = tuple(
        BoundaryRule(f"m{i}", f"src/m{i}/**", (f"src/m{i}/**", "src/shared/**", f"lib/l{i}*.rs")) for i in range(5000)
    )
    rows = [(f"src/m{i * 7}/a.rs", t) for i in range(700) for t in (f"src/m{i * 7}/b.rs", f"lib/l{i * 7}x.rs", f"src/m{i}/c.rs")]
    references_of(rows).write.parquet(str(tmp_path / "refs"))
    refs = spark.read.parquet(str(tmp_path / "refs"))
    started = time.monotonic()
    found = drift(refs, Rules(boundaries=boundaries))
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {(r["source_file"], r["target_file"], r["boundary_name"]) for r in found.collect()}
    assert time.monotonic() - started < 60
    assert got == {(f"src/m{i * 7}/a.rs", f"src/m{i}/c.rs", f"m{i * 7}") for i in range(1, 700)}


def test_choice_of_the_way(monkeypatch, references_of):
    used = []
    monkeypatch.setattr(plain, "drift_by_index", lambda *a: used.append(a) or drift_by_index(*a))
    refs = references_of([("src/domain/a.rs", "src/x/b.rs")])
    long_list = BoundaryRule("Domain", "src/domain/**", tuple(f"src/y{i}/*.rs" for i in range(plain.GLOBS_IN_PLAN)))
    assert drift(refs).count() == 1 and not used
    assert drift(refs, Rules(boundaries=(long_list,))).count() == 1 and len(used) == 1
