from pyspark.sql import functions as F

from conftest import plan_of
from modgauge.config import BoundaryRule, Ignore, Rules
from modgauge.operators.drift import drift, governing_rule, import_allowed
from modgauge.plans.findings import drift_findings


def broken(refs, rules=Rules()):
    return {
        (r["source_file"], r["target_file"], r["boundary_name"])
        for r in drift(refs, rules).collect()
    }


def test_default_rules(references_of):
    refs = references_of(
        [
            ("src/domain/a.rs", "src/infrastructure/db.rs"),
            ("src/domain/a.rs", "src/types/id.rs"),
            ("src/application/s.rs", "src/presentation/v.rs"),
            ("src/presentation/v.rs", "src/application/s.rs"),
            ("src/presentation/v.rs", "src/infrastructure/db.rs"),
            ("src/presentation/v.rs", "src/presentation/w.rs"),
            ("src/other/x.rs", "src/domain/a.rs"),
            ("./src/domain/a.rs", "src/infrastructure/db.rs"),
            ("src/domain/a.rs", "src/domain/a.rs"),
            ("src/domain/a.rs", None),
        ]
    )
    assert broken(refs) == {
        ("src/domain/a.rs", "src/infrastructure/db.rs", "Domain Layer"),
        ("src/application/s.rs", "src/presentation/v.rs", "Application Layer"),
        ("src/presentation/v.rs", "src/infrastructure/db.rs", "Presentation Layer"),
        ("src/presentation/v.rs", "src/presentation/w.rs", "Presentation Layer"),
    }


def test_first_matching_rule_decides(references_of):
    refs = references_of([("src/domain/a.rs", "src/infrastructure/db.rs")])
    wide = BoundaryRule("All", "src/**", ("src/**",))
    closed = BoundaryRule("Domain", "src/domain/**")
    assert broken(refs, Rules(boundaries=(wide, closed))) == set()
    assert {b[2] for b in broken(refs, Rules(boundaries=(closed, wide)))} == {"Domain"}


def test_malformed_globs_never_match(references_of):
    refs = references_of([("src/domain/a.rs", "src/x/b.rs")])
    bad_pattern = BoundaryRule("Bad", "src/domain**")
    bad_import = BoundaryRule("Domain", "src/domain/**", ("[", "src/x**"))
    assert broken(refs, Rules(boundaries=(bad_pattern,))) == set()
    assert len(broken(refs, Rules(boundaries=(bad_pattern, bad_import)))) == 1


def test_ignore_looks_at_the_source_file_only(references_of):
    refs = references_of(
        [("src/domain/gen/a.rs", "src/x/b.rs"), ("src/domain/a.rs", "src/domain.gen/b.rs")]
    )
    rules = Rules(ignore=Ignore(drift=("**/gen/**", "src/domain.gen/**"), dead_code=("**",)))
    assert {b[0] for b in broken(refs, rules)} == {"src/domain/a.rs"}


def test_governing_rule_and_three_valued_verdict(spark):
    rules = (
        BoundaryRule("Engine", "core/engine/*", ("core/*", "std/**")),
        BoundaryRule("Rest of core", "core/**", ("core/[a-m]*", "plugins/api.py")),
        BoundaryRule("Sealed", "**/*.lock"),
    )
    pairs = [
        ("core/engine/run.py", "core/io.py", "Engine", True),
        ("core/engine/deep/run.py", "std/os/path.py", "Engine", True),
        ("core/engine/run.py", "plugins/api.py", "Engine", False),
        ("core/io.py", "plugins/api.py", "Rest of core", True),
        ("core/io.py", "core/net.py", "Rest of core", False),
        ("deps/all.lock", "deps/all.lock", "Sealed", False),
        ("plugins/api.py", "core/io.py", None, None),
        ("kernel/core/io.py", "std/os.py", None, None),
    ]
    df = spark.createDataFrame(pairs, "s string, t string, name string, allowed boolean")
    got = df.select(
        "s",
        "t",
        governing_rule(F.col("s"), rules)["name"],
        import_allowed(F.col("s"), F.col("t"), rules),
    )
    assert [tuple(r) for r in got.collect()] == pairs


def test_repeated_references_repeat_and_texts(references_of):
    refs = references_of([("src/domain/a.rs", "src/x/b.rs", "B")] * 2)
    rows = drift_findings(drift(refs)).collect()
    assert len(rows) == 2
    assert rows[0]["description"] == (
        '`caller0` (in src/domain/a.rs, governed by "Domain Layer" boundary) imports `B` from '
        "`src/x/b.rs`, which is outside the allowed import scope."
    )
    assert rows[0]["severity"] == "warning"
    assert rows[0]["related"]["boundary_rule"] == "src/domain/**"


def test_scan_gets_filter_and_nothing_is_shuffled(spark, references_of, tmp_path):
    path = str(tmp_path / "refs")
    references_of([("src/domain/a.rs", "src/x/b.rs")]).withColumn(
        "unused", F.lit(1)
    ).write.parquet(path)
    plan = plan_of(drift_findings(drift(spark.read.parquet(path))))
    assert "StringStartsWith(source_file,src/domain/)" in plan
    assert "Exchange" not in plan
    assert "unused" not in plan
