"""Definitions that nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from modgauge.config import Rules
from modgauge.functions.globs import any_glob
from modgauge.functions.paths import basename
from modgauge.functions.severity import CRITICAL, INFO, WARNING, severity_rank
from modgauge.operators.skew import join_keyed

# Fixed values.
REPORTED_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface")
ENTRY_FILES = ("index.ts", "index.js", "mod.rs", "lib.rs", "main.rs")
ENTRY_NAMES = ("main", "Main")
ENTRY_PREFIX = "test_"
ENTRY_SUFFIXES = ("_test", "Test", "Spec")
CALLABLE_KINDS = ("function", "method")


def is_entry_like(name: Column) -> Column:
    condition = name.isin(*ENTRY_NAMES) | name.startswith(ENTRY_PREFIX)
    for suffix in ENTRY_SUFFIXES:
        condition |= name.endswith(suffix)
    return condition


def dead_code_severity(name: Column, kind: Column) -> Column:
    """An entry-like name is info whatever its kind; callables warn; types are critical."""
    return (
        F.when(is_entry_like(name), INFO)
        .when(kind.isin(*CALLABLE_KINDS), WARNING)
        .otherwise(CRITICAL)
    )


def is_reportable(rules: Rules = Rules()) -> Column:
    """Definition rows the check looks at: kind, entry-file and ignore filters."""
    return (
        F.col("kind").isin(*REPORTED_KINDS)
        & ~basename(F.col("file")).isin(*ENTRY_FILES)
        & ~any_glob(F.col("file"), rules.ignore.dead_code)
    )


def unreferenced(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions whose name is NOT IN the referenced names, NULL rules included.

    Spark plans a literal NOT IN over nullable columns as a broadcast of every
    referenced name, whatever its size.  An anti join against the distinct names
    can shuffle instead, and a definition name that is very common is spread
    over many tasks.  The NULL rules move into one scalar over the same distinct
    names, of which NULL is one more: it empties the result, and a NULL
    definition name survives only when there are no targets.
    """
    targets = refs.select(F.col("target_name").alias("name")).distinct()
    kept = join_keyed(defs, targets, "name", "left_anti")
    null_targets = F.count_if(F.col("name").isNull())
    verdict = targets.agg(
        F.when(null_targets > 0, "none").when(F.count("*") > 0, "named").otherwise("all")
    ).scalar()
    # Spark moves this filter below the join.
    named = F.col("name").isNotNull()
    return kept.filter((verdict == "all") | (named & (verdict == "named")))


def dead_code(defs: DataFrame, refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(name, file, kind, line, severity, severity_rank) of unreferenced definitions."""
    candidates = defs.select("name", "file", "kind", "line").filter(is_reportable(rules))
    severity = dead_code_severity(F.col("name"), F.col("kind"))
    return (
        unreferenced(candidates, refs)
        .select("name", "file", "kind", "line", severity.alias("severity"))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )


def dead_code_total(dead: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: how many findings there are, and the level that total escalates to."""
    limits = rules.thresholds
    return dead.agg(F.count("*").alias("dead_code_total")).withColumn(
        "severity",
        F.when(F.col("dead_code_total") >= limits.dead_code_critical, CRITICAL)
        .when(F.col("dead_code_total") >= limits.dead_code_warning, WARNING)
        .otherwise(INFO),
    )
