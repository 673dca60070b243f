"""Drift under any number of boundary rules and allowed imports.

drift.drift writes the rules into one expression, which is the fastest way for a few and no
way for thousands: planning and every row would pay for all of them.  Here rules are rows.
Files and file pairs are judged once each, however many references they hold, and the
verdict is joined back to the references with hot pairs dealt out over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from modgauge.config import BoundaryRule, Rules
from modgauge.operators.glob_index import glob_table, matches
from modgauge.operators.skew import join_keyed
from modgauge.runtime import written

_COLUMNS = ["source_file", "source_name", "target_file", "target_name"]


def governing_rules(files: DataFrame, path: str, boundaries: tuple[BoundaryRule, ...]) -> DataFrame:
    """(path, rule, boundary_name, boundary_rule): the first rule that matches each distinct path."""
    spark = files.sparkSession
    globs = glob_table(spark, [(i, rule.pattern) for i, rule in enumerate(boundaries)])
    first = matches(files.select(path).distinct(), path, globs).groupBy(path).agg(F.min("rule").alias("rule"))
    return first.join(_named(spark, boundaries), "rule").select(path, "rule", "boundary_name", "boundary_rule")


def _named(spark: SparkSession, boundaries: tuple[BoundaryRule, ...]) -> DataFrame:
    rows = [(i, rule.name, rule.pattern) for i, rule in enumerate(boundaries)]
    return spark.createDataFrame(rows, "rule int, boundary_name string, boundary_rule string")


def _ignored(files: DataFrame, path: str, globs: tuple[str, ...]) -> DataFrame:
    table = glob_table(files.sparkSession, [(0, glob) for glob in globs])
    return matches(files, path, table).select(path).distinct()


def drift_by_index(refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of drift.drift, by joins: references outside the allowed scope, with the rule they break."""
    boundaries = rules.effective_boundaries
    refs = refs.select(*_COLUMNS)
    pairs = (
        refs.filter("source_file <> target_file").select("source_file", "target_file").distinct()
    )
    pairs, _ = written(pairs, pairs=F.count("*"))
    sources = governing_rules(pairs, "source_file", boundaries)
    if rules.ignore.drift:
        files = pairs.select("source_file").distinct()
        sources = sources.join(_ignored(files, "source_file", rules.ignore.drift), "source_file", "left_anti")
    judged = join_keyed(pairs, sources, "source_file", "inner")
    # A target is judged once for each rule that asks for it.
    asked, _ = written(judged.select("rule", "target_file").distinct(), asked=F.count("*"))
    allowing = glob_table(
        refs.sparkSession,
        [(i, glob) for i, rule in enumerate(boundaries) for glob in rule.allowed_imports],
    )
    allowed = matches(asked, "target_file", allowing, "rule").select("rule", "target_file").distinct()
    forbidden = asked.join(allowed, ["rule", "target_file"], "left_anti")
    scope, pair = F.struct("rule", "target_file"), F.struct("source_file", "target_file")
    broken = join_keyed(
        judged.withColumn("_scope", scope), forbidden.select(scope.alias("_scope")), "_scope", "left_semi"
    ).select(pair.alias("_pair"), "boundary_name", "boundary_rule")
    found = join_keyed(refs.withColumn("_pair", pair), broken, "_pair", "inner")
    return found.select(*_COLUMNS, "boundary_name", "boundary_rule")
