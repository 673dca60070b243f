"""References that cross a layer boundary they may not cross."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from modgauge.config import BoundaryRule, Rules
from modgauge.functions.globs import any_glob, matches_glob
from modgauge.operators.drift_index import drift_by_index

# With more globs than this in all rules together, rules are joined as rows.  Both ways
# give the same references.
GLOBS_IN_PLAN = 200


def governing_rule(path: Column, boundaries: tuple[BoundaryRule, ...]) -> Column:
    """First rule whose pattern matches the path: struct(index, name, pattern), or NULL."""
    return _by_rule(
        path,
        boundaries,
        lambda i, rule: F.struct(
            F.lit(i).alias("index"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.pattern).alias("pattern"),
        ),
    )


def import_allowed(
    source: Column, target: Column, boundaries: tuple[BoundaryRule, ...]
) -> Column:
    """Whether the rule governing `source` lets it import `target`; NULL when ungoverned."""
    return _by_rule(
        source,
        boundaries,
        lambda _, rule: F.coalesce(any_glob(target, rule.allowed_imports), F.lit(False)),
    )


def _by_rule(
    path: Column,
    boundaries: tuple[BoundaryRule, ...],
    value: Callable[[int, BoundaryRule], Column],
) -> Column:
    """CASE over the rules in order: `value` of the first that governs the path."""
    chain = F  # F.when starts the chain, Column.when goes on with it
    for i, rule in enumerate(boundaries):
        chain = chain.when(matches_glob(path, rule.pattern), value(i, rule))
    return chain


def drift(refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Cross-file references outside the allowed scope, with the rule they break.

    Rows are judged where they are read: no shuffle and no join, so a file that
    owns a third of all references costs nothing extra.  Only rules too many for one
    expression are met by joins.
    """
    boundaries = rules.effective_boundaries
    globs = len(boundaries) + sum(len(rule.allowed_imports) for rule in boundaries)
    if globs + len(rules.ignore.drift) > GLOBS_IN_PLAN:
        return drift_by_index(refs, rules)
    source, target = F.col("source_file"), F.col("target_file")
    columns = ["source_file", "source_name", "target_file", "target_name"]
    governed = any_glob(source, [rule.pattern for rule in boundaries])
    return (
        refs.select(*columns)
        .filter(source != target)
        # Implied by the verdict, but simple enough to reach the scan.
        .filter(governed)
        .filter(~any_glob(source, rules.ignore.drift))
        .select(*columns, F.inline(_broken_rule(source, target, boundaries)))
    )


def _broken_rule(
    source: Column, target: Column, boundaries: tuple[BoundaryRule, ...]
) -> Column:
    """The governing rule as a one-element array when it is broken, else an empty one.

    Unnesting it filters and labels in one evaluation; a filter on the verdict
    would repeat every glob, once to filter and once to name the rule.
    """
    rule_type = "array<struct<boundary_name:string,boundary_rule:string>>"
    kept = F.array().cast(rule_type)

    def judged(_: int, rule: BoundaryRule) -> Column:
        broken = F.array(
            F.struct(
                F.lit(rule.name).alias("boundary_name"),
                F.lit(rule.pattern).alias("boundary_rule"),
            )
        )
        return F.when(any_glob(target, rule.allowed_imports), kept).otherwise(broken)

    return F.coalesce(_by_rule(source, boundaries, judged), kept)
