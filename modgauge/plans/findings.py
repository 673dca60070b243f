"""Rows of the four checks as rows of one findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.functions import texts
from modgauge.functions.severity import CRITICAL, WARNING, rank_of
from modgauge.operators.coupling import DISPLAYED_DEPENDENCIES
from modgauge.operators.cycles import canonical_cycle
from modgauge.schema import RELATED

# Fixed values, in report order.
DEAD_CODE = "dead_code"
CIRCULAR_DEPENDENCY = "circular_dependency"
HIGH_COUPLING = "high_coupling"
ARCHITECTURAL_DRIFT = "architectural_drift"
CATEGORIES = (DEAD_CODE, CIRCULAR_DEPENDENCY, HIGH_COUPLING, ARCHITECTURAL_DRIFT)

_SEPARATOR = r"'\u0001'"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def worded(template: str, *values: str) -> str:
    """SQL for one of the fixed sentences, filled with column expressions."""
    return f"format_string({', '.join([literal(template), *values])})"


def to_findings(
    df: DataFrame,
    *,
    category: str,
    severity: str,
    file: str,
    name: str,
    description: str,
    remediation: str,
    line: str = "CAST(NULL AS BIGINT)",
    related: dict[str, str] | None = None,
    identity: tuple[str, ...] = (),
) -> DataFrame:
    """Project `df` to the findings schema; the arguments are SQL expressions.

    `diff_key` identifies what is found: category, file, name and `identity`,
    but neither line nor wording, so a definition that moved is the same
    finding.  `finding_id` adds the line.  Both are the same in every run.
    """
    related = related or {}
    key_parts = ", ".join([_SEPARATOR, literal(category), file, name, *identity])
    key = f"sha2(concat_ws({key_parts}), 256)"
    related_fields = ", ".join(
        f"CAST({related.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in RELATED.fields
    )
    return df.selectExpr(
        f"sha2(concat_ws({_SEPARATOR}, {key}, coalesce(CAST({line} AS STRING), '')), 256) AS finding_id",
        f"{key} AS diff_key",
        f"{severity} AS severity",
        f"CASE {severity} WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END "
        "AS severity_rank",
        f"{literal(category)} AS category",
        f"struct({file} AS file, {line} AS line, {name} AS name) AS location",
        f"{description} AS description",
        f"{remediation} AS remediation",
        f"struct({related_fields}) AS related",
    )


# initcap would lower the rest of the word.
_KIND = "concat(upper(substr(kind, 1, 1)), substr(kind, 2))"


def dead_code_findings(dead: DataFrame) -> DataFrame:
    critical = worded(texts.DEAD_CODE_REMEDY_CRITICAL, "lower(kind)", "name")
    other = worded(texts.DEAD_CODE_REMEDY_OTHER, _KIND, "name")
    return to_findings(
        dead,
        category=DEAD_CODE,
        severity="severity",
        file="file",
        line="line",
        name="name",
        description=worded(texts.DEAD_CODE_DESCRIPTION, _KIND, "name", "file"),
        remediation=f"IF(severity = '{CRITICAL}', {critical}, {other})",
        related={"kind": "kind"},
        identity=("kind",),
    )


def pair_cycle_findings(pairs: DataFrame) -> DataFrame:
    a, b, total = "module_a", "module_b", "total_refs"
    return to_findings(
        pairs,
        category=CIRCULAR_DEPENDENCY,
        severity="severity",
        file=f"concat({a}, '/')",
        name=f"concat({a}, ' <-> ', {b})",
        description=worded(texts.PAIR_DESCRIPTION, a, b, total, a, b, b, a),
        remediation=worded(texts.PAIR_REMEDY, a, b),
        related={"other_module": b, "cycle_count": total},
    )


def _listed(modules: str, separator: str) -> str:
    """Module names in backticks."""
    return f"array_join(transform({modules}, m -> concat('`', m, '`')), '{separator}')"


def long_cycle_findings(cycles: DataFrame) -> DataFrame:
    chain = _listed("path", " -> ")
    keyed = cycles.withColumn(
        "cycle_key", F.array_join(canonical_cycle(F.col("path")), " -> ")
    )
    return to_findings(
        keyed,
        category=CIRCULAR_DEPENDENCY,
        severity=f"'{CRITICAL}'",
        file="concat(path[0], '/')",
        name="format_string('cycle(%s)', length)",
        description=worded(
            texts.CYCLE_DESCRIPTION, "length", chain, "path[0]", "total_refs"
        ),
        remediation=literal(texts.CYCLE_REMEDY),
        related={"other_module": chain, "cycle_count": "total_refs"},
        # Not the reported path: that may turn round when weights change.
        identity=("cycle_key",),
    )


def coupling_findings(coupled: DataFrame) -> DataFrame:
    shown = _listed(f"slice(dependencies, 1, {DISPLAYED_DEPENDENCIES})", ", ")
    more = f"format_string(' and %s more', fan_out - {DISPLAYED_DEPENDENCIES})"
    dependencies = f"concat({shown}, IF(fan_out > {DISPLAYED_DEPENDENCIES}, {more}, ''))"
    critical = worded(texts.COUPLING_REMEDY_CRITICAL, "module", "fan_out")
    warning = worded(texts.COUPLING_REMEDY_WARNING, "module", "fan_out")
    return to_findings(
        coupled,
        category=HIGH_COUPLING,
        severity="severity",
        file="concat(module, '/')",
        name="module",
        description=worded(
            texts.COUPLING_DESCRIPTION, "module", "fan_out", "fan_out", dependencies
        ),
        remediation=f"IF(severity = '{CRITICAL}', {critical}, {warning})",
        related={
            "module_name": "module",
            "fan_out": "fan_out",
            "dependencies": "dependencies",
        },
    )


def drift_findings(violations: DataFrame) -> DataFrame:
    source = ("source_name", "source_file")
    target = ("target_name", "target_file")
    rule = "boundary_name"
    return to_findings(
        violations,
        category=ARCHITECTURAL_DRIFT,
        severity=f"'{WARNING}'",
        file="source_file",
        name="source_name",
        description=worded(texts.DRIFT_DESCRIPTION, *source, rule, *target),
        remediation=worded(texts.DRIFT_REMEDY, "target_name", rule, rule, *target),
        related={
            column: column
            for column in ("target_name", "target_file", "boundary_name", "boundary_rule")
        },
        identity=("target_file", "target_name"),
    )


def at_least(findings: DataFrame, min_severity: str) -> DataFrame:
    return findings.filter(f"severity_rank >= {rank_of(min_severity)}")
