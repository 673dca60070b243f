"""The whole run: both tables in, one findings table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from modgauge.config import Rules
from modgauge.operators.coupling import coupling
from modgauge.operators.cycles import long_cycles, pair_cycles
from modgauge.operators.dead_code import dead_code
from modgauge.operators.drift import drift
from modgauge.operators.graph import module_links
from modgauge.plans import findings as rows
from modgauge.runtime import cut_lineage
from modgauge.schema import DEFINITIONS, FINDINGS, REFERENCES
from modgauge.sources.tables import complete_rows, conform

# Fixed values, in run order.
CHECKS = ("dead_code", "circular_dependencies", "coupling", "architectural_drift")


def select_checks(only: str | None = None) -> tuple[str, ...]:
    """Checks named in a comma list, in run order; unknown names are ignored."""
    if only is None:
        return CHECKS
    wanted = {name.strip() for name in only.split(",")}
    return tuple(check for check in CHECKS if check in wanted)


def analyze(
    defs: DataFrame,
    refs: DataFrame,
    rules: Rules = Rules(),
    only: str | None = None,
    min_severity: str = "info",
) -> DataFrame:
    """Findings of the selected checks at or above `min_severity`.

    Every check scans only the columns it reads, and leaves out rows where one
    of those is NULL (sources.tables.rejected_rows shows them).  A NULL target
    name empties the dead-code check, as NOT IN does.  Module edges, which two
    checks share, are computed once.
    """
    checks = select_checks(only)
    defs, refs = conform(defs, DEFINITIONS), conform(refs, REFERENCES)
    parts = []
    if "dead_code" in checks:
        complete = complete_rows(defs, DEFINITIONS)
        parts.append(rows.dead_code_findings(dead_code(complete, refs, rules)))
    if "circular_dependencies" in checks or "coupling" in checks:
        links, _ = cut_lineage(module_links(refs))
    if "circular_dependencies" in checks:
        parts.append(rows.pair_cycle_findings(pair_cycles(links)))
        parts.append(rows.long_cycle_findings(long_cycles(links)))
    if "coupling" in checks:
        parts.append(rows.coupling_findings(coupling(links, rules.thresholds)))
    if "architectural_drift" in checks:
        parts.append(rows.drift_findings(drift(complete_rows(refs, REFERENCES), rules)))
    if not parts:
        return defs.sparkSession.createDataFrame([], FINDINGS)
    findings = reduce(DataFrame.unionByName, parts)
    return rows.at_least(findings, min_severity)
