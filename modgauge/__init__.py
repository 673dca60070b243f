"""modgauge: code-graph health checks as Spark DataFrame jobs.

Two tables go in (definitions and references between them), one findings
table comes out, and summaries, reports and a pass/fail gate are derived from
it.  See README.md for the tour.
"""

from modgauge.config import BoundaryRule, Ignore, Rules, Thresholds
from modgauge.plans.analysis import CHECKS, analyze, select_checks

__all__ = [
    "BoundaryRule",
    "CHECKS",
    "Ignore",
    "Rules",
    "Thresholds",
    "analyze",
    "select_checks",
]
