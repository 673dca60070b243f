"""Modules that depend on many others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.config import Thresholds
from modgauge.functions.severity import CRITICAL, WARNING
from modgauge.operators.bitset import key_bits, may_hold
from modgauge.operators.graph import fan_out
from modgauge.operators.skew import join_keyed

# Fixed value: dependencies named in a finding's description.
DISPLAYED_DEPENDENCIES = 10


def coupled_modules(edges: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(module, fan_out, severity) of modules at or above the warning threshold."""
    severity = F.when(
        F.col("fan_out") >= thresholds.coupling_critical_fan_out, CRITICAL
    ).otherwise(WARNING)
    return (
        fan_out(edges)
        .filter(F.col("fan_out") >= thresholds.coupling_warning_fan_out)
        .select(F.col("src_module").alias("module"), "fan_out", severity.alias("severity"))
    )


def coupling(edges: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """coupled_modules with all their dependencies, sorted.

    Two passes over the edges.  The first counts, with map-side aggregation, which modules reach the
    threshold.  These, few, go into a bit set of fixed size, and the second pass drops the edges of all
    others before anything is shuffled or listed.  Edges are distinct, so a module's array holds no more
    entries than there are modules, however many references there are.
    """
    critical = F.col("fan_out") >= thresholds.coupling_critical_fan_out
    coupled = key_bits(coupled_modules(edges, thresholds), "module")
    return (
        edges.filter(may_hold(coupled, F.col("src_module")))
        .groupBy(F.col("src_module").alias("module"))
        .agg(
            F.count("*").alias("fan_out"),
            F.sort_array(F.collect_list("dst_module")).alias("dependencies"),
        )
        # A module may share its bit with a coupled one.
        .filter(F.col("fan_out") >= thresholds.coupling_warning_fan_out)
        .select(
            "module",
            "fan_out",
            F.when(critical, CRITICAL).otherwise(WARNING).alias("severity"),
            "dependencies",
        )
    )


def coupling_dependencies(
    edges: DataFrame, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """(module, fan_out, dependency): every dependency of every coupled module."""
    targets = edges.select(
        F.col("src_module").alias("module"), F.col("dst_module").alias("dependency")
    )
    coupled = coupled_modules(edges, thresholds).drop("severity")
    return join_keyed(targets, coupled, "module", "inner").select(
        "module", "fan_out", "dependency"
    )
