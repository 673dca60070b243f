"""Circular module dependencies: mutual pairs and longer simple cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from modgauge.functions.severity import CRITICAL, WARNING
from modgauge.operators.chains import contracted
from modgauge.operators.cycle_core import cyclic_core
from modgauge.operators.returns import closed_walks, numbered_edges
from modgauge.runtime import Rounds, written

# Fixed value: a mutual pair with more references than this is critical.
PAIR_CRITICAL_ABOVE = 20

def _pairs(edges: DataFrame) -> DataFrame:
    """Both directions of every module pair in one row, met by aggregation."""
    forwards = F.col("src_module") < F.col("dst_module")
    return edges.groupBy(
        F.least("src_module", "dst_module").alias("module_a"),
        F.greatest("src_module", "dst_module").alias("module_b"),
    ).agg(
        F.sum(F.when(forwards, F.col("ref_count"))).alias("forward_refs"),
        F.sum(F.when(~forwards, F.col("ref_count"))).alias("backward_refs"),
    )


def pair_cycles(edges: DataFrame) -> DataFrame:
    """Modules that depend on each other, once per pair, smaller name first."""
    return (
        _pairs(edges)
        .filter("forward_refs > 0 AND backward_refs > 0")
        .withColumn("total_refs", F.col("forward_refs") + F.col("backward_refs"))
        .withColumn(
            "severity",
            F.when(F.col("total_refs") > PAIR_CRITICAL_ABOVE, CRITICAL).otherwise(WARNING),
        )
    )


def canonical_cycle(path: Column) -> Column:
    """Key shared by all rotations of a cycle and by its reverse.

    Start at the smallest node, then take the smaller of the two directions.
    """
    at = F.array_position(path, F.array_min(path)).cast("int")
    onwards = F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1))
    backwards = F.concat(
        F.slice(onwards, 1, 1), F.reverse(F.slice(onwards, F.lit(2), F.size(onwards)))
    )
    return F.least(onwards, backwards)


# A path as it is reported starts at its smallest module.
_ROTATED = (
    "concat(slice(path, at, size(path)), slice(path, 1, at - 1)) AS path"
)
_REPORTED_DIRECTION = (
    "reverse_refs IS NULL OR refs > reverse_refs OR (refs = reverse_refs AND "
    "path <= concat(slice(path, 1, 1), reverse(slice(path, 2, size(path)))))"
)


def long_cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles of three or more modules: (path, length, total_refs, weakest).

    Of two opposite cycles over the same modules the heavier is kept (the smaller path on a
    tie).  `weakest` is the edge of the reported direction with the fewest
    references.  Chains of modules with one way in and out are contracted to single edges, before and after
    the graph is cut to its cyclic part.  What is left is walked from the smallest module
    of each cycle, and only on to modules that lead back to it, so every path walked is
    the beginning of a walk home.  The number of cycles itself can grow exponentially with the graph.

    The result is a table of its own; those of the rounds are removed.
    """
    rounds = Rounds(edges.sparkSession)
    edges, seen = rounds.written(_with_reverse(edges), edges=F.count("*"))
    found = [edges.limit(0).withColumnRenamed("inner", "path")]
    edges, count, loops = contracted(edges, seen["edges"], rounds)
    edges, count = cyclic_core(edges, count, rounds)
    edges, count, more = contracted(edges, count, rounds)
    for loop in loops + more:
        found.append(loop.withColumn("path", F.expr("concat(array(src), inner)")))
    if count:
        edges, _ = rounds.written(numbered_edges(edges, rounds), edges=F.count("*"))
        found += closed_walks(edges, rounds)
    walks = [part.select("path", "refs", "reverse_refs", "weakest") for part in found]
    cycles = (
        reduce(DataFrame.unionByName, walks)
        .filter("size(path) >= 3")
        .withColumn("at", F.expr("CAST(array_position(path, array_min(path)) AS INT)"))
        .selectExpr(_ROTATED, "refs", "reverse_refs", "weakest")
        .filter(_REPORTED_DIRECTION)
        .selectExpr("path", "size(path) AS length", "refs AS total_refs", "weakest")
    )
    cycles, _ = written(cycles, cycles=F.count("*"))
    rounds.remove()
    return cycles


def _with_reverse(edges: DataFrame) -> DataFrame:
    """Each edge with the weight of its opposite, and the columns of chains.EDGE.

    A path can then carry the weight of its reverse along, and the choice
    between a cycle and its reverse needs no grouping of cycles later on.
    """
    return (
        _pairs(edges)
        .selectExpr(
            "stack(2, module_a, module_b, forward_refs, backward_refs, "
            "module_b, module_a, backward_refs, forward_refs) "
            "AS (src, dst, refs, reverse_refs)"
        )
        .filter("refs > 0")
        .selectExpr(
            "*",
            "struct(refs AS ref_count, src AS src_module, dst AS dst_module) AS weakest",
            "CAST(array() AS ARRAY<STRING>) AS inner",
        )
    )


def weakest_edges(cycles: DataFrame) -> DataFrame:
    """Edge with the fewest references of every long cycle: where to cut it."""
    return cycles.select(
        "path",
        "length",
        F.col("weakest.src_module").alias("src_module"),
        F.col("weakest.dst_module").alias("dst_module"),
        F.col("weakest.ref_count").alias("ref_count"),
    )
