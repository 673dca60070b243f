"""The part of a graph that can lie on cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.runtime import Rounds

# With so few edges left, another cut would cost more than the edges it could drop.
FEW_EDGES = 10_000


def cyclic_core(edges: DataFrame, count: int, rounds: Rounds) -> tuple[DataFrame, int]:
    """Edges that may lie on a cycle, and how many: all that do, and perhaps a few others.

    Every edge of a cycle lies in one strongly connected component.  Each module learns the
    smallest and the largest module that reach it, and those it reaches.  Modules of one component agree
    on all four, so an edge whose ends disagree is dropped.  Edges between components may agree by
    chance, so the cut is repeated until it drops nothing, or few edges are left.  State stays
    linear in the graph.
    """
    while count:
        judged, seen = rounds.written(
            _with_labels(edges, _settled_labels(edges, rounds)).selectExpr(
                "e.*", "slice(s.label, 1, 4) = slice(d.label, 1, 4) AS agree"
            ),
            kept=F.count_if("agree"),
        )
        dropped, count = count - seen["kept"], seen["kept"]
        edges = judged.filter("agree").drop("agree")
        if not dropped or count <= FEW_EDGES:
            break
    return edges, count


def _with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return (
        edges.alias("e")
        .join(labels.alias("s"), F.expr("e.src = s.node"))
        .join(labels.alias("d"), F.expr("e.dst = d.node"))
    )


def _settled_labels(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, label): label holds the smallest and largest module that reach the node, the
    smallest and largest it reaches, and two pointers, behind and ahead.

    One array, so that all look-ups of a round read the same columns and share one broadcast.
    """
    labels, _ = rounds.written(_first_labels(edges), nodes=F.count("*"))
    while True:
        spread, seen = rounds.written(_spread(edges, labels), changed=F.count_if("changed"))
        labels = spread.drop("changed")
        if not seen["changed"]:
            return labels


def _first_labels(edges: DataFrame) -> DataFrame:
    """Every node with itself as all labels, and with its only neighbours, if any.

    `ahead` is where the only edge out of a node leads, else the node itself;
    `behind` is where the only edge into it comes from.
    """
    ends = edges.selectExpr("stack(2, src, dst, NULL, dst, NULL, src) AS (node, to, from)")
    only = "coalesce(IF(min({0}) = max({0}), min({0}), node), node)"
    return ends.groupBy("node").agg(
        F.expr(f"array(node, node, node, node, {only.format('from')}, {only.format('to')})").alias(
            "label"
        )
    )


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Pass labels along every edge, both ways, then jump along three kinds of pointers.

    What reaches a module that reaches me, reaches me as well, so its labels are mine too.  And
    where a node has one way on, what the node `ahead` reaches I reach too; that
    pointer doubles its distance in every round.  Both ends of an edge also repeat
    their own labels, so that they stay in the comparison; the copies shrink to one
    row per module and task before the shuffle.
    """
    passed = (
        _with_labels(edges, labels)
        .selectExpr(
            "stack(2, e.src, s.label, e.dst, d.label) AS (node, own)",
            "s.label[0] AS b0",
            "s.label[1] AS b1",
            "d.label[2] AS a0",
            "d.label[3] AS a1",
        )
        .groupBy("node", "own")
        .agg(
            F.expr("least(own[0], min(b0)) AS b0"),
            F.expr("greatest(own[1], max(b1)) AS b1"),
            F.expr("least(own[2], min(a0)) AS a0"),
            F.expr("greatest(own[3], max(a1)) AS a1"),
        )
        .alias("n")
    )
    keys = {"p": "n.b0", "q": "n.b1", "l": "n.own[4]", "x": "n.a0", "y": "n.a1", "r": "n.own[5]"}
    for name, key in keys.items():
        passed = passed.join(labels.alias(name), F.expr(f"{name}.node = {key}"))

    def merged(function: str, own: str, place: int, sides: str) -> str:
        others = ", ".join(f"{side}.label[{place}]" for side in sides)
        return f"{function}(n.{own}, {others})"

    found = [
        merged("least", "b0", 0, "pql"),
        merged("greatest", "b1", 1, "pql"),
        merged("least", "a0", 2, "xyr"),
        merged("greatest", "a1", 3, "xyr"),
    ]
    return passed.selectExpr(
        "n.node", f"array({', '.join(found)}, l.label[4], r.label[5]) AS label", "n.own"
    ).selectExpr("node", "label", "slice(label, 1, 4) <> slice(own, 1, 4) AS changed")
