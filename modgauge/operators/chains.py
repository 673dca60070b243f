"""Contracting chains of a graph into single edges that hold their path.

Edges here have the columns of EDGE.  `inner` are the modules that a contracted edge passes
through; an edge as it was read has none.  Several edges may join the same two modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.runtime import Rounds

EDGE = ("src", "dst", "refs", "reverse_refs", "weakest", "inner")


def contracted(
    edges: DataFrame, count: int, rounds: Rounds
) -> tuple[DataFrame, int, list[DataFrame]]:
    """(edges, how many, loops): every module with one way in and one way out merged into its neighbours' edge.

    A chain of such modules becomes one edge, whatever its length, and a ring of them a loop, an edge
    from a module to itself.  No other cycle can pass a loop's inner modules, nor use the loop, so loops are
    taken out; that may leave more modules with one way in and out, and the next pass contracts those.
    """
    loops = []
    while count:
        links, seen = rounds.written(_links(edges), links=F.count("*"))
        if not seen["links"]:
            break
        merged, seen = rounds.written(
            _merged(edges, _places(links, rounds)),
            loops=F.count_if(F.col("src") == F.col("dst")),
            edges=F.count_if(F.col("src") != F.col("dst")),
        )
        if seen["loops"]:
            loops.append(merged.filter("src = dst"))
        edges, count = merged.filter("src <> dst"), seen["edges"]
    return edges, count, loops


def _links(edges: DataFrame) -> DataFrame:
    """(node, next) of modules with exactly one edge in and one edge out."""
    return (
        edges.selectExpr("stack(2, src, dst, NULL, dst, NULL, src) AS (node, to, from)")
        .groupBy("node")
        .agg(F.count("to").alias("outs"), F.count("from").alias("ins"), F.max("to").alias("next"))
        .filter("outs = 1 AND ins = 1")
        .select("node", "next")
    )


def _places(links: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, chain, ahead): the chain a link belongs to, and its steps to the chain's last link.

    A link points some steps ahead and knows the smallest link on the way there; its pointer
    grows fourfold in each round.  In a chain it ends at the last link, which names
    the chain.  In a ring, once it has gone all the way round, it has met the smallest link, which
    names the ring; for that link itself the way is the whole ring.
    """
    state, seen = rounds.written(
        links.alias("x")
        .join(links.selectExpr("node AS other"), F.expr("x.next = other"), "left")
        .selectExpr(
            "node",
            "other AS ptr",
            "coalesce(other, node) AS chain",
            "CAST(IF(other IS NULL, 0, 1) AS BIGINT) AS ahead",
            "CAST(1 AS BIGINT) AS steps",
        ),
        open=F.count("ptr"),
    )
    reach = 1
    # A pointer that has made as many steps as pointers are open has been round its ring.
    while seen["open"] > reach:
        grown = state
        for _ in range(3):
            grown = _further(grown, state)
        state, seen = rounds.written(grown, open=F.count("ptr"))
        reach *= 4
    return state.select("node", "chain", "ahead")


def _further(state: DataFrame, pointers: DataFrame) -> DataFrame:
    """Every open pointer moved on by the pointer of the link it points to."""
    nearer = "y.ptr IS NOT NULL AND x.chain <= y.chain"
    return (
        state.alias("x")
        .join(pointers.alias("y"), F.expr("x.ptr = y.node"), "left")
        .selectExpr(
            "x.node",
            "y.ptr",
            f"IF(y.node IS NULL OR {nearer}, x.chain, y.chain) AS chain",
            f"IF(y.node IS NULL OR {nearer}, x.ahead, x.steps + y.ahead) AS ahead",
            "x.steps + coalesce(y.steps, 0) AS steps",
        )
    )


def _merged(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with all those of one chain in one row.

    An edge that leaves a link belongs to the link's chain, as does the edge that enters the first link.
    """
    placed = (
        edges.alias("e")
        .join(places.alias("s"), F.expr("e.src = s.node"), "left")
        .join(places.alias("d"), F.expr("e.dst = d.node"), "left")
        .selectExpr(
            "e.*",
            "coalesce(s.chain, d.chain) AS chain",
            "coalesce(-s.ahead, -1 - d.ahead) AS at",
        )
    )
    whole = (
        placed.filter("chain IS NOT NULL")
        .groupBy("chain")
        .agg(
            F.min_by("src", "at").alias("src"),
            F.max_by("dst", "at").alias("dst"),
            F.sum("refs").alias("refs"),
            # Without an opposite for one edge there is none for the chain.
            F.expr("IF(count(reverse_refs) = count(*), sum(reverse_refs), NULL)").alias("reverse_refs"),
            F.min("weakest").alias("weakest"),
            F.sort_array(F.collect_list(F.struct("at", "src", "inner"))).alias("steps"),
        )
        .withColumn(
            "inner",
            F.expr("flatten(transform(steps, (x, i) -> IF(i = 0, x.inner, concat(array(x.src), x.inner))))"),
        )
    )
    return placed.filter("chain IS NULL").select(*EDGE).unionByName(whole.select(*EDGE))
