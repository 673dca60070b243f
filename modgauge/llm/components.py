"""Connected components of a link table, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.runtime import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link.

    `links` has columns a and b.  In each round every node moves to its smallest neighbour if that is
    smaller, chains of such moves are shortened by doubling, and the links are
    rewritten to where their ends have moved.  Links within one place vanish, so
    the table shrinks quickly.  Loops (a = b) and nulls are no links.  Every
    round is a reliable checkpoint; nothing but counts reaches the driver.
    """
    links, seen = cut_lineage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b")
        .distinct(),
        links=F.count("*"),
    )
    rounds = []
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))
        for _ in range(2):
            further = moves.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
            moves = moves.join(further, moves.root == further.via, "left").select(
                "node", F.coalesce("beyond", "root").alias("root")
            )
        moves = cut_lineage(moves)[0]
        rounds.append(moves)
        if not seen["links"]:
            break
        left, right = moves.toDF("a", "x"), moves.toDF("b", "y")
        links, seen = cut_lineage(
            links.join(left, "a")
            .join(right, "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a < b")
            .distinct(),
            links=F.count("*"),
        )
        if not seen["links"]:
            break
    found = rounds[0]
    for moves in rounds[1:]:
        later = moves.toDF("via", "beyond")
        found = found.join(later, found.root == later.via, "left").select(
            "node", F.coalesce("beyond", "root").alias("root")
        )
    return found
