"""Simple cycles of a graph whose chains are contracted.

Modules carry numbers in the order of their names.  A cycle is walked from its smallest module, its
start, and a walk only takes steps from which it can still come home.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from modgauge.operators.numbering import numbered
from modgauge.runtime import Rounds

# Steps that a walk takes in one round while the edges fit a broadcast of this size; larger
# graphs take one step a round, joined by shuffle.
STEPS = 6
BROADCAST_BYTES = 8 * 1024 * 1024


def numbered_edges(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """Edges whose ends are numbers, with the name of the module they lead to."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes, _ = rounds.written(numbered(ends, [F.col("node")], "id", rounds), nodes=F.count("*"))
    return (
        edges.alias("e")
        .join(nodes.alias("s"), F.expr("e.src = s.node"))
        .join(nodes.alias("d"), F.expr("e.dst = d.node"))
        .selectExpr(
            "s.id AS src", "d.id AS dst", "e.src AS src_name", "e.dst AS dst_name",
            "refs", "reverse_refs", "weakest", "inner",
        )
    )


def ways_back(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, word, bits): the starts that a node leads back to through nodes greater than the start.

    Bit b of word w stands for start 64 * w + b.  A round passes only the bits that were new in the round
    before along the edges, and writes only those that are new again, so every bit is
    written once.  Words without a bit have no row.
    """
    # The bits of starts below e.src: all of an earlier word, and the lower ones of its own.
    below = (
        "CASE WHEN b.word < e.src DIV 64 THEN b.bits "
        "WHEN b.word = e.src DIV 64 THEN b.bits & (shiftleft(1L, CAST(e.src % 64 AS INT)) - 1) "
        "ELSE 0L END"
    )
    first = edges.filter("dst < src").selectExpr(
        "src AS node", "dst DIV 64 AS word", "shiftleft(1L, CAST(dst % 64 AS INT)) AS bits"
    )
    new, seen = rounds.written(
        first.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), rows=F.count("*")
    )
    found = [new]
    while seen["rows"]:
        passed = (
            new.alias("b")
            .join(edges.alias("e"), F.expr("e.dst = b.node"))
            .selectExpr("e.src AS node", "b.word", f"{below} AS bits", "0L AS known")
        )
        known = reduce(DataFrame.unionByName, found).selectExpr("node", "word", "0L AS bits", "bits AS known")
        new, seen = rounds.written(
            passed.unionByName(known)
            .groupBy("node", "word")
            .agg(F.expr("bit_or(bits) & ~bit_or(known) AS bits"))
            .filter("bits <> 0"),
            rows=F.count("*"),
        )
        if seen["rows"]:
            found.append(new)
    return (
        reduce(DataFrame.unionByName, found).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    )


def closed_walks(edges: DataFrame, rounds: Rounds) -> list[DataFrame]:
    """(path, refs, reverse_refs, weakest) of every simple cycle of two or more edges.

    `path` names all modules, contracted ones too, from the smallest module that is not contracted.
    """
    ends = edges.selectExpr("dst AS node", "dst DIV 64 AS word", "shiftleft(1L, CAST(dst % 64 AS INT)) AS bits")
    home = ways_back(edges, rounds).unionByName(ends).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    # An edge has a row for each word of starts that its end is or leads back to.
    size = F.sum(F.octet_length("dst_name") + F.octet_length("src_name") + 100)
    edges, seen = rounds.written(
        edges.alias("e").join(home.alias("h"), F.expr("e.dst = h.node")).selectExpr("e.*", "h.word", "h.bits"),
        size=size,
    )
    steps = STEPS if seen["size"] <= BROADCAST_BYTES else 1
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walks = edges.filter("dst > src AND word = src DIV 64 AND getbit(bits, CAST(src % 64 AS INT)) = 1").selectExpr(
        "src AS start",
        "dst AS tail",
        "concat(array(src_name), inner, array(dst_name)) AS path",
        "refs",
        "reverse_refs",
        "weakest",
    )
    found = []
    while True:
        # Walks branch, so they are spread anew over all tasks, however few bytes they are.
        walks = walks.repartition(spread, "path")
        for _ in range(steps):
            walks = _stepped(walks, edges)
        walks, seen = rounds.written(walks, open=F.count("tail"), closed=F.count_if(F.col("tail").isNull()))
        if seen["closed"]:
            found.append(walks.filter("tail IS NULL").select("path", "refs", "reverse_refs", "weakest"))
        if not seen["open"]:
            return found
        walks = walks.filter("tail IS NOT NULL")


def _stepped(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks taken one step on, on all edges that lead home; a walk that is home has no tail and stays."""
    goes = (
        "w.tail = e.src AND w.start DIV 64 = e.word AND getbit(e.bits, CAST(w.start % 64 AS INT)) = 1 "
        "AND (e.dst = w.start OR NOT array_contains(w.path, e.dst_name))"
    )
    home = "w.tail IS NULL"
    return (
        walks.alias("w")
        .join(edges.alias("e"), F.expr(goes), "left")
        # A walk whose every step leads to a module it has visited ends there.
        .filter(f"{home} OR e.src IS NOT NULL")
        .selectExpr(
            "w.start",
            "IF(e.dst = w.start, NULL, e.dst) AS tail",
            f"CASE WHEN {home} THEN w.path WHEN e.dst = w.start THEN concat(w.path, e.inner) "
            "ELSE concat(w.path, e.inner, array(e.dst_name)) END AS path",
            f"IF({home}, w.refs, w.refs + e.refs) AS refs",
            # NULL as soon as one edge has no opposite: then there is no reverse.
            f"IF({home}, w.reverse_refs, w.reverse_refs + e.reverse_refs) AS reverse_refs",
            f"IF({home}, w.weakest, least(w.weakest, e.weakest)) AS weakest",
        )
    )
