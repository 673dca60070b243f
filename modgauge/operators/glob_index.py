"""Matching many paths against many globs by an equality join.

A glob is filed under one key that all its paths share: the folder its plain beginning names, else the
file ending its plain end names, else the key of all paths.  A path has a key for each
of its folders, for its ending, and the key of all.  Paths and globs meet where a key is
equal, and only there is the glob itself tested.  Neither the plan nor a row grows with the number of globs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modgauge.functions.globs import fixed_ends, shape_of

_TABLE = "rule int, key string, test string, text string"


def _key(glob: str) -> str:
    head, tail = fixed_ends(glob)
    if "/" in head:
        return head[: head.rindex("/") + 1]
    if "." in tail:
        return tail[tail.rindex(".") :]
    return ""


def glob_table(spark: SparkSession, globs: Iterable[tuple[int, str]]) -> DataFrame:
    """(rule, key, test, text) of (rule, glob) pairs; malformed globs match nothing and are left out."""
    rows = []
    for rule, glob in globs:
        shape = shape_of(glob)
        if shape is not None:
            test, text = shape
            rows.append((rule, _key(glob), test, f"(?s)\\A(?:{text})\\z" if test == "regex" else text))
    return spark.createDataFrame(rows, _TABLE)


def path_keys(path: Column) -> Column:
    """All keys a path can meet a glob under."""
    parts = F.split(path, "/")
    folders = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda _, i: F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/")),
    )
    ending = F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1)))
    return F.array_compact(F.concat(F.array(F.lit(""), ending), folders))


def _passes(path: str) -> Column:
    return F.expr(
        f"CASE test WHEN 'equal' THEN {path} = text "
        f"WHEN 'prefix' THEN startswith({path}, text) "
        f"WHEN 'suffix' THEN endswith({path}, text) "
        f"WHEN 'name' THEN {path} = text OR endswith({path}, concat('/', text)) "
        f"WHEN 'contains' THEN contains({path}, text) "
        f"WHEN 'any' THEN true ELSE rlike({path}, text) END"
    )


def matches(paths: DataFrame, path: str, globs: DataFrame, *on: str) -> DataFrame:
    """Rows of `paths` with the columns of each glob that matches `path`.

    `on` names columns that must be equal besides.  A row is repeated for every glob that matches.
    """
    keyed = paths.withColumn("key", F.explode(path_keys(F.col(path))))
    met = keyed.join(globs, [*on, "key"])
    return met.filter(_passes(f"`{path}`")).drop("key", "test", "text")
