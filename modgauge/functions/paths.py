"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROOT_MODULE = "root"


def module_of(path: Column) -> Column:
    """Module a file belongs to: the folder below src/, else the top folder.

    One leading "./" or "/" is dropped first.  Files without a folder belong
    to the root module.  This runs on every reference row, so each form of
    path gets its own branch of plain substring functions: no arrays, no
    regular expressions, nothing computed twice.
    """
    return (
        F.when(path.startswith("./"), _top_module(F.substr(path, F.lit(3))))
        .when(path.startswith("/"), _top_module(F.substr(path, F.lit(2))))
        .when(path.isNotNull(), _top_module(path))
    )


def _top_module(path: Column) -> Column:
    has_folder_below_src = path.startswith("src/") & (F.locate("/", path, 5) > 0)
    return (
        F.when(has_folder_below_src, F.substring_index(F.substr(path, F.lit(5)), "/", 1))
        .when(path.contains("/"), F.substring_index(path, "/", 1))
        .otherwise(ROOT_MODULE)
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
