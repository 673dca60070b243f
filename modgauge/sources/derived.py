"""A code graph derived from `part` and `lineitem`, for checks and benchmarks.

Every part is a definition and every line item one reference.  The expressions
are plain SQL that Spark and DuckDB evaluate alike.  A line item whose supplier
and part stand in the wanted relation refers to the part's symbol; any other
line item is a call inside the supplier's own file.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from modgauge.runtime import ensure_checkpoint_dir

MODULES = 24


def _slot(key: str) -> str:
    return f"({key} % {MODULES})"


# Where the files of each of the 24 modules lie: start and end of their path.  The
# file number stands in between, but for the two modules of one fixed file.
_STARTS = [
    "src/domain/f",
    "src/application/f",
    "src/presentation/f",
    "src/types/f",
    "src/models/f",
    "src/infrastructure/f",
    *[f"src/mod{i}/f" for i in range(6, 18)],
    "./src/mod18/f",
    "/src/mod19/f",
    "mod20/f",
    "src/main.rs",
    "f",
    "src/mod23/index.ts",
]
_ENDS = [".rs"] * 20 + [".test.ts", "", ".go", ""]


def path_sql(key: str) -> str:
    slot = _slot(key)

    def pick(texts: list[str]) -> str:
        return f"split_part('{','.join(texts)}', ',', CAST({slot} + 1 AS INT))"

    number = f"CASE WHEN {slot} IN (21, 23) THEN '' ELSE CAST({key} % 50 AS VARCHAR(9)) END"
    return f"concat({pick(_STARTS)}, {number}, {pick(_ENDS)})"


def name_sql(key: str) -> str:
    return (
        f"CASE WHEN {key} % 97 = 5 THEN 'main' "
        f"WHEN {key} % 89 = 5 THEN concat('test_sym', {key}) "
        f"WHEN {key} % 83 = 5 THEN concat('sym', {key}, 'Spec') "
        f"ELSE concat('sym', {key}) END"
    )


def kind_sql(key: str) -> str:
    return (
        f"CASE {key} % 9 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' "
        "WHEN 3 THEN 'struct' WHEN 4 THEN 'enum' WHEN 5 THEN 'trait' "
        "WHEN 6 THEN 'interface' WHEN 7 THEN 'variable' ELSE 'function' END"
    )


DEFINITION_COLUMNS = {
    "name": name_sql("p_partkey"),
    "file": path_sql("p_partkey"),
    "kind": kind_sql("p_partkey"),
    "line": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END",
}

_S, _T = _slot("l_suppkey"), _slot("l_partkey")

# Which line items cross files, per graph.
CROSSES = {
    # Most module pairs are linked: short cycles only, there are too many others.
    "dense": (
        f"l_partkey % 10 < 8 AND (({_T} - {_S} + 24) % 24 <= 1 + {_S} % 17 "
        f"OR ({_S} < 12 AND ({_S} - {_T} + 24) % 24 IN (1, 2) AND l_quantity <= 2))"
    ),
    # One ring through all modules and some triangles.
    "sparse": (
        f"({_T} - {_S} + 24) % 24 = 1 OR ({_S} < 8 AND ({_S} - {_T} + 24) % 24 = 2)"
    ),
    # Layers with wide fan-out and a few edges back: all cycles can be listed.
    "layered": (
        f"l_partkey % 10 < 8 AND (({_T} > {_S} AND {_T} - {_S} <= 2 + ({_S} * 7) % 23) "
        f"OR ({_S} IN (2, 5, 8, 11, 14) AND {_S} - {_T} IN (1, 2)) "
        f"OR ({_S} = 4 AND {_T} = 3) OR ({_S} = 23 AND {_T} = 17))"
    ),
}


def reference_keys(graph: str) -> dict[str, str]:
    """Caller and, where the reference crosses files, the part it refers to."""
    return {
        "caller": "l_suppkey",
        "callee": f"CASE WHEN {CROSSES[graph]} THEN l_partkey END",
    }


REFERENCE_COLUMNS = {
    "source_file": path_sql("caller"),
    "source_name": "concat('caller', caller)",
    "target_file": path_sql("coalesce(callee, caller)"),
    "target_name": (
        "CASE WHEN callee IS NULL THEN concat('caller', caller) "
        f"ELSE {name_sql('callee')} END"
    ),
}


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def derive_definitions(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.selectExpr(*_named(DEFINITION_COLUMNS))


def derive_references(spark: SparkSession, folder: str, graph: str = "layered") -> DataFrame:
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    keys = items.selectExpr(*_named(reference_keys(graph)))
    return keys.selectExpr(*_named(REFERENCE_COLUMNS))


_written: dict[tuple, str] = {}


def _state(source: DataFrame) -> tuple:
    """Path, size and time of the source's files, through Spark's own file listing."""
    fields = [f"_metadata.file_{x}" for x in ("path", "size", "modification_time")]
    return tuple(sorted(tuple(map(str, r)) for r in source.select(*fields).distinct().collect()))


def _as_table(derived: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """The derived rows as a Parquet table, written once per session and source state.

    The checks are meant for stored graph tables.  Left as expressions over the
    source tables, every file predicate would repeat the whole derivation.
    """
    spark = derived.sparkSession
    key = (spark.sparkContext.applicationId, name, _state(source))
    if key not in _written:
        path = f"{ensure_checkpoint_dir(spark)}/derived-{uuid4()}"
        derived.write.parquet(path)
        _written[key] = path
    return spark.read.schema(derived.schema).parquet(_written[key])


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    source = spark.read.parquet(f"{folder}/part.parquet")
    return _as_table(derive_definitions(spark, folder), source, "definitions")


def references(spark: SparkSession, folder: str, graph: str = "layered") -> DataFrame:
    source = spark.read.parquet(f"{folder}/lineitem.parquet")
    return _as_table(derive_references(spark, folder, graph), source, graph)
