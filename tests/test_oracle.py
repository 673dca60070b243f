"""Every registered query against its SQL, run by another engine on the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import TESTDATA

from modgauge.catalog.oracle import all_sql
from modgauge.catalog.queries import QUERIES
from modgauge.operators.coupling import coupling
from modgauge.operators.cycles import pair_cycles
from modgauge.operators.dead_code import dead_code
from modgauge.operators.drift import drift
from modgauge.operators.graph import module_edges
from modgauge.sources.derived import definitions, references

FOLDER = f"{TESTDATA}/sf0.001"
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        view = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(all_sql())


def sortable(row):
    return [(value is not None, str(value)) for value in row]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, key):
    df = entry_points.queries()[key](spark, FOLDER)
    answer = duck.execute(entry_points.oracle_sql()[key])
    types = {d[0]: str(d[1]) for d in answer.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    columns = sorted(types)
    order = [list(types).index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=sortable)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=sortable)
    assert got == expected


def test_entry(spark):
    assert not entry_points.entry(spark).isEmpty()


def test_known_counts(spark):
    """Counts measured beforehand on the derived graph at the next larger scale."""
    folder = f"{TESTDATA}/sf0.01"
    defs, refs = definitions(spark, folder), references(spark, folder, "dense")
    edges = module_edges(refs).cache()
    assert defs.count() == 2000
    assert refs.filter("source_file <> target_file").count() == 16480
    assert edges.count() == 205

    def by(df, column):
        return {r[0]: r[1] for r in df.groupBy(column).count().collect()}

    assert by(dead_code(defs, refs), "severity") == {"critical": 193, "warning": 121, "info": 5}
    assert by(pair_cycles(edges), "severity") == {"critical": 26}
    assert by(coupling(edges), "severity") == {"warning": 9, "critical": 3}
    assert by(drift(refs), "boundary_name") == {
        "Domain Layer": 106,
        "Application Layer": 114,
        "Presentation Layer": 198,
    }
