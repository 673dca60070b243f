"""Runs a query and its SQL, by another engine, over one folder of tables."""

import os

import duckdb

from modgauge.llm import queries

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def both(spark, key, folder):
    """(rows of the query, rows of the SQL), columns by name, sorted; types must agree."""
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    found = queries.LLM_QUERIES[key](spark, folder)
    answer = connection.execute(queries.LLM_ORACLES[key])
    names = [d[0] for d in answer.description]
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == {
        d[0]: str(d[1]) for d in answer.description
    }
    order = [names.index(c) for c in sorted(names)]
    expected = sorted((tuple(row[i] for i in order) for row in answer.fetchall()), key=str)
    got = sorted((tuple(row[c] for c in sorted(names)) for row in found.collect()), key=str)
    return got, expected
