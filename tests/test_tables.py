import pytest

from modgauge.operators.graph import graph_stats
from modgauge.runtime import cut_lineage, ensure_checkpoint_dir
from modgauge.schema import DEFINITIONS, REFERENCES
from modgauge.sources.tables import (
    ContractError,
    complete_rows,
    conform,
    contract_report,
    read_table,
    rejected_rows,
)


def test_contract_names_every_problem(spark):
    df = spark.createDataFrame([("a", 1)], "name string, file int")
    with pytest.raises(ContractError) as error:
        conform(df, DEFINITIONS)
    message = str(error.value)
    assert "file: expected string, found int" in message
    assert "kind: expected string, found nothing" in message


def test_narrow_numbers_and_extra_columns_are_fine(spark):
    df = spark.createDataFrame(
        [("a", "f", "class", 1, "x")],
        "name string, file string, kind string, line int, extra string",
    )
    assert conform(df, DEFINITIONS).dtypes == [
        ("name", "string"),
        ("file", "string"),
        ("kind", "string"),
        ("line", "bigint"),
    ]


def test_incomplete_rows_are_set_aside(references_of):
    refs = references_of([("a", "b"), (None, "b"), ("a", None)])
    assert complete_rows(refs, REFERENCES).count() == 1
    assert rejected_rows(refs, REFERENCES).count() == 2
    report = {r["column_name"]: r for r in contract_report("r", refs, REFERENCES).collect()}
    assert report["target_file"]["null_count"] == 1 and not report["target_file"]["honoured"]
    assert report["source_name"]["null_count"] == 0 and report["source_name"]["honoured"]


def test_graph_stats_count_a_missing_table_as_zero(spark, definitions_of):
    definitions_of([("a", "f", "class", 1)]).createOrReplaceTempView("some_defs")
    assert tuple(graph_stats(spark, "some_defs", "no_such_table").first()) == (1, 0)
    assert tuple(graph_stats(spark, None, None).first()) == (0, 0)


def test_tables_are_found_and_read(spark, definitions_of, tmp_path):
    defs = definitions_of([("a", "f", "class", 1)])
    defs.createOrReplaceTempView("found_defs")
    defs.write.parquet(str(tmp_path / "defs"))
    for source in ("found_defs", str(tmp_path / "defs")):
        assert read_table(spark, source, DEFINITIONS).count() == 1


def test_checkpoints_go_where_the_session_says(spark):
    folder = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured in folder
    stored, seen = cut_lineage(spark.range(5))
    assert stored.count() == 5 and seen == {}
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()
