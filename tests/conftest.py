import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("modgauge-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def definitions_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "name string, file string, kind string, line bigint")

    return make


@pytest.fixture
def references_of(spark):
    """References from (source_file, target_file[, target_name]) tuples."""

    def make(rows):
        full = [
            (r[0], f"caller{i}", r[1], r[2] if len(r) > 2 else f"callee{i}")
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            full,
            "source_file string, source_name string, target_file string, target_name string",
        )

    return make


@pytest.fixture
def edges_of(spark):
    def make(rows):
        return spark.createDataFrame(
            rows, "src_module string, dst_module string, ref_count bigint"
        )

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
