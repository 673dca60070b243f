"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  Every query
runs once to warm up, which also writes the derived graph tables, and is then
timed from building the DataFrame to writing all of its rows to the no-op sink.
Deriving the graph from the source tables is timed by itself.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from modgauge.catalog.queries import QUERIES
from modgauge.sources.derived import derive_references

HEADLINE = (
    "derive_references",
    "file_edges",
    "module_edges",
    "module_links",
    "dead_code",
    "architectural_drift",
    "pair_cycles",
    "coupling",
    "long_cycles",
    "pair_cycle_evidence",
    "all_findings",
    "report_summary",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("modgauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, folder: str) -> float:
    query = QUERIES.get(name, derive_references)
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        seconds[name] = round(timed(spark, name, folder), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
