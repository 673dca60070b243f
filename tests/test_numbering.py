"""Numbers without gaps in a total order, over many partitions."""

import random

from pyspark.sql import functions as F

from modgauge.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), f"v{i:05d}", None if i % 7 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    got = numbered(df, [F.desc("a"), F.asc("b")]).collect()
    got.sort(key=lambda r: r["number"])
    assert [r["number"] for r in got] == list(range(3000))
    assert [(r["a"], r["b"], r["c"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_ties_and_empty(spark):
    df = spark.range(200).select(F.lit(None).cast("string").alias("x"))
    assert sorted(r["place"] for r in numbered(df, [F.col("x")], "place").collect()) == list(range(200))
    assert numbered(df.limit(0), [F.col("x")]).collect() == []
