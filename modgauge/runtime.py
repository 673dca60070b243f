"""Cutting lineage in iterative jobs so that they survive lost executors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, set for this context.

    Where the setting is missing, as in tests, it is a folder below the session's
    warehouse, which executors share as well.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", f"{warehouse}/_checkpoints")
        )
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """Reliably checkpoint `df`, measuring aggregates over it in the same job.

    A retried task may be measured twice, so the measures are upper bounds;
    zero stays zero.  That is all a loop condition or a size check needs.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not measures:
        return df.checkpoint(), {}
    seen = Observation()
    stored = df.observe(
        seen, *[column.alias(name) for name, column in measures.items()]
    ).checkpoint()
    metrics = seen.get
    return stored, {name: metrics.get(name) or 0 for name in measures}


def written(
    df: DataFrame, folder: str | None = None, **measures: Column
) -> tuple[DataFrame, dict[str, int]]:
    """As cut_lineage, through a Parquet table in the shared folder, or in `folder` below it.

    For long loops of joins: a checkpoint keeps the size the optimizer guessed for its plan, and
    guesses for joins multiply from round to round until planning takes longer
    than the work.  A file has the size it has.
    """
    spark = df.sparkSession
    path = f"{folder or ensure_checkpoint_dir(spark)}/round-{uuid4()}"
    seen = Observation()
    observed = df.observe(seen, *[column.alias(name) for name, column in measures.items()])
    observed.write.parquet(path)
    metrics = seen.get
    stored = spark.read.schema(df.schema).parquet(path)
    return stored, {name: metrics.get(name) or 0 for name in measures}


class Rounds:
    """Tables of the rounds of one loop, in a folder of their own that can be removed.

    Only a result that was written elsewhere may outlive the folder: a table that reads
    it could not be computed again after an executor was lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid4()}"

    def written(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
        return written(df, self.folder, **measures)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
