"""A corpus pipeline of five stages: quality, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
`run` writes every stage's rows as Parquet below the session's shared folder and reads them again.
All stages but the last return the columns of documents, extra ones included; the last gives
every row's place in the mix, mix_position, which counts from 0 without gaps.

Null text counts as empty and is rejected by the first stage; null ids, repeated rows, ties and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from modgauge.llm import bpe, linededup, mixing, quality, simhash
from modgauge.llm.text import free_name, table
from modgauge.runtime import ensure_checkpoint_dir

RANKS = "byte_bpe_50k.tiktoken"

# Words of a shingle, and bits by which near-duplicates may differ.
SHINGLE, BITS = 4, 4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the model keep."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = free_name("judged", docs.columns)
    return quality.judge(docs, model, into=judged).filter(f"{judged}.kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; n_chars follows the text.

    A text all of whose lines go has nothing left and goes with them.
    """
    cleaned = linededup.dedup(docs)
    return cleaned.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, SHINGLE, BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: part files in order, rows in order within."""
    mixed = mixing.mix(docs)
    slots = docs.groupBy("source").count().agg(
        F.sum(F.ceil(F.col("count") / mixing.BLOCK))
    ).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.in_order(mixed, slots or 0, partitions, docs.columns)


def _positions(docs: DataFrame) -> DataFrame:
    """docs with _position: the row's number in files by name and rows in order, null without files.

    A reader packs splits of files as it likes, but each row still knows its file and its number there.
    """
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumn("_position", F.lit(None).cast("bigint"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part file.
    files = placed.groupBy("_file").agg(F.count("*").alias("n")).select(
        "_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    placed = placed.join(F.broadcast(files), "_file")
    return placed.select(*docs.columns, (F.col("_before") + F.col("_row")).alias("_position"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, digests of them and of the decoded bytes, and its place in the mix.

    The place is known only of rows that are read from files, as `run` reads them; of others it is null.
    """
    placed = _positions(docs.select("doc_id", "text")).withColumnRenamed("_position", "mix_position")
    return bpe.digests(
        placed, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True, place="mix_position"
    )


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

# The model, the similarity join and the tokens have no SQL form: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return docs
