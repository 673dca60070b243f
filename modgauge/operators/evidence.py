"""File pairs that make up a mutual module dependency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modgauge.functions.paths import module_of
from modgauge.operators.topk import first_k_per_group


def pair_cycle_evidence(file_edges: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k heaviest file pairs in each direction of every pair cycle."""
    candidates = file_edges.select(
        module_of(F.col("source_file")).alias("src_module"),
        module_of(F.col("target_file")).alias("dst_module"),
        "source_file",
        "target_file",
        "ref_count",
    )
    # Rank first: the join then sees at most k rows per module edge.
    heaviest = first_k_per_group(
        candidates,
        ["src_module", "dst_module"],
        [F.desc("ref_count"), F.col("source_file"), F.col("target_file")],
        k,
        spread=["source_file", "target_file"],
    )
    both_ways = pairs.select(
        "module_a",
        "module_b",
        F.inline(
            F.array(
                F.struct(
                    F.col("module_a").alias("src_module"), F.col("module_b").alias("dst_module")
                ),
                F.struct(
                    F.col("module_b").alias("src_module"), F.col("module_a").alias("dst_module")
                ),
            )
        ),
    )
    return heaviest.join(both_ways, ["src_module", "dst_module"])
