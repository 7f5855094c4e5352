"""What the operators of this subpackage share: tables, shared scratch space and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.scratch import Scratch, free_shuffles

__all__ = ["Scratch", "components", "free_shuffles", "shuffle_partitions", "small_batches", "table"]

BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Batches that workers get must stay small where rows are whole documents: in bytes, which changes no result.

    A choice that the session has made itself stands.
    """
    if spark.conf.get(BATCH_BYTES, DEFAULT_BYTES) == DEFAULT_BYTES:
        spark.conf.set(BATCH_BYTES, "4m")


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges(a, b), for every node that has an edge.

    Alternating large-star and small-star rounds; each round is two pre-aggregated minima and two equi-joins, and the
    number of rounds is logarithmic. Nothing is collected but one checksum a round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before, last = scratch.save(e, "stars0"), None, 0
    for i in range(1, max_rounds + 1):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"stars{i}")
        scratch.drop(f"stars{last}")
        e, last = new, i
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
