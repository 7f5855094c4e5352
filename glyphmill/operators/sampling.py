"""The decaying nucleus rule over long rows (seq, k, logit), and random samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalars import mass_threshold


def logits_of(vectors: DataFrame, seq: str, values: str) -> DataFrame:
    return vectors.select(F.col(seq).alias("seq"), F.posexplode(values).alias("k", "logit")).withColumn("logit", F.col("logit").cast("double"))


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(seq, k, p), stable for large logits."""
    if temperature <= 0:
        raise ValueError(f"temperature must be positive: {temperature}")
    all_ = Window.partitionBy("seq")
    z = logits.withColumn("z", F.col("logit") / temperature)
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(all_)))
    return e.select("seq", "k", (F.col("e") / F.sum("e").over(all_)).alias("p"))


def nucleus(probs: DataFrame, length: Column, top_k: int = 0) -> DataFrame:
    """(seq, k, p, rank, q): the smallest set of likeliest tokens whose mass reaches the threshold, one at least, at most
    ``top_k`` if that is positive; q is p scaled to sum to 1. Equal probabilities: the larger token first."""
    if top_k < 0:
        raise ValueError(f"top_k must not be negative: {top_k}")
    order = Window.partitionBy("seq").orderBy(F.desc("p"), F.desc("k"))
    ranked = probs.withColumn("rank", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    kept = ranked.where((F.col("rank") == 1) | (F.col("before") < mass_threshold(length)))
    if top_k:
        kept = kept.where(F.col("rank") <= top_k)
    return kept.withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("seq"))).drop("before")


def noise(*keys: Column) -> Column:
    """Gumbel noise that the keys decide, the same on any engine: from the first 52 bits of their md5."""
    digest = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def draw(candidates: DataFrame, seed: int) -> DataFrame:
    """(seq, k): one token a sequence with chances in proportion to p, as the maximum of log p and keyed Gumbel noise.

    One partial aggregate: no order and no cumulated sum, and whatever p is scaled by doesn't matter.
    """
    score = F.log("p") + noise(F.lit(seed), F.col("seq"), F.col("k"))
    return candidates.where("p > 0").groupBy("seq").agg(F.max_by("k", F.struct(score, "k")).alias("k"))


def random_rows(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows without replacement: each task keeps its n smallest random numbers."""
    return rows.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def keyed_rows(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed on any engine: those with the least digests of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
