"""Numeric rules: size grids, dimension ladders, distance weights, sampling thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 15
#: Nucleus mass: start, decay a token, floor.
MASS, DECAY, FLOOR = 0.99, 0.97, 0.4


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def vocab_grid(spark: SparkSession, low: int = 1400, high: int = 10000, steps: int = 10) -> DataFrame:
    """(i, vocab_size): a geometric grid with both ends as given, each value above the one before."""
    if steps < 2 or low <= 0 or high <= 0 or low >= high:
        raise ValueError("two steps at least, positive sizes, and low below high")
    at = F.col("i") / (steps - 1)
    value = F.bround(F.exp(F.log(F.lit(float(low))) + (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))) * at)).cast("long")
    grid = spark.range(steps).select(F.col("id").cast("int").alias("i"))
    grid = grid.withColumn("v", F.when(F.col("i") == 0, low).when(F.col("i") == steps - 1, high).otherwise(value))
    rising = F.col("i") + F.max(F.col("v") - F.col("i")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("i", F.when(F.col("i") == steps - 1, high).otherwise(rising).cast("long").alias("vocab_size"))


def weight(distance: Column) -> Column:
    return F.lit(1.0) / F.pow(distance, F.lit(0.25))


def weights(d: Column) -> dict[str, Column]:
    """The weights that contexts are compared by."""
    return {"reciprocal": F.lit(1.0) / d, "sqrt": F.lit(1.0) / F.sqrt(d), "power_quarter": weight(d), "log": F.lit(1.0) / F.log(d + 1)}


def distance_weights(spark: SparkSession, most: int = 100) -> DataFrame:
    return spark.range(1, most + 1).select(F.col("id").alias("d"), *(c.alias(name) for name, c in weights(F.col("id").cast("double")).items()))


def dim_ladder(original: int, most: int, step: int = 200, least: int = 1000) -> list[int]:
    """Dimensions to try, from the largest down; one at least."""
    if step <= 0:
        raise ValueError(f"step must be positive: {step}")
    start = min(original - step, most)
    if start < 1:
        return [1]
    return list(range(start, least - 1, -step)) or [start]


def max_components(rows: int, cols: int) -> int:
    return max(1, min(rows, cols) - 1)


def mass_threshold(length: Column) -> Column:
    """The nucleus mass after ``length`` tokens."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(MASS) * F.pow(F.lit(DECAY), length), F.lit(FLOOR))))
