"""What a person looks at: schemas with first rows, tables with padded columns, samples of windows with their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.sampling import keyed_rows


def described(df: DataFrame, rows: int = 3) -> str:
    """Each column with its type, then the first rows, one value a line."""
    lines = [f"{name}: {kind}" for name, kind in df.dtypes]
    for k, row in enumerate(df.limit(rows).collect(), 1):
        lines += [f"row {k}", *(f"  {name} = {row[name]!r}" for name in df.columns)]
    return "\n".join(lines)


def console_table(df: DataFrame, rows: int = 100) -> str:
    """Up to ``rows`` rows, every column as wide as its widest value."""
    cells = [df.columns, *(["" if v is None else str(v) for v in r] for r in df.limit(rows).collect())]
    width = [max(len(line[k]) for line in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(n) for c, n in zip(line, width)).rstrip() for line in cells)


def window_sample(vectors: DataFrame, vocabulary: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(row_id, pos, answer, words, values) of n windows, with pieces for ids, the entries by falling weight."""
    pieces = vocabulary.select("vocab_id", "vocab")
    some = keyed_rows(vectors.withColumn("key", F.concat_ws(":", "row_id", "pos")), n, "key", seed).drop("key")
    some = some.join(pieces.select(F.col("vocab_id").alias("y"), F.col("vocab").alias("answer")), "y", "left")
    each = some.select("row_id", "pos", "answer", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("row_id", "pos", "answer", F.col("e.indices").alias("vocab_id"), F.col("e.values").alias("value"))
    each = each.join(pieces, "vocab_id", "left").groupBy("row_id", "pos").agg(F.first("answer").alias("answer"), F.sort_array(F.collect_list(F.struct("value", "vocab")), False).alias("e"))
    return each.select("row_id", "pos", "answer", F.col("e.vocab").alias("words"), F.col("e.value").alias("values")).orderBy("row_id", "pos")


def before_and_after(origin: DataFrame, normalized: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, int]:
    """(row_id, before, after) of n sampled sentences, and how many of them the normalised corpus lacks."""
    some = keyed_rows(origin.select("row_id", F.col("sentence").alias("before")), n, "row_id", seed)
    found = some.join(normalized.select("row_id", F.col("sentence").alias("after")), "row_id", "left")
    return found.where("after IS NOT NULL").orderBy("row_id"), found.where("after IS NULL").count()
