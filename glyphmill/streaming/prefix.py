"""The stateless steps on a stream: normalisation, splitting, encoding and windows never look beyond a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.functions.normalize import normalize
from glyphmill.operators import subword
from glyphmill.operators.stats import white_space
from glyphmill.operators.windows import sparse_rows, windows


def read(spark: SparkSession, folder: str, schema: str = "row_id long, sentence string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def normalized_windows(rows: DataFrame, width: int = 15) -> DataFrame:
    tokens = rows.select("row_id", white_space(normalize(F.col("sentence"))).alias("tokens"))
    return windows(tokens, F.lit("<s>"), F.lit("</s>"), width)


def encoded(rows: DataFrame, model: subword.Vocabulary) -> DataFrame:
    """(row_id, ids, tokens) by a fitted vocabulary."""
    return subword.encoded(rows.select("row_id", normalize(F.col("sentence")).alias("sentence")), model).select("row_id", "ids", "tokens")


def vectors(rows: DataFrame, model: subword.Vocabulary, width: int = 15, slide: int = 1) -> DataFrame:
    """(row_id, pos, y, indices, values): the sparse context rows that training reads."""
    return sparse_rows(encoded(rows, model), subword.BOS, subword.EOS, width, slide, "ids")


def write(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
