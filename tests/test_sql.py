"""The library from SQL gives what it gives from DataFrames."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import normalize, scalars, sql
from glyphmill.operators import subword, windows


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "Ab ㌔ \"x\" 'y' \\ z 2016"), (2, ""), (3, None), (None, "a b"), (5, "ー～ (r) " * 30), (6, "w " * 3000)]
    frame = spark.createDataFrame(rows, "id long, s string")
    frame.createOrReplaceTempView("texts")
    sql.register(spark)
    return frame


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_scalars(spark, texts):
    same(spark.sql("SELECT id, nfkc(s) AS a, full_width(s) AS b, normalize_text(s) AS c FROM texts"), texts.select("id", normalize.nfkc(F.col("s")).alias("a"), normalize.full_width(F.col("s")).alias("b"), normalize.normalize(F.col("s")).alias("c")))
    same(spark.sql("SELECT nucleus_mass(id) AS m FROM range(60)"), spark.range(60).select(scalars.mass_threshold(F.col("id")).alias("m")))
    same(spark.sql("SELECT distance_weight(id) AS w, safe_ratio(id, id - 3) AS r FROM range(1, 9)"), spark.range(1, 9).select(scalars.weight(F.col("id")).alias("w"), scalars.ratio(F.col("id").cast("double"), F.col("id") - 3).alias("r")))


@pytest.mark.parametrize(("width", "slide"), [(15, 1), (3, 2), (1, 5)])
def test_windows(spark, texts, width, slide):
    got = spark.sql(f"SELECT row_id, pos, y, indices, round(values[0], 6) AS v FROM context_windows(TABLE(SELECT id, white_space_tokens(s) FROM texts), {width}, {slide})")
    tokens = texts.select(F.col("id").alias("row_id"), F.expr("white_space_tokens(s)").alias("tokens"))
    found = windows.windows(tokens.fillna({"row_id": -9}).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), F.lit("<s>"), F.lit("</s>"), width, slide)
    want = windows.vectors(found, width).select(F.when(F.col("row_id") != -9, F.col("row_id")).alias("row_id"), "pos", "y", "indices", F.round(F.col("values")[0].cast("double"), 6).alias("v"))
    key = lambda r: (str(r.row_id), r.pos, r.y, list(r.indices))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_windows_join_with_sql(spark, texts):
    n = spark.sql("SELECT t.id, count(*) AS n FROM texts t JOIN context_windows(TABLE(SELECT id, white_space_tokens(s) FROM texts), 15, 1) w ON t.id = w.row_id WHERE t.id = 6 GROUP BY t.id").first().n
    assert n == 3015
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT * FROM context_windows(TABLE(SELECT id, white_space_tokens(s) FROM texts), 0, 1)").collect()


def test_encoding(spark, texts):
    model = subword.Vocabulary(("<pad>", "<unk>", "<s>", "</s>", "▁", "a", "b", "▁w", "w", "r"), (0.0, 0.0, 0.0, 0.0, -1.0, -2.0, -2.5, -1.5, -3.0, -3.0))
    sql.register_vocabulary(spark, model)
    same(spark.sql("SELECT id, encode_pieces(subword_words(s)) AS e FROM texts"), texts.select("id", subword.encoder(spark, model)(F.col("s")).alias("e")))
