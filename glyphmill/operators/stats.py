"""Token statistics at two grains, sentences and tokens, in one pass over the corpus.

A sentence is exploded to its tokens and one row more, without a token, that stands for itself. One aggregate by tokenizer,
token and, for the sentences' own rows, number of tokens gives both grains at once: how often each token occurs, and how
many sentences have so many tokens. What is reported follows from those, the median included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalars import ratio

LOW = 2


def white_space(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_frequency(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def low_frequency(frequency: DataFrame, vocab_size: int) -> DataFrame:
    """Observed tokens with at most LOW occurrences, and their share of the requested vocabulary."""
    n = F.count_if(F.col("n") <= LOW)
    return frequency.agg(n.alias("low_frequency_token_count"), (ratio(n, F.lit(vocab_size)) if vocab_size > 0 else F.lit(0.0)).alias("low_frequency_token_ratio"))


# fixed values: the report's columns
REPORT = [
    "vocab_size", "avg_token_char_length", "avg_token_count_per_sentence", "low_frequency_token_count", "low_frequency_token_ratio",
    "token_count_variance", "token_count_stddev", "token_count_min", "token_count_max", "token_count_median", "avg_token_per_char",
]


def sentence_report(sizes: DataFrame, low: Column | None = None) -> list[Column]:
    """Columns of the report from (n, times, piece, density): sentences with n tokens, and the sums of their ratios."""
    one = lambda c: F.coalesce(c, F.lit(0.0))
    of = F.col("n").isNotNull()
    big = lambda c: F.coalesce(F.sum(F.when(of, c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    k, s, q = big(F.col("times")), big(F.col("n") * F.col("times")), big(F.col("n").cast("long") * F.col("n") * F.col("times"))
    mean = lambda c: one(F.try_divide(F.sum(F.when(of, F.col(c))), k.cast("double")))
    # n sum(x^2) - sum(x)^2 in whole numbers: nothing is lost where they nearly cancel
    spread = one(F.try_divide((k * q - s * s).cast("double"), k.cast("double") * k.cast("double")))
    return [
        mean("piece").alias("avg_token_char_length"), one(F.try_divide(s.cast("double"), k.cast("double"))).alias("avg_token_count_per_sentence"), spread.alias("token_count_variance"),
        F.sqrt(spread).alias("token_count_stddev"), F.coalesce(F.min("n"), F.lit(0)).cast("long").alias("token_count_min"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("token_count_max"),
        one(F.percentile("n", F.lit(0.5), F.when(of, F.col("times")).otherwise(0))).alias("token_count_median"), mean("density").alias("avg_token_per_char"),
    ]


def token_statistics_by(rows: DataFrame, tokenizers: dict[int, Column], sentence: str = "sentence") -> DataFrame:
    """A report row for each tokenizer, a vocabulary size with its array of tokens, all from one pass. Tokens are not null.

    Means of ratios are taken over sentences; variance and deviation are those of the population.
    """
    kinds = F.array(*(F.struct(F.lit(v).alias("vocab_size"), t.alias("t")) for v, t in tokenizers.items()))
    each = rows.select(F.length(sentence).alias("l"), F.explode(kinds).alias("k")).select("l", "k.vocab_size", "k.t")
    n, chars = F.size("t"), F.length(F.array_join("t", ""))
    # a sentence's numbers are made before it is exploded: beside the explosion they would be made again for every token
    made = each.select("vocab_size", n.alias("n"), ratio(chars, n).alias("piece"), ratio(n, F.col("l")).alias("density"), F.concat(F.array(F.lit(None).cast("string")), F.col("t")).alias("t"))
    per = made.select("vocab_size", "n", "piece", "density", F.explode("t").alias("token"))
    own = F.col("token").isNull()
    counts = per.groupBy("vocab_size", "token", F.when(own, F.col("n")).alias("n")).agg(
        F.count("*").alias("times"), F.sum(F.when(own, F.col("piece"))).alias("piece"), F.sum(F.when(own, F.col("density"))).alias("density")
    )
    low = F.count_if(F.col("token").isNotNull() & (F.col("times") <= LOW)).alias("low_frequency_token_count")
    found = counts.groupBy("vocab_size").agg(*sentence_report(counts), low)
    # sizes without a sentence have a row as well
    sizes = rows.sparkSession.createDataFrame([(v,) for v in tokenizers], "vocab_size int")
    report = sizes.join(found, "vocab_size", "left").fillna(0)
    return _with_ratio(report)


def _with_ratio(report: DataFrame) -> DataFrame:
    low = F.col("low_frequency_token_count")
    return report.withColumn("low_frequency_token_ratio", ratio(low, F.when(F.col("vocab_size") > 0, F.col("vocab_size")))).fillna(0.0, ["low_frequency_token_ratio"]).select(*REPORT)


def token_statistics(rows: DataFrame, vocab_size: int, tokens: str = "tokens", sentence: str = "sentence") -> DataFrame:
    """One report row."""
    return token_statistics_by(rows, {vocab_size: F.col(tokens)}, sentence)


def report_of(sizes: DataFrame, tokens: DataFrame) -> DataFrame:
    """A report row for each vocab_size from sentences counted by size (vocab_size, n, times, piece, density) and tokens (vocab_size, token, times)."""
    low = tokens.groupBy("vocab_size").agg(F.count_if(F.col("times") <= LOW).alias("low_frequency_token_count"))
    found = sizes.groupBy("vocab_size").agg(*sentence_report(sizes))
    return _with_ratio(found.join(F.broadcast(low), "vocab_size", "left").fillna(0))  # a row for each size


def coverage(frequency: DataFrame, sizes: DataFrame) -> DataFrame:
    """(i, vocab_size, covered, total): occurrences of the ``vocab_size`` most frequent tokens, and of all.

    Tokens are never ranked: they are counted by frequency first, and there are far fewer frequencies than tokens.
    """
    by = frequency.groupBy("n").agg(F.count("*").alias("tokens"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # a row a frequency
    by = by.select("n", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    inside = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("vocab_size") - F.col("before")))
    pairs = by.crossJoin(F.broadcast(sizes))  # a few sizes
    return pairs.groupBy("i", "vocab_size").agg(F.sum(F.col("n") * inside).cast("long").alias("covered"), F.sum(F.col("n") * F.col("tokens")).cast("long").alias("total"))
