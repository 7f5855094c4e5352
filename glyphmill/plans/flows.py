"""The three flows from corpus to text, over a catalog of tables: prepare, vectorise and report, train and generate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import scalars
from glyphmill.functions.normalize import normalize
from glyphmill.operators import decode, nextword, reduce, stats, subword, windows
from glyphmill.plans.observe import span
from glyphmill.sources.catalog import Catalog, decimals, info_lines, key_values, write_sentences, write_table, write_tsv


def prepare(spark: SparkSession, origin: DataFrame, catalog: Catalog) -> DataFrame:
    """The normalised corpus, stored as a table and as a text file with a sentence a line."""
    with span("normalise"):
        write_table(origin.where("sentence IS NOT NULL").withColumn("sentence", normalize(F.col("sentence"))), catalog.path("corpus_normalized"))
        write_sentences(spark.read.schema(origin.schema).parquet(catalog.path("corpus_normalized")), catalog.path("corpus_text"))
    return spark.read.schema(origin.schema).parquet(catalog.path("corpus_normalized"))


def sweep(spark: SparkSession, corpus: DataFrame, sizes: list[int], catalog: Catalog) -> DataFrame:
    """A vocabulary for each size, stored, and a report row for each: the corpus is read once for all fits and once for all rows."""
    models, words = subword.fit_sweep(corpus, sizes)
    for n, model in models.items():
        subword.save_model(spark, model, catalog.path("model", vocab_size=n))
        write_table(subword.vocabulary(spark, model), catalog.path("vocab", vocab_size=n))
    report = subword.sweep_statistics(corpus, words, models)
    write_tsv(report, catalog.path("token_statistics"))
    return report


def final_vocabulary(spark: SparkSession, corpus: DataFrame, size: int, catalog: Catalog) -> subword.Vocabulary:
    model = subword.fit_final_vocabulary(corpus, size)
    subword.save_model(spark, model, catalog.path("model_final"))
    write_table(subword.vocabulary(spark, model), catalog.path("vocab_final"))
    info_lines(stats.token_statistics(subword.encoded(corpus, model), size)).orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(catalog.path("vocab_info"))
    return model


def vectorise(spark: SparkSession, corpus: DataFrame, model: subword.Vocabulary, catalog: Catalog, width: int = 15, slide: int = 1) -> DataFrame:
    """Context windows with labels, stored as one table keyed (row_id, pos)."""
    ids = subword.encoded(corpus, model).select("row_id", "ids")
    found = windows.sparse_rows(ids, subword.BOS, subword.EOS, width, slide, "ids").withColumn("values", F.col("values").cast("array<float>"))
    write_table(found, catalog.path("context_windows"))
    return spark.read.parquet(catalog.path("context_windows"))


def compress(spark: SparkSession, vectors: DataFrame, vocab: int, catalog: Catalog, step: int = 200, least: int = 1000) -> DataFrame:
    """One decomposition at the largest dimension, stored, and a report row for each; a smaller model is its first rows."""
    with span("svd sweep"):
        dims = scalars.dim_ladder(vocab, scalars.max_components(vectors.count(), vocab), step, least)
        spectrum, v = reduce.svd_spectrum(reduce.sparse_features(vectors), vocab, max(dims))
        write_table(reduce.components_table(spark, v), catalog.path("svd_model"))
        report = reduce.svd_report(reduce.spectrum_table(spark, spectrum), vocab, dims)
        write_tsv(reduce.formatted(report), catalog.path("svd_report"))
    return report


def compress_pca(spark: SparkSession, vectors: DataFrame, vocab: int, k: int, catalog: Catalog) -> DataFrame:
    """The PCA model of ``k`` dimensions, stored, and its report as key and value lines without a header."""
    if not 1 <= k <= scalars.max_components(vectors.count(), vocab):
        raise ValueError(f"{k} dimensions don't lie between 1 and the matrix's rank")
    with span("pca"):
        spectrum, v = reduce.pca_spectrum(reduce.sparse_features(vectors), vocab, k)
        write_table(reduce.components_table(spark, v), catalog.path("pca_model", dim=k))
        report = reduce.pca_report(reduce.spectrum_table(spark, spectrum), vocab, k)
        write_tsv(key_values(reduce.formatted(report)).orderBy("at").select("key", "value").coalesce(1), catalog.path("pca_report", dim=k), header=False)
    return report


def generate(spark: SparkSession, weights: list, model: subword.Vocabulary, mode: str, text: str = "", seed: int = 0, catalog: Catalog | None = None, **options) -> DataFrame:
    """Generated lines; with a catalog they are also stored as a text file."""
    found = decode.generate(decode.seeds_for(spark, mode, text), weights, model, seed=seed, **options)
    lines = decode.lines(found, mode == "none10")
    if catalog:
        lines.coalesce(1).write.mode("overwrite").text(catalog.path("predicted", mode=mode))
        lines = spark.read.schema("value string").text(catalog.path("predicted", mode=mode))
    return lines


def train(vectors: DataFrame, vocab: int, catalog: Catalog, **options):
    """Weights and log; the whole run's log is also stored as TSV with eight decimals."""
    with span("train"):
        trained = nextword.train(vectors, vocab, catalog.path("training"), **options)
        log = nextword.run_log(vectors.sparkSession, catalog.path("training")).orderBy("epoch")
        numbers = (decimals(F.col(c), 8).alias(c) for c in ("loss", "sparse_categorical_accuracy"))
        write_tsv(log.select("epoch", *numbers).coalesce(1), catalog.path("training_log"))
    return trained
