"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last return the columns of
``documents``. The mixing stage keeps every document and writes them in the order of the mixture, which the packing stage
takes from the files and follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import language, mixing, near_copies, packing, personal_data
from glyphmill.llm.common import Scratch, table

#: A document is no language when the flat background explains more than this share of it.
MOST_BACKGROUND = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that are mostly no language, go."""
    known = docs.where(F.col("doc_id").isNotNull() & ~language.is_held_out(F.col("doc_id")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = docs.select(row, language.infer(language.fit(known), F.col("text"), spark).alias("found"))
    return found.where((F.col("found.lang") != "und") & (F.col("found.background") <= MOST_BACKGROUND)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near-copies stays, the one with the smallest doc_id."""
    return near_copies.without_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets."""
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the Pfair schedule."""
    return mixing.mix(docs).orderBy("slot", "start", "row.doc_id").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences are filled and numbered in the order in which the mixing stage has written the documents."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ordered=True)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Mixture inference, sampling and the tokenizer can't be said in SQL; tests check what the stages keep and in which order run() packs it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
