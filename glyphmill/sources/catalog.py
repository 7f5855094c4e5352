"""Where artifacts live and what they look like; readers and writers with declared schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.sources.scratch import Scratch

CORPUS = "row_id long, sentence string, target string, polarity string"
VOCABULARY = "vocab_id int, vocab string, score double"
WINDOWS = "row_id long, pos int, y int, indices array<int>, values array<float>"
TRAIN_LOG = "epoch string, loss string, sparse_categorical_accuracy string"
# fixed values: names of the artifacts of earlier runs
CHECKPOINT = r"^(?:.*/)?next_word_model_epoch_(\d+)\.(?:h5|keras)$"
VOCABULARIES = "*_tokenized_*.db"


class Catalog:
    """Artifact names to paths under one root."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, artifact: str, **parts) -> str:
        return "/".join([self.root, artifact, *(f"{k}={v}" for k, v in parts.items())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a corpus CORPUS, with the quality label for a polarity; rows without a sentence are left out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"), F.col("source").alias("target"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("polarity"))
    return docs.where("sentence IS NOT NULL").join(labels, "row_id", "left").select("row_id", "sentence", "target", "polarity")


def with_row_ids(rows: DataFrame, order: str, name: str = "row_id", scratch: Scratch | None = None) -> DataFrame:
    """Dense keys 1..N in the order of a column; ties by the hash of the whole row, and equal rows in any order.

    Rows are sorted in ranges and stored with their place in their range, as a range exchange that is planned again may
    draw other bounds. They are shuffled once; only a count per range goes through one task.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "row-ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    ranged = rows.withColumn("_tie", tie).repartitionByRange(n, order, "_tie").sortWithinPartitions(order, "_tie").drop("_tie")
    # a partition's rows are numbered in its upper bits and from 0 in the lower 33
    stored = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()), f"ranged-{uuid.uuid4().hex}")
    stored = stored.withColumns({"_part": F.shiftright("_at", 33), "_k": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return stored.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_k") + 1).cast("long")).drop("_part", "_start", "_k", "_at")


#: Rows of a table that is broadcast for a lookup, and parts that a frequent key is dealt to beyond that.
LOOKUP_ROWS, SALTS = 1_000_000, 16


def looked_up(rows: DataFrame, names: DataFrame, key: str, size: int) -> DataFrame:
    """An equi-join with a table of ``size`` rows and distinct keys, where single keys of ``rows`` may be very frequent.

    A small table is broadcast, so ``rows`` aren't shuffled. A larger one is copied to SALTS parts, over which the rows of
    each key are dealt out by their own hash.
    """
    if size <= LOOKUP_ROWS:
        return rows.join(F.broadcast(names), key)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(SALTS)).cast("int")
    copies = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def write_counted(df: DataFrame, path: str) -> int:
    """Replaces what is there; the rows are counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_sentences(sentences: DataFrame, path: str) -> None:
    """One sentence a line; line ends inside become spaces."""
    sentences.select(F.regexp_replace("sentence", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)


def decimals(x: Column, digits: int = 4) -> Column:
    """Fixed decimals of the number exactly as it is stored, ties to even, as C's printf has them. For up to 2^53 / 10^digits."""
    scale = F.lit(10.0**digits)
    p = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the bits, so that both products are exact
    rest = (high * scale - p) + (x - high) * scale
    n = F.when((p - F.floor(p)) != 0.5, F.rint(p)).when(rest > 0, F.ceil(p)).when(rest < 0, F.floor(p)).otherwise(F.rint(p))
    return F.format_string(f"%.{digits}f", n.cast("double") / scale)


def key_values(row: DataFrame) -> DataFrame:
    """(key, value) of a one-row report, in the order of its columns."""
    pairs = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for i, c in enumerate(row.columns)))
    return row.select(F.explode(pairs).alias("p")).select("p.at", "p.key", "p.value")


def info_lines(row: DataFrame) -> DataFrame:
    """A header line and a value line, comma-separated."""
    lines = F.array(F.lit(", ".join(row.columns)), F.concat_ws(", ", *(F.col(c).cast("string") for c in row.columns)))
    return row.select(F.posexplode(lines).alias("line", "value"))


def append_log(rows: DataFrame, path: str, reset: bool = False) -> None:
    rows.write.mode("overwrite" if reset else "append").parquet(path)


def last_epoch(log: DataFrame) -> DataFrame:
    """The largest epoch that can be read as a number; 0 for an empty log."""
    return log.select(F.trim("epoch").try_cast("int").alias("e")).agg(F.coalesce(F.max("e"), F.lit(0)).alias("last_epoch"))


def checkpoint_epoch(name: Column) -> Column:
    return F.regexp_extract(name, CHECKPOINT, 1).try_cast("int")


def latest_checkpoint(names: DataFrame) -> DataFrame:
    """(name, epoch) of the newest checkpoint; of equal epochs the name that sorts last."""
    found = names.withColumn("epoch", checkpoint_epoch(F.col("name"))).where("epoch IS NOT NULL")
    return found.agg(F.max_by("name", F.struct("epoch", "name")).alias("name"), F.max("epoch").alias("epoch")).where("name IS NOT NULL")


def stored_paths(spark: SparkSession, folder: str, names: str = VOCABULARIES) -> DataFrame:
    """(path) of the files under a folder whose names fit; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(folder).select("path")


def listed_sizes(paths: DataFrame) -> DataFrame:
    """(path, vocab_size) from the number in each name, ascending; a path without one is an error."""
    found = F.regexp_extract("path", r"(\d+)[^/\d]*$", 1)
    size = F.when(found != "", found.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no vocabulary size in "), F.col("path"))).cast("int"))
    return paths.select("path", size.alias("vocab_size")).orderBy("vocab_size")
