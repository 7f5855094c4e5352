"""Canonical exact digests of documents, with DataFrame functions only.

A text is brought to its canonical form (Unicode NFKC, case folded, white space runs folded to one space and trimmed)
and digested by two seeded 64-bit xxhashes. Whole and edited texts are grouped by that wide hash; inside every bucket of
two or more the canonical bytes themselves are compared, and where two forms share a bucket the fingerprints of that
bucket carry a second digest, so that equal fingerprints mean equal canonical bytes.

The digest is exact: the likeness of two fingerprints is 1 where they are equal and else 0.

Rows: a null text counts as empty; a null doc_id sorts below all others; several rows of one doc_id are ordered by
their text's hash, and rows that repeat both doc_id and text count as one document whose result each of them gets.
Other columns are not read. An empty table gives an empty table; a single document is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, shuffle_partitions

#: Rows of 16 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def nfkc(text: Column) -> Column:
    """Unicode NFKC by the ICU library that Spark itself uses for collations. ``text`` must not be null."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def fold(text: Column) -> Column:
    """Upper and then lower case also folds letters such as sharp s; any Unicode white space becomes one space.

    White space goes between the two, as Spark takes lower(upper(x)) for lower(x).
    """
    return F.lower(F.trim(F.regexp_replace(F.upper(text), r"(?U)\s+", " ")))


def wide_hash(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def hex_of(*hashes: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in hashes))


def canonical(docs: DataFrame, text: str, canon: str) -> DataFrame:
    """Adds the canonical form; in a step of its own, so that it is worked out once a row."""
    return docs.withColumn(canon, fold(nfkc(F.col(text))))


def same(a: list[str], b: list[str]) -> list[Column]:
    return [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)]


def kept_small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def clashing_buckets(forms: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(h1, h2) of the buckets of ``forms`` (h1, h2, canon) that hold different canonical bytes.

    Copies within a task are one row before the shuffle, by the hash and the bytes.
    """
    members = forms.groupBy("h1", "h2", "canon").count()
    clash = scratch.save(members.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "clashes")
    return clash, clash.count()


def next_documents(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """For each distinct document its key, numbers and hashes, and those of the next one in descending doc_id, round the end.

    Only ids are sorted: into ranges, in which a window finds the neighbour; the last of a range takes the first of the
    next range.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    one = heads.groupBy("doc_id", "t1", "t2").agg(F.min("n_chars").alias("n_chars"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    one = one.withColumn("key", key).repartitionByRange(shuffle_partitions(heads.sparkSession), F.desc("key"), "t1", "t2")
    one = scratch.save(one.withColumn("part", F.spark_partition_id()), "ranged")
    order = (F.desc("key"), "t1", "t2")
    row = F.struct("doc_id", "t1", "t2", "h1", "h2")
    firsts = one.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where("at = 1").select("part", row.alias("first"))
    # a row per range: the first document of the range after it, and of the first range after the last
    following = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))).alias("first"))
    inside = one.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(following, "part").select("doc_id", "t1", "t2", "n_chars", "h1", "h2", F.coalesce("next", "first").alias("next"))


def edited_documents(docs: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, t1, t2, n_chars, h1, h2, n1, n2, nt1, nt2, edited) of every row: the edited text has its last third
    replaced by as many leading characters of the next document, whose text's hashes are nt1, nt2, its form's n1, n2."""
    # each document hands its first characters to the one before it
    to_prior = pairs.select(
        *(F.col(f"next.{c}").alias(f"x_{c}") for c in ("doc_id", "t1", "t2")),
        *(F.col(c).alias(f"p_{c}") for c in ("doc_id", "t1", "t2", "n_chars", "h1", "h2")),
        F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2"),
    )
    own, other, prior = ["doc_id", "t1", "t2"], ["x_doc_id", "x_t1", "x_t2"], ["p_doc_id", "p_t1", "p_t2"]
    given = docs.join(to_prior, same(own, other)).select(
        *prior, F.col("p_n_chars").alias("n_chars"), "p_h1", "p_h2", "n1", "n2", F.col("t1").alias("nt1"), F.col("t2").alias("nt2"),
        F.substring("text", F.lit(1), F.floor(F.col("p_n_chars") / 3).cast("int")).alias("head"),
    )
    if repeated:
        given = given.dropDuplicates(prior)
    both = docs.join(given, same(own, prior))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited")
    return both.select("doc_id", "t1", "t2", "n_chars", F.col("p_h1").alias("h1"), F.col("p_h2").alias("h2"), "n1", "n2", "nt1", "nt2", edited)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    All texts are shuffled once, by document; of the next documents only their leading characters travel. Texts whose
    wide hash several whole or edited texts have are read again, for a comparison of their bytes. A fingerprint is the
    wide hash, with the bytes' SHA-256 behind it where bytes of that bucket differ.
    """
    scratch = Scratch(documents.sparkSession, "digests")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumns({"t1": F.xxhash64(F.lit(3), "text"), "t2": F.xxhash64(F.lit(4), "text")})
    text, row = ["t1", "t2"], ["doc_id", "t1", "t2"]
    heads = canonical(docs, "text", "canon").select(*row, F.length("text").cast("long").alias("n_chars"), *wide_hash(F.col("canon")))
    heads = scratch.save(heads, "heads")
    pairs = scratch.save(next_documents(heads, scratch), "pairs")
    edits = canonical(edited_documents(docs, pairs, pairs.count() < heads.count()), "edited", "canon")
    e1, e2 = wide_hash(F.col("canon"))
    rows = edits.select(*row, "n_chars", "h1", "h2", "n1", "n2", "nt1", "nt2", e1.alias("e1"), e2.alias("e2"), F.sha2("edited", 256).alias("edited_sha256"))
    rows = scratch.save(rows, "rows")

    each = rows.select(*row, F.col("e1").alias("h1"), F.col("e2").alias("h2")).distinct()
    many = heads.select("h1", "h2").union(each.select("h1", "h2")).groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    many = kept_small(scratch.save(many, "buckets"))
    texts = kept_small(scratch.save(heads.join(many, ["h1", "h2"], "left_semi").select(*text).distinct(), "texts"))
    edited = kept_small(scratch.save(each.join(many, ["h1", "h2"], "left_semi").select(*row), "edited"))
    whole = canonical(docs.join(texts, text, "left_semi"), "text", "canon").select(*text, "canon", *wide_hash(F.col("canon")))
    again = pairs.join(edited.select(*(F.col(c).alias(f"w_{c}") for c in row)), same(row, [f"w_{c}" for c in row]), "left_semi")
    again = scratch.save(again, "again")
    needed = again.select(*row).union(again.select("next.doc_id", "next.t1", "next.t2")).distinct().select(*(F.col(c).alias(f"w_{c}") for c in row))
    needed = kept_small(scratch.save(needed, "needed"))
    again = edited_documents(docs.join(needed, same(row, [f"w_{c}" for c in row]), "left_semi"), again, True).dropDuplicates(row)
    again = canonical(again, "edited", "canon").select(*row, "canon", *wide_hash(F.col("canon")))
    clash, clashes = clashing_buckets(whole.select("h1", "h2", "canon").union(again.select("h1", "h2", "canon")), scratch)

    own, other, following = hex_of(F.col("h1"), F.col("h2")), hex_of(F.col("e1"), F.col("e2")), hex_of(F.col("n1"), F.col("n2"))
    if clashes:  # equal wide hashes of different bytes: tell them apart by a second digest
        clash = kept_small(clash)
        tail = F.concat(F.lit("-"), F.sha2("canon", 256)).alias("tail")
        w = scratch.save(whole.join(clash, ["h1", "h2"], "left_semi").select(*text, tail).distinct(), "tails")
        e = scratch.save(again.join(clash, ["h1", "h2"], "left_semi").select(*row, tail).distinct(), "edited_tails")
        rows = rows.join(w.withColumnRenamed("tail", "h_tail"), text, "left")
        rows = rows.join(w.select(F.col("t1").alias("nt1"), F.col("t2").alias("nt2"), F.col("tail").alias("n_tail")), ["nt1", "nt2"], "left")
        e = e.select(*(F.col(c).alias(f"e_{c}") for c in row), F.col("tail").alias("e_tail"))
        rows = rows.join(e, same(row, [f"e_{c}" for c in row]), "left")
        own, other, following = (F.concat(x, F.coalesce(t, F.lit(""))) for x, t in ((own, "h_tail"), (other, "e_tail"), (following, "n_tail")))
    out = rows.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), other.alias("edited_fingerprint"), following.alias("next_fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
