"""Best-fit packing planned on a histogram of lengths.

1. ``tokenize_pieces`` turns every text into token ids and cuts only those longer than the capacity.
2. ``plan`` packs *counts*: the histogram has at most ``capacity`` rows, so planning costs the same for any corpus.
3. ``pack`` gives each piece a rank within its length, and joins it by length and rank to the planned slot it takes. With a column
   ``at``, pieces are ranked by it, and sequences are numbered by the least ``at`` that they hold, so that reading them
   one after another follows that order as far as whole sequences can.

Rows: a null or empty text is one piece holding the end token alone; repeated rows are packed each; columns other than
doc_id and text are not read, so names may clash with those made here; an empty table packs to an empty table. A null
doc_id is kept as it is.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, shuffle_partitions, small_batches
from glyphmill.llm.merges import LONGEST, Merges
from glyphmill.sources.catalog import with_row_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries at which a worker's word cache is emptied; a batch of at most BATCH_CHARS adds to it. Words encoded at once.
CACHE_WORDS, BATCH_CHARS, LEARN = 600_000, 4_000_000, 500
#: Ranks of a slot that are unrolled at once.
PART = 50_000
#: Bits for the rows of a file in ``at``.
FILE_BITS = 36
#: Python splits at these, the tokenizer's patterns don't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks that may stand behind a word.
MARKS = ".,;:!?"
#: A word of Latin letters that have one lower case each, of at most LONGEST bytes, and perhaps a mark.
PLAIN = re.compile(f"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{{1,{LONGEST // 2}}})([{MARKS}]?)")
_tokenizers: dict = {}


class WordIds:
    """Ids of texts by way of their stretches without white space.

    White space always ends a token of the word-level vocabulary and never survives it, so a text's ids are those of
    its stretches one after another. Stretches not met lately are encoded together, and told apart by their offsets.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.merges = Merges(path)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Latin letters, with or without a mark behind them, are merged all at once; the tokenizer itself reads the others.

        Letters alone are one word to the tokenizer, which reads them in lower case; a mark behind them is another.
        """
        others, plain = words, []
        if self.merges.usable:
            found = list(map(PLAIN.fullmatch, words))
            plain = [(m[0], m[1].lower(), m[2]) for m in found if m]
            others = [w for w, m in zip(words, found) if not m]
        letters = list({p for _, p, _ in plain})
        parts = dict(zip(letters, self.merges.encode([p.encode() for p in letters])))
        ends = {m: np.array([self.merges.word_of[m]], "<u4").tobytes() if m else b"" for m in ("", *MARKS)} if plain else {}
        self.known.update((w, parts[p] + ends[m]) for w, p, m in plain)
        for at in range(0, len(others), LEARN):
            self.by_offsets(others[at : at + LEARN])

    def by_offsets(self, words: list[str]) -> None:
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids) // 4)
        cuts = [0, *(4 * np.searchsorted(starts, ends, "left")).tolist()]
        self.known.update(zip(words, (ids[a:b] for a, b in zip(cuts, cuts[1:]))))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        odd = [any(c in t for c in ODD_SPACE) for t in texts]
        words = [[] if o else t.split() for t, o in zip(texts, odd)]
        self.learn(list(set().union(*words) - self.known.keys()))
        for t, o, w in zip(texts, odd, words):
            yield self.encode(t) if o else b"".join(map(self.known.__getitem__, w))


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours together, up to BATCH_CHARS characters."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def file_order(docs: DataFrame) -> DataFrame:
    """The documents of a Parquet table with ``at``: they are in order of ``at`` as the table was written.

    The number of the part file is in the upper bits.
    """
    part, split = (F.regexp_extract(F.col("_metadata.file_name"), f, 1).try_cast("long") for f in (r"^part-(\d+)", r"-c(\d+)\."))
    number = F.coalesce(part, F.lit(0)) * 1000 + F.coalesce(split, F.lit(0))
    return docs.select("doc_id", "text", (F.shiftleft(number, FILE_BITS) + F.col("_metadata.row_index")).alias("at"))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, ordered: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: PIECES, and the document's ``at`` where ``ordered``."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            docs_in, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            places = batch.column(2).to_pylist() if ordered else docs_in
            for lo, hi in groups([len(t) for t in texts]):
                for doc, place, ids in zip(docs_in[lo:hi], places[lo:hi], words.texts(texts[lo:hi])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), place)[: len(kinds)])
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        words.known.clear()  # the worker goes on to other stages

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["at"] if ordered else [])]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())[: len(names)]
    wanted = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col("at")] if ordered else [])]
    return docs.select(*wanted).mapInArrow(cut, PIECES + (", at long" if ordered else ""))


SLOTS = ("length", "first", "ranks", "sequence", "copies", "place")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, copies, offset) for a histogram {length: pieces}.

    A sequence takes the longest piece left, then again and again the longest that still fits (the best fit for its
    gap). That pattern is used as often as the counts allow before the next one is looked for, so each pattern uses up
    a length, and the plan's size depends on the capacity alone.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths, rank, slots, sequence = list(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        pattern, gap = [], capacity
        for n in lengths:
            if n <= gap:
                copies = min(left[n], gap // n)
                pattern.append((n, copies, capacity - gap))
                gap -= n * copies
                if not gap:
                    break
        times = min(left[n] // copies for n, copies, _ in pattern)
        for n, copies, offset in pattern:
            slots.append((n, rank[n], times * copies, sequence, copies, offset))
            rank[n] += times * copies
            left[n] -= times * copies
        sequence += times
        lengths = [n for n in lengths if left[n]]
    return sorted(slots)


def slot_table(spark: SparkSession, slots: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """By way of an Arrow table, as rows in a list would start further workers, which stay beside the others."""
    cols = list(zip(*slots)) or [[]] * len(SLOTS)
    return spark.createDataFrame(pa.table({name: pa.array(c, pa.int64()) for name, c in zip(SLOTS, cols)}))


def places(slots: DataFrame) -> DataFrame:
    """(length, rank, sequence_id, offset) for every rank of the planned slots, unrolled in parts of PART ranks."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ranks") - 1) / PART))).alias("part")
    parts = slots.select("*", part).repartition(shuffle_partitions(slots.sparkSession), "length", "first", "part")
    k = F.explode(F.sequence(F.col("part") * PART, F.least(F.col("part") * PART + PART, F.col("ranks")) - 1)).alias("k")
    each = parts.select("length", "first", "sequence", "copies", "place", k)
    sequence = F.col("sequence") + F.floor(F.col("k") / F.col("copies"))
    return each.select("length", (F.col("first") + F.col("k")).alias("rank"), sequence.alias("sequence_id"), (F.col("place") + F.col("k") % F.col("copies") * F.col("length")).alias("offset"))


def pack(pieces: DataFrame, capacity: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A length that a third of all pieces have is ranked in many salted parts, whose sizes are added up first. The parts
    of ordered pieces are those of one file each.
    """
    ordered = "at" in pieces.columns
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["at"] if ordered else [])]
    pieces = scratch.save(pieces.select(*names), "pieces")
    total = pieces.count()
    salts = max(64, total // 100_000)
    salt = F.shiftright("at", FILE_BITS) if ordered else F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    salted = pieces.withColumn("salt", salt)
    sizes = scratch.save(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy(*(["at"] if ordered else []), "doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(firsts, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("first") + F.col("rank") - 1).alias("rank"))

    packed = ranked.join(places(slot_table(spark, plan(histogram, capacity))), ["length", "rank"]).select(*names, "sequence_id", "offset")
    if not ordered:
        return packed
    packed = scratch.save(packed, "packed")
    firsts = packed.groupBy(F.col("sequence_id").alias("planned")).agg(F.min(F.struct("at", "piece", "sequence_id")).alias("first"))
    numbers = with_row_ids(scratch.save(firsts, "first_pieces"), "first", "number").select("planned", (F.col("number") - 1).alias("number"))
    packed = packed.join(numbers, F.col("sequence_id") == F.col("planned"))
    return packed.select(*names[:-1], F.col("number").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, ordered: bool = False) -> DataFrame:
    """``ordered``: the documents are a Parquet table whose order the sequences follow."""
    docs = file_order(docs) if ordered else docs
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id, ordered), capacity)
