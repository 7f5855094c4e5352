"""Near-copies by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles are counted over all documents, by the shingles' 64-bit hashes: a shingle's
   weight is its count in the text times its inverse document frequency. Groups of documents send each distinct hash
   once to the range it lies in, where frequencies are added up, and get them back in the order of their hashes. A group
   sends a row to each range. With more text there are more ranges, and groups are as much larger, so that a row holds
   about 250 hashes and rows grow as the text does; from 25 billion characters on groups stay at 6 million, which bounds
   a task's memory, and rows get shorter instead.
2. Each text gets 64 consistent samples (Ioffe's improved scheme): two texts agree in a sample with probability equal to
   their weighted Jaccard similarity. Sixteen bands of four samples find candidates: at a similarity of 0.8 a pair is
   missed by all bands with probability 2e-4, at 0.9 with 1e-7.
3. Copies of a text are one node. In each bucket all texts are paired with the bucket's first text; pairs are verified
   by the exact weighted Jaccard similarity of the whole texts. Only classes matter, so pairs inside a class that is
   already linked are not looked at again. Of buckets that still hold several classes, outlines go to tasks (samples,
   total weight, weight by 256 bins of hashes), which tell by exact bounds which texts may be similar to another one.
   Only those texts follow, and tasks verify every pair of them that the bounds allow and that nothing has joined yet,
   those first that agree in the most samples.

Texts are compared in lower case, words are parted by white space; a text of one to four words is a single shingle.

Rows: a null text counts as empty; texts without words only match equal texts; repeated rows are copies; a null doc_id
is kept and comes last within its class; other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, components, free_shuffles, shuffle_partitions, small_batches

WORDS, SIMILARITY = 5, 0.8
SAMPLES, BANDS = 64, 16
#: Texts of a group whose pairs are verified, and outlines of a group whose pairs are looked at, with so many bins each.
BLOCK, OUTLINES, BINS = 700, 2000, 256
BATCH_CHARS = 2_000_000
BROADCAST_ROWS = 200_000
#: Characters of a block of texts whose pairs are verified.
BLOCK_CHARS = 4_000_000
#: Characters whose shingles are made at once, and shingles that are counted in a range of hashes.
GROUP_CHARS, RANGE = 200_000, 1_000_000
#: Characters of a group of documents for each range of hashes, and at most.
CELL_CHARS, MOST_CHARS = 1536, 6_291_456
#: Bytes of a stored table that a task holds, and groups of documents whose frequencies a task collects at once before it sorts them.
HELD, GROUPS = 16 << 20, 8
U = np.uint64


@lru_cache(1)
def white_space() -> np.ndarray:
    """Which code points part words, as ``str.split`` does."""
    return np.frombuffer(bytes(chr(c).isspace() for c in range(0x110000)), bool)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and each text's number of words.

    A word's hash is made of those of its characters with their places in it, all texts at once.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = white_space()[points]
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.zeros(0, U), counts
    place = np.arange(len(points), dtype=U)
    place -= np.repeat(np.append(0, first).astype(U), np.diff(np.concatenate([[0], first, [len(points)]])))
    place *= U(0xC2B2AE3D27D4EB4F)
    place ^= points * U(0x9E3779B97F4A7C15)
    place ^= place >> U(29)
    place *= U(0xD6E8FEB86659FD93)
    place ^= place >> U(32)
    place[blank] = 0
    h = np.add.reduceat(place, first)
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    return h, counts


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in order of text, then hash; their counts; and where each text's begin, with the end."""
    words, n_words = word_hashes(texts)
    sizes = np.where(n_words > 0, np.maximum(n_words, WORDS), 0)  # short texts are padded to one shingle
    ends = np.cumsum(sizes)
    h = np.zeros(int(ends[-1]) if len(ends) else 0, U)
    at = np.arange(len(words)) + np.repeat(ends - sizes - (np.cumsum(n_words) - n_words), n_words)
    h[at] = words
    n = max(0, len(h) - WORDS + 1)
    s = np.zeros(n, U)
    for k in range(WORDS):
        s = s * U(0x9E3779B97F4A7C15) + h[k : k + n]
    s ^= s >> U(32)
    s *= U(0xD6E8FEB86659FD93)
    s ^= s >> U(29)
    each = []
    for a, m in zip((ends - sizes).tolist(), sizes.tolist()):
        one = s[a : a + m - WORDS + 1] if m else s[:0]
        one.sort()
        each.append(one)
    s = np.concatenate(each) if each else s
    counts = np.array([len(x) for x in each], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[starts[:-1][counts > 0]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(at, starts)


def batches_of(sizes: list[int], chars: int | None = None) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > (chars or BATCH_CHARS):
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


@lru_cache(1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the samples, and 2^16 quantiles of Gamma(2, 1) and their logarithms."""
    p, lo, hi = (np.arange(1 << 16) + 0.5) / (1 << 16), np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    x, multipliers = 0x1234567, []
    for _ in range(SAMPLES):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        multipliers.append((x ^ (x >> 33)) | 1)
    return np.array(multipliers, U), lo.astype(np.float32), np.log(lo).astype(np.float32)


def exact_weights(tf: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """Of shingles that ``df`` of ``total`` documents have."""
    return tf.astype(np.float32) * np.log1p(total / df).astype(np.float32)


def sample(s: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of SAMPLES numbers for each text that has shingles."""
    multipliers, gamma, log_gamma = draws()
    first = starts[:-1][np.diff(starts) > 0]
    out = np.zeros((len(first), SAMPLES), np.uint32)
    if not len(first):
        return out
    log_w, n = np.log(w), len(s)
    x, y, at = np.empty(n, U), np.empty(n, U), np.empty(n, np.int64)
    r, beta, t, rank = (np.empty(n, np.float32) for _ in range(4))
    for k, m in enumerate(multipliers):  # into the same arrays again and again
        np.multiply(s, m, out=x)
        np.right_shift(x, U(31), out=y)
        np.bitwise_xor(x, y, out=x)
        np.right_shift(x, U(48), out=y)
        gamma.take(y.view(np.int64), out=r, mode="clip")
        np.right_shift(x, U(16), out=y)
        np.bitwise_and(y, U(0xFFFF), out=y)
        beta[:] = y
        beta *= np.float32(2**-16)
        np.divide(log_w, r, out=t)
        t += beta
        np.floor(t, out=t)
        at[:] = t
        np.right_shift(x, U(32), out=y)
        np.bitwise_and(y, U(0xFFFF), out=y)
        log_gamma.take(y.view(np.int64), out=rank, mode="clip")
        t -= beta
        t *= r
        rank -= t
        rank -= r
        rank += np.float32(4096)
        np.multiply(at.view(U), U(0x9E3779B97F4A7C15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.bitwise_and(x, U(0xFFFFFFFF), out=x)
        y[:] = rank.view(np.uint32)  # the bits of positive numbers are in the numbers' order
        np.left_shift(y, U(32), out=y)
        np.bitwise_or(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, first) & U(0xFFFFFFFF)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights)."""
    (sa, wa), (sb, wb) = a, b
    at = np.searchsorted(sb, sa)
    at[at == len(sb)] = 0
    hit = sb[at] == sa
    low = np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64)
    total = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low
    return float(low / total) if total else 1.0


def range_bits(chars: int) -> int:
    """Leading bits of a hash that tell its range, for so many characters of text."""
    return max(4, int(chars / 6 / RANGE).bit_length())


def grouped(docs: DataFrame, chars: int | None = None) -> DataFrame:
    """(gid, doc_id, t1, t2, text): arrays of some neighbours, as many as go with the ranges of ``chars`` characters of text."""
    most = GROUP_CHARS if chars is None else min(MOST_CHARS, CELL_CHARS << range_bits(chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in batches_of([len(t or "") for t in batch.column(3).to_pylist()], most):
                cols = [pa.array([batch.column(i).slice(lo, hi - lo).to_pylist()], pa.list_(kind)) for i, kind in enumerate((*[pa.int64()] * 3, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), *cols], ["gid", "doc_id", "t1", "t2", "text"])
                gid += 1

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(run, "gid long, doc_id array<long>, t1 array<long>, t2 array<long>, text array<string>")


def in_turn(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``shingles`` gives, for some texts of a group after others."""
    return (shingles(texts[lo:hi]) for lo, hi in batches_of([len(t) for t in texts], GROUP_CHARS))


def by_range(groups: DataFrame, bits: int) -> DataFrame:
    """(gid, range, hashes, n): a group's distinct hashes in each range, and how many of its texts have them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                s, n = np.unique(np.concatenate([np.zeros(0, U), *(x[0] for x in in_turn(texts.as_py()))]), return_counts=True)
                ranges = (s >> U(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(s)] if len(s) else []
                cols = [[ranges[a], s[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()] for a, b in zip(cuts, cuts[1:])]
                kinds = (pa.int64(), pa.binary(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(list(zip(*cols)) or [[]] * 3, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([gid] * len(cols), pa.int64()), *arrays], ["gid", "range", "hashes", "n"])

    return groups.select("gid", "text").mapInArrow(hashes, "gid long, range long, hashes binary, n binary")


def few_collected(spark: SparkSession) -> None:
    """Lists are collected for a few keys at once, as one holds all of a group's frequencies: Spark has 128 of them in memory, and then sorts.

    A choice that the session has made itself stands.
    """
    name, usual = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "128"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(GROUPS))


def frequencies(groups: DataFrame, chars: int | None = None) -> DataFrame:
    """(gid, dfs): document frequencies, as four-byte numbers by range, of a group's distinct shingles in the order of their hashes."""
    if chars is None:
        chars = groups.agg(F.sum(F.aggregate("text", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0] or 0

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf.hashes), U)
        order = np.argsort(h)
        h, n = h[order], np.frombuffer(b"".join(pdf.n), np.uint32)[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(h))))
        ends = np.cumsum([len(h) // 8 for h in pdf.hashes])[:-1]
        return pd.DataFrame({"gid": pdf.gid, "range": pdf.range, "df": [x.tobytes() for x in np.split(df, ends)]})

    back = by_range(groups, range_bits(chars)).groupBy("range").applyInPandas(add, "gid long, range long, df binary")
    return back.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("range", "df"))).alias("dfs"))


def sketches(groups: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """(doc_id, t1, t2, sig, df): hashes of the whole text, its samples, and its shingles' frequencies; null where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                parts, sigs, dfs = list(in_turn(row["text"])), [], []
                _, at = np.unique(np.concatenate([np.zeros(0, U), *(x[0] for x in parts)]), return_inverse=True)
                of_all = np.frombuffer(b"".join(x["df"] for x in row["dfs"] or []), np.uint32)[at]
                for (s, tf, starts), df in zip(parts, np.split(of_all, np.cumsum([len(x[0]) for x in parts]))):
                    rows = iter(sample(s, exact_weights(tf, df, total), starts))
                    sigs += [next(rows).tobytes() if m else None for m in np.diff(starts)]
                    dfs += [df[a:b].tobytes() if a < b else None for a, b in zip(starts, starts[1:])]
                ids = (pa.array(row[c], pa.int64()) for c in ("doc_id", "t1", "t2"))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sigs, pa.binary()), pa.array(dfs, pa.binary())], ["doc_id", "t1", "t2", "sig", "df"])

    joined = groups.join(counted.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g"), "left").select("doc_id", "t1", "t2", "text", "dfs")
    return joined.mapInArrow(run, "doc_id long, t1 long, t2 long, sig binary, df binary")


def vector_of(text: str, df: bytes, total: int) -> tuple[np.ndarray, np.ndarray]:
    s, tf, _ = shingles([text])
    return s, exact_weights(tf, np.frombuffer(df, np.uint32), total)


def verified(pairs: DataFrame, bodies: DataFrame, total: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Large groups of pairs with one text are split between tasks by the join."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        @lru_cache(64)
        def vector(text: str, df: bytes) -> tuple[np.ndarray, np.ndarray]:
            return vector_of(text, df, total)

        for x, f, y, g in batches:
            yield pd.Series([similarity(vector(a, m), vector(b, n)) for a, m, b, n in zip(x, f, y, g)], dtype=float)

    left = bodies.select(F.col("uid").alias("a"), F.col("text").alias("text_a"), F.col("df").alias("df_a"))
    right = bodies.select(F.col("uid").alias("b"), F.col("text").alias("text_b"), F.col("df").alias("df_b"))
    return pairs.join(right, "b").join(left, "a").where(score("text_a", "df_a", "text_b", "df_b") >= threshold).select("a", "b")


def outlines(bodies: DataFrame, total: int) -> DataFrame:
    """(uid, weight, bins): a text's total weight, and its weight by the first byte of the shingles' hashes.

    The lesser of two texts' weights in each bin, added up, is no less than what they share, which bounds the similarity.
    """

    @F.pandas_udf("weight double, bins binary")
    def outline(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dfs in batches:
            rows = []
            for text, df in zip(texts, dfs):
                s, w = vector_of(text, df, total)
                rows.append((w.sum(dtype=np.float64), np.bincount((s >> U(56)).astype(np.int64), w, BINS).astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["weight", "bins"])

    return bodies.select("uid", outline("text", "df").alias("o")).select("uid", "o.*")


def in_blocks(members: DataFrame, block: int, chars: int | None = None) -> DataFrame:
    """Each row of a bucket ``key`` for each pair (i, j) of blocks of the bucket that has the row's ``own`` block.

    A block has about ``block`` rows, and about ``chars`` characters where rows carry their texts, which bounds what a task holds.
    """
    held = F.sum(F.length("text")) / chars if chars else F.lit(0.0)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), held.alias("held"))
    blocks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / block, "held")))
    cut = members.join(sizes, "key").withColumn("blocks", blocks.cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "held", "blocks", "other")


def open_pairs(pdf: pd.DataFrame, threshold: float) -> Iterator[np.ndarray]:
    """Rows (agreement, p, q) of the pairs of a group that may be similar, that no class joins, and that share no earlier bucket."""
    n, band, cross = len(pdf), int(pdf.band.iat[0]), pdf.i.iat[0] != pdf.j.iat[0]
    own, comp, sums = pdf.own.to_numpy(), pd.factorize(pdf.comp)[0], pdf.weight.to_numpy()
    sig = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(n, SAMPLES)
    bins = np.frombuffer(b"".join(pdf.bins), np.float32).reshape(n, BINS)
    few, low = bins.reshape(n, 32, -1).sum(2), (threshold - 1e-3) / (1 + threshold)
    for lo in range(0, n, 64):
        hi = min(n, lo + 64)
        may = (np.arange(lo, hi)[:, None] < np.arange(n)) & (comp[lo:hi, None] != comp)
        # the lesser total weight by the greater bounds the similarity
        may &= np.minimum(sums[lo:hi, None], sums) >= (threshold - 1e-6) * np.maximum(sums[lo:hi, None], sums)
        if cross:
            may &= own[lo:hi, None] != own
        x, y = np.nonzero(may)
        x += lo
        for at in range(0, len(x), 10_000):
            p, q = x[at : at + 10_000], y[at : at + 10_000]
            # shared / (both - shared) >= threshold, with what the bins allow to be shared: some together first, then each
            for of in (few, bins):
                keep = np.minimum(of[p], of[q]).sum(1) >= low * (sums[p] + sums[q])
                p, q = p[keep], q[keep]
            same = sig[p] == sig[q]
            keep = same.reshape(-1, BANDS, SAMPLES // BANDS).all(2).argmax(1) == band
            yield np.stack([same[keep].sum(1), p[keep], q[keep]], 1)


def in_doubt(members: DataFrame, threshold: float) -> DataFrame:
    """(key, uid) of the texts that may be similar to another text of their bucket, judged without the texts."""

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.unique(x[:, 1:]) for x in open_pairs(pdf, threshold)]
        rows = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        return pdf[["key", "uid"]].iloc[rows]

    cut = in_blocks(members, OUTLINES).select("key", "i", "j", "own", "band", "uid", "comp", "sig", "weight", "bins")
    cut = cut.repartition(shuffle_partitions(members.sparkSession), "key", "i", "j")  # few bytes, but much to compare
    return cut.groupBy("key", "i", "j").applyInPandas(some, "key long, uid long").distinct()


def joined_in_buckets(members: DataFrame, total: int, threshold: float) -> DataFrame:
    """Links (a, b) between texts of one bucket, and not of one class, from (key, band, uid, comp, sig, weight, bins, text, df).

    A task looks at all pairs of a bucket that may be similar in order of the agreement of their samples, and verifies
    those that nothing has joined yet, so it returns fewer links than it has texts. A pair is looked at only in the first
    bucket that it shares. Large buckets are cut into blocks by rows and characters, and each pair of blocks is a group of its own.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        uid, texts, dfs = pdf.uid.to_numpy(), pdf.text.to_list(), pdf.df.to_list()
        comp = pd.factorize(pdf.comp)[0]

        @lru_cache(None)
        def vector(row: int) -> tuple[np.ndarray, np.ndarray]:
            return vector_of(texts[row], dfs[row], total)

        found = list(open_pairs(pdf, threshold))
        both = np.concatenate(found) if found else np.zeros((0, 3), int)
        both = both[np.argsort(-both[:, 0], kind="stable")]
        up, out = list(range(int(comp.max()) + 1)), []

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for p, q in (pair for at in range(0, len(both), 20_000) for pair in both[at : at + 20_000, 1:].tolist()):
            r, t = root(comp[p]), root(comp[q])
            if r != t and similarity(vector(p), vector(q)) >= threshold:
                up[r] = t
                out.append((uid[p], uid[q]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    cut = in_blocks(members, BLOCK, BLOCK_CHARS).select("key", "i", "j", "own", "band", "uid", "comp", "sig", "weight", "bins", "text", "df")
    return cut.groupBy("key", "i", "j").applyInPandas(links, "a long, b long")


def keyed(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumns({"t1": F.xxhash64(F.lit(1), "text"), "t2": F.xxhash64(F.lit(2), "text")})


def classes(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, t1, t2, class_id, kept): class_id is the class's smallest doc_id; one row of each class is kept."""
    spark: SparkSession = documents.sparkSession
    small_batches(spark)
    few_collected(spark)
    scratch = Scratch(spark, "near-copies", HELD)
    docs = keyed(documents)
    total, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = scratch.save(grouped(docs, chars), "groups")
    counted = scratch.save(frequencies(groups, chars), "counted")
    free_shuffles(spark)  # nothing refers to those of the counts any more
    rows = scratch.save(sketches(groups, counted, total).withColumn("rid", F.monotonically_increasing_id()), "rows")
    scratch.drop("groups")
    scratch.drop("counted")
    texts = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc"), F.max("sig").alias("sig"))
    texts = scratch.save(texts.withColumn("uid", F.monotonically_increasing_id()), "texts")

    size = 4 * SAMPLES // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * size + 1, F.lit(size))))
    banded = texts.where("sig IS NOT NULL").select("uid", F.posexplode(bands).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("rep")).where("n > 1").select("key", "rep")
    members = scratch.save(banded.join(shared, "key"), "members")

    wanted = members.select("uid").distinct().join(texts.select("uid", "t1", "t2", "doc"), "uid").select("uid", F.col("t1").alias("w1"), F.col("t2").alias("w2"), "doc")
    wanted = scratch.save(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    own = (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    counts = scratch.save(rows.join(wanted, own).select("uid", "df").dropDuplicates(["uid"]), "frequencies")
    bodies = docs.join(wanted, own).select("uid", "text").dropDuplicates(["uid"])
    bodies = scratch.save(bodies.join(counts, "uid"), "bodies")

    pairs = members.where("uid <> rep").select(F.col("rep").alias("a"), F.col("uid").alias("b")).distinct()
    links = scratch.save(verified(pairs, bodies, total, threshold), "links")
    found = components(scratch, links)
    classed = members.join(found, members["uid"] == found["node"], "left").select("key", "band", "uid", F.coalesce("component", "uid").alias("comp"))
    classed = scratch.save(classed, "classed")
    mixed = classed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = scratch.save(classed.join(mixed, "key"), "open")
    outlined = scratch.save(outlines(bodies.join(open_.select("uid").distinct(), "uid", "left_semi"), total), "outlines")
    open_ = scratch.save(open_.join(texts.select("uid", "sig"), "uid").join(outlined, "uid"), "outlined")
    doubt = scratch.save(in_doubt(open_, threshold), "doubt")
    more = scratch.save(joined_in_buckets(open_.join(doubt, ["key", "uid"]).join(bodies, "uid"), total, threshold), "more")
    if not more.isEmpty():
        found = components(Scratch(spark, "near-copies"), links.union(more))

    by_text = texts.join(found, texts["uid"] == found["node"], "left").select("t1", "t2", F.coalesce("component", "uid").alias("comp"))
    each = rows.select("doc_id", "t1", "t2", "rid").join(by_text, ["t1", "t2"])
    first = each.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    out = each.join(first, "comp")
    return out.select("doc_id", "t1", "t2", F.col("first.doc_id").alias("class_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def without_copies(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns."""
    kept = classes(documents, threshold).where("kept").select(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    kept = Scratch(documents.sparkSession, "near-copies").save(kept, "kept")
    row = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    row = row.select("row", F.col("row.doc_id").cast("long").alias("d"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("t"))
    row = row.select("row", "d", F.xxhash64(F.lit(1), "t").alias("t1"), F.xxhash64(F.lit(2), "t").alias("t2"))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    row = row.join(kept, same, "left_semi")
    row = row.withColumn("n", F.row_number().over(Window.partitionBy("d", "t1", "t2").orderBy("t1"))).where("n = 1")
    return row.select("row.*")
