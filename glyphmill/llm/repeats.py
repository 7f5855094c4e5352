"""Repeated byte strings by a sampled suffix sort.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is removed. Only suffixes at anchors are sorted:

1. Anchors are the positions whose hash of the next GRAM bytes is least in some window of LENGTH - GRAM + 1 positions.
   Any string of LENGTH bytes holds an anchor that the string alone determines, so equal strings share it.
2. Anchors whose hash occurs once are left out. The others' contexts (up to REACH = LENGTH - GRAM bytes before, the gram
   and as many behind) are grouped by hash; equal contexts are one class with a count before anything is shipped.
3. In each group the contexts are sorted deep-shallow, once by the bytes from the anchor on and once by the bytes before
   it, read backwards: multikey passes over words of eight bytes to a shallow depth, then blind tries for the ties.
   Neighbours' common lengths give classes of equal prefixes of any length, and a window that starts o bytes before the
   anchor occurs twice if its classes (o bytes before, LENGTH - o from the anchor) do. This is exact.
4. Groups of over HOT contexts aren't gathered in one task: their windows are counted by 128-bit hashes instead.

Rows: a null or empty text has no bytes; repeated rows count as repeats of each other; a null doc_id is kept; other
columns are not read; long runs of one byte make each position an anchor. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, shuffle_partitions, small_batches

LENGTH, GRAM = 200, 64
HOT, SHALLOW, CHUNK = 200_000, 4, 40_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out, m = np.ones(n, U), 1
        while m < n:
            step = min(m, n - m)
            out[m : m + step] = out[:step] * U(pow(base, m, 2**64))
            m += step
        _powers[base] = out
    return _powers[base][:n]


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window, by running values from both ends of blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, x[-1], x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead, back = op.accumulate(rows, 1).ravel(), op.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    c = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(pow(BASE, -1, 2**64), n), out=c[1:])
    h = (c[gram:] - c[:-gram]) * powers(BASE, n - gram + 1)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    return h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes; none in a text shorter than ``length``."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = gram_hashes(data, gram)
    least = sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, U)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) >= h)
    return at, h[at]


def context(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    """Bytes before the anchor, backwards, and from it on."""
    return text[max(0, at - length + gram) : at][::-1], text[at : at + length]


class BlindTrie:
    """Patricia trie of byte strings: inner nodes are [depth, {byte or -1 at the end: child}], leaves lists of rows."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, row: int) -> None:
        text, node = self.strings[row], self.root
        if node is None:
            self.root = (0, [row])
            return
        while node[0] != 0:  # blind descent: bytes between the branching points aren't looked at
            depth, children = node[1], node[2]
            b = text[depth] if depth < len(text) else -1
            node = children.get(b) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        if other == text:
            node[1].append(row)
            return
        n = min(len(text), len(other))
        x = int.from_bytes(text[:n], "big") ^ int.from_bytes(other[:n], "big")
        common = n - (x.bit_length() + 7) // 8
        mine, theirs = (t[common] if common < len(t) else -1 for t in (text, other))
        parent, node = None, self.root
        while node[0] != 0 and node[1] < common:
            parent, key = node, text[node[1]] if node[1] < len(text) else -1
            node = node[2][key]
        if node[0] != 0 and node[1] == common:
            node[2][mine] = (0, [row])
            return
        new = (1, common, {theirs: node, mine: (0, [row])})
        if parent is None:
            self.root = new
        else:
            parent[2][key] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """(row, length in common with the row before) in order; the first with 0."""
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if node[0] == 0:
                yield node[1][0], common
                for row in node[1][1:]:
                    yield row, len(self.strings[row])
            else:
                keys = sorted(node[2])
                stack += [(node[2][k], node[1]) for k in reversed(keys[1:])]
                stack.append((node[2][keys[0]], common))


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within ascending groups, and each one's length in common with the one before it there
    (-1 at a group's start)."""
    n = len(strings)
    shallow = b"".join(s[: 8 * SHALLOW].ljust(8 * SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(shallow, ">u8").reshape(n, SHALLOW).astype(U)
    length = np.array([len(s) for s in strings])
    order, rank = np.arange(n), group.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    split_at = np.full(n, -2, np.int64)  # where in the order a row parts from the one before: -1 a group, -2 not yet
    ranks = rank[order]
    split_at[np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))] = -1
    for d in range(SHALLOW):  # multikey passes: only ties go on
        start = np.flatnonzero(split_at != -2)
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            break
        word = words[order[tied], d]
        new = np.lexsort((word, run[tied]))
        order[tied], word, at = order[tied[new]], word[new], run[tied]
        parts = np.flatnonzero((at[1:] == at[:-1]) & (word[1:] != word[:-1])) + 1
        x = word[parts] ^ word[parts - 1]
        same = np.zeros(len(parts), np.int64)
        for k in range(8):
            same += (x >> U(8 * (7 - k)) == 0)
        # padding never makes two strings alike: none is longer in common than the shorter is long
        split_at[tied[parts]] = np.minimum(8 * d + same, np.minimum(length[order[tied[parts]]], length[order[tied[parts - 1]]]))
    common = split_at
    start = np.flatnonzero(split_at != -2)
    for a, b in zip(start.tolist(), np.append(start[1:], n).tolist()):
        if b - a > 1:
            trie = BlindTrie(strings)
            for row in order[a:b].tolist():
                trie.insert(row)
            for i, (row, same) in enumerate(trie.walk(), a):
                order[i] = row
                if i > a:
                    common[i] = same
    return order, common


def repeated_windows(group: np.ndarray, count: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes before and from the anchor on that repeated windows cover; (-1, -1) for none."""
    n, reach = len(group), length - gram
    len_l, len_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    (order_l, common_l), (order_r, common_r) = deep_shallow(left, group), deep_shallow(right, group)
    most, least = np.full(n, -1), np.full(n, length)
    of_l, of_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        rows = np.flatnonzero((len_l >= o) & (len_r >= length - o))
        if not len(rows):
            continue
        of_l[order_l] = np.cumsum(common_l < o)
        of_r[order_r] = np.cumsum(common_r < length - o)
        key = of_l[rows] * (n + 1) + of_r[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = count[rows] > 1
        twice[by[1:][same]] = twice[by[:-1][same]] = True
        hit = rows[twice]
        most[hit] = o
        least[hit] = np.minimum(least[hit], o)
    return most, np.where(most >= 0, length - least, -1)


def text_bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for t in batch.column(column).cast(pa.binary()):
        yield t.as_py() or b""


def anchor_rows(docs: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """(h) of each anchor, or with ``whole`` (h, c, doc_id, t1, pos) where c is the context's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t1 = batch.column("doc_id").to_pylist(), batch.column("t1").to_pylist()
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, text in enumerate(text_bytes(batch, "text")):
                at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                out[0].append(h.view(np.int64))
                if whole:
                    c = [xxhash.xxh3_64_intdigest(b"%d:" % min(p, length - gram) + text[max(0, p - length + gram) : p + length]) for p in at.tolist()]
                    out[1].append(np.array(c, U).view(np.int64))
                    out[2] += [ids[i]] * len(at)
                    out[3] += [t1[i]] * len(at)
                    out[4].append(at.astype(np.int64))
                size += len(at)
                if size > CHUNK or i == len(ids) - 1:
                    cols = [pa.array(np.concatenate(out[0]))]
                    if whole:
                        cols += [pa.array(np.concatenate(out[1])), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(np.concatenate(out[4]))]
                    yield pa.RecordBatch.from_arrays(cols, ["h", "c", "doc_id", "t1", "pos"][: len(cols)])
                    out, size = [[], [], [], [], []], 0

    return docs.select("doc_id", "t1", "text").mapInArrow(run, "h long, c long, doc_id long, t1 long, pos long" if whole else "h long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, n, big, before, from_on) for each wanted (doc_id, t1, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "n", "big", "before", "from_on"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for text, found in zip(text_bytes(batch, "text"), batch.column("anchors")):
                rows += [(a["h"], a["c"], a["n"], a["big"], *context(text, a["pos"], length, gram)) for a in found.as_py()]
                if len(rows) > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u"))
    joined = docs.select("doc_id", "t1", "text").join(wanted, same).select("text", "anchors")
    return joined.mapInArrow(run, "h long, c long, n long, big boolean, before binary, from_on binary")


def sorted_groups(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, before, after) of the contexts in whole groups, some groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done(table: pa.Table) -> pa.RecordBatch:
            h = table.column("h").to_numpy()
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            before, after = repeated_windows(group, table.column("n").to_numpy(), table.column("before").to_pylist(), table.column("from_on").to_pylist(), length, gram)
            at = np.flatnonzero(after >= 0)
            return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(table.column("c").to_numpy()[at]), pa.array(before[at]), pa.array(after[at])], ["h", "c", "before", "after"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                last = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if last:
                    yield done(table.slice(0, last))
                held = table.slice(last).to_batches()
                rows = len(table) - last
        if rows:
            yield done(pa.Table.from_batches(held))

    parted = found.repartition(shuffle_partitions(found.sparkSession), "h").sortWithinPartitions("h")
    return parted.select("h", "c", "n", "before", "from_on").mapInArrow(run, "h long, c long, before long, after long")


def counted_groups(found: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for groups too large for a task: each window is counted by a 128-bit hash."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows: list[tuple] = []
                for r in batch.slice(lo, 256).to_pylist():
                    text, at = r["before"][::-1] + r["from_on"], len(r["before"])
                    for o in range(min(at, reach) + 1):
                        if len(w := text[at - o : at - o + length]) == length:
                            rows.append((r["h"], r["c"], r["n"], o, xxhash.xxh3_128_digest(w)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "c", "n", "o", "w"])

    windows = found.select("h", "c", "n", "before", "from_on").mapInArrow(run, "h long, c long, n long, o long, w binary")
    same = ["h", "o", "w"]  # a window is counted once for each anchor in it
    twice = windows.groupBy(same).agg(F.sum("n").alias("times")).where("times > 1").select(same)
    hit = windows.join(twice, same).groupBy("h", "c").agg(F.max("o").alias("before"), F.min("o").alias("least"))
    return hit.select("h", "c", "before", (F.lit(length) - F.col("least")).alias("after"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 for every document."""
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("t1", F.xxhash64("text"))
    shared = anchor_rows(docs, length, gram, False).groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    shared = scratch.save(shared.select("h", (F.col("times") > hot).alias("big")), "shared")
    found = scratch.save(anchor_rows(docs, length, gram, True).join(shared, "h"), "found")
    scratch.drop("shared")
    one = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.max("big").alias("big"), F.min(F.struct("doc_id", "t1", "pos")).alias("at"))
    wanted = one.groupBy(F.col("at.doc_id").alias("d"), F.col("at.t1").alias("u")).agg(F.collect_list(F.struct("h", "c", "n", "big", F.col("at.pos").alias("pos"))).alias("anchors"))
    wanted = scratch.save(wanted, "wanted")
    shipped = contexts(docs, wanted, length, gram)
    extents = scratch.save(sorted_groups(shipped.where("NOT big"), length, gram), "extents")
    if not no_big_groups(wanted):
        large = scratch.save(shipped.where("big"), "large")
        extents = extents.union(scratch.save(counted_groups(large, length, gram), "counted"))
    scratch.drop("wanted")
    spans = found.join(extents, ["h", "c"]).groupBy(F.col("doc_id").alias("d"), F.col("t1").alias("u")).agg(
        F.collect_set(F.struct((F.col("pos") - F.col("before")).alias("lo"), (F.col("pos") + F.col("after")).alias("hi"))).alias("spans")
    )
    spans = scratch.save(spans, "spans")
    scratch.drop("found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), batch.column("spans").to_pylist()):
                kept, at, runs, end = [], 0, 0, -1
                for s in sorted(spans or [], key=lambda s: s["lo"]):
                    if s["lo"] > end:
                        kept.append(text[at : s["lo"]])
                        runs, end = runs + 1, s["hi"]
                    end = max(end, s["hi"])
                    at = end
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((doc, len(text), len(text) - len(left), runs, left, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u"))
    joined = docs.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def no_big_groups(wanted: DataFrame) -> bool:
    return wanted.where(F.exists("anchors", lambda a: a["big"])).isEmpty()
