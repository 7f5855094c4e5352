"""Periodic runs of words: stretches that repeat with a period at least four times, and texts without the repetitions.

Karp, Miller and Rosenberg's naming: at level ``k`` two stretches of 2^k words of one text have the same name if and only
if they are equal. The names of a level come from pairs of names of the level below, sorted by NumPy; a stretch that is
alone in its text gets a name of its own and is never looked at again, so prose costs two or three levels, and no hash and
no suffix order is needed. How far two places agree, to the right or to the left, is read off by going down the levels.

A run of period q and length 4 q at least agrees with itself q words on over 3 q words, so one place of a grid of 3 q words
lies inside. All places of all grids are tried, n / (3 q) for a period, and extended both ways; the smallest period
that gives a stretch is its own.

Texts of a batch are named together, which takes no more than all their words; nothing is shuffled. The longest text has to
fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches

#: A run has four periods and six words at least.
PERIODS, WORDS = 4, 6
#: Places of grids that are tried at once: bounds memory, changes no result.
TRIED = 1 << 19
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SPACE = r"[ \x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of other characters than a space and the five control characters from tab to carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_made_runs(docs: DataFrame) -> DataFrame:
    """The table with a tenth of its texts made periodic: which and how the crc32 of the document's id decides.

    A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.when(F.pmod(h, F.lit(10)) == 0, words(F.col("text")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    at = docs.select(row, w.alias("w"), F.floor(h / 10).cast("long").alias("g"))
    w, g = F.col("w"), F.col("g")
    n = F.size(w)
    a = F.pmod(g, n.cast("long")).cast("int")
    p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(repeated, F.lit(1), n - a)), " ")
    text = F.when(n > 0, made).otherwise(F.col("row.text")).alias("text")
    return at.select(*(text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def names_of(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names by level of the stretches that begin at each word: equal for equal stretches of one text, and for no others.

    A stretch that goes beyond its text, and one that is alone, has a negative name that nothing else has.
    """
    n = len(codes)
    alone = -1 - np.arange(n)
    end = np.searchsorted(doc, doc, "right")

    def named(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Names of the places ``at`` by pairs; those that only one place has are dropped."""
        out = alone.copy()
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        out[at[order[many]]] = group[many]
        return out

    levels = [named(np.arange(n), doc.astype(np.int64), codes.astype(np.int64))] if n else [alone]
    step = 1
    while True:
        last = levels[-1]
        at = np.flatnonzero(last >= 0)
        at = at[at + 2 * step <= end[at]]
        at = at[last[at + step] >= 0]
        if not len(at):
            return levels
        found = named(at, last[at], last[at + step])
        if not (found >= 0).any():
            return levels
        levels.append(found)
        step *= 2


def agreement(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
    """How many words from ``i`` on equal those from ``j`` on; to the left, the words before them."""
    total, n = np.zeros(len(i), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        a, b = (i - total - step, j - total - step) if left else (i + total, j + total)
        inside = (a >= 0) if left else (b < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        total += step * same
    return total


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text and start, from the words' codes of texts of ``sizes`` words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    levels = names_of(codes, doc)
    most = sizes // PERIODS
    of = np.repeat(np.arange(len(sizes)), most)  # a text for each period that it can have
    period = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = -(-(sizes[of] - period) // (3 * period))
    ends = np.cumsum(places)
    found = []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, TRIED):
        c = np.arange(lo, min(lo + TRIED, int(ends[-1])))
        k = np.searchsorted(ends, c, "right")
        q = period[k]
        i = begins[of[k]] + (c - (ends[k] - places[k])) * 3 * q
        hit = np.flatnonzero((levels[0][i] >= 0) & (levels[0][i] == levels[0][i + q]))
        if not len(hit):
            continue
        i, q, t = i[hit], q[hit], of[k[hit]]
        before = agreement(levels, i, i + q, left=True)
        length = before + q + agreement(levels, i, i + q)
        long = length >= np.maximum(WORDS, PERIODS * q)
        found.append(np.stack([t, i - before - begins[t], length, q])[:, long])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    t, s, length, q = np.concatenate(found, 1)
    order = np.lexsort((q, length, s, t))
    t, s, length, q = t[order], s[order], length[order], q[order]
    first = np.ones(len(t), bool)  # of one stretch the smallest period
    first[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (length[1:] != length[:-1])
    return t[first], s[first], length[first], q[first]


def _found(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Numbers of words, runs, and texts without the repetitions of a batch of texts."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    here = pc.greater(pc.binary_length(flat), 0)  # none before a leading space or behind a trailing one
    parents = pc.list_parent_indices(split).filter(here).to_numpy()
    flat = flat.filter(here)
    sizes = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    t, s, length, q = runs_of(codes, sizes)
    begins = np.cumsum(sizes) - sizes
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, begins[t] + s + q, 1)
    np.add.at(depth, begins[t] + s + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    left = np.bincount(parents[kept], minlength=len(texts))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)).astype(np.int32)), flat.filter(pa.array(kept)))
    records = pa.StructArray.from_arrays([pa.array(s), pa.array(length), pa.array(q)], ["start", "length", "period"])
    counts = np.append(0, np.cumsum(np.bincount(t, minlength=len(texts)))).astype(np.int32)
    return pa.array(sizes), pa.ListArray.from_arrays(pa.array(counts), records), pc.binary_join(lists, " ")


def find_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id and other columns to ``keep``, n_words, runs, collapsed) of every text.

    ``runs`` are structs of start, length and period in words, by start, then period. ``collapsed`` are the words that no
    run holds after its first period, joined by one space.

    Rows: a null text counts as empty; an empty one has no word, no run and an empty ``collapsed``. Nulls in other columns,
    equal ids and equal rows stay as they are, a row for each. Other columns than ``doc_id`` and ``text`` are not read.
    A text of any length is searched whole; runs of one text may overlap, and all are given.
    """
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, collapsed = _found(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), n, runs, collapsed], [*keep, "n_words", "runs", "collapsed"])

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_words bigint, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each text, and digests of all its runs and of what is left of it."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    b = found.withColumn("best", best)
    return b.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
