"""Groups of spelling variants: all pairs of words one edit apart, found by merging an errata trie.

The words' trie is cut into heavy paths: of a node's children the one with most words below is heavy, the others are light.
Each light subtree is merged with its neighbourhood under one error, which always costs the smaller side: it is copied to
the heavy child with its first character *replaced* by the heavy one, to its parent with that character *skipped*, and
below the heavy child with the heavy character *inserted* before it, which is the heavy child's skip seen from the light
side. A word lies in at most log2 V light subtrees, so it is copied at most 3 log2 V + 1 times, and every pair of words one
edit apart ends at the same terminal exactly once: a pair parts at the node of its longest common prefix, where one of the
two goes on in a light subtree. Terminals that coincide are found by one equi-join of copies with words.

The trie is not built in one place. Words are sorted in ranges, and within a range its branching nodes are the intervals of
the longest common prefixes of neighbours. A node that crosses from one range to the next is a prefix of the words on both
sides of that border; its children's words are counted over all ranges, and all ranges use the same heavy child.

Partners at one terminal are bounded: words that differ in one given place are at most as many as the alphabet has
characters, and those that a terminal meets at most twice its length times as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, shuffle_partitions

#: A word has so many code points and occurrences at least; a form is so many times as frequent.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: Occurrences whose hash this number divides have a letter taken out.
SPOILT = 199
#: Words of a range.
RANGE = 50_000
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands for a word's end among a node's children; sorts before every letter.
END = ""
REPLACED, MOVED = 0, 1


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, word) for every maximal run of letters of every text, A-Z as a-z."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.split(low, f"[^{LETTERS}]+")).alias("word")).where("word <> ''")


def spoilt(found: DataFrame) -> DataFrame:
    """One occurrence in SPOILT loses the code point that its hash points to; with a null id, none does."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary"))
    at = F.pmod(F.col("h"), F.length("word").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    word = F.when(F.pmod(F.col("h"), F.lit(SPOILT)) == 0, cut).otherwise(F.col("word"))
    return found.withColumn("h", h).select("doc_id", word.alias("word"))


def counted(found: DataFrame, length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return found.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def child(word: str, depth: int) -> str:
    return word[depth] if len(word) > depth else END


def children(words: list[str], lo: int, hi: int, depth: int) -> list[tuple[int, int, str]]:
    """(begin, end, character) of the children of the node that words[lo:hi], which are sorted, share up to ``depth``."""
    out, begin = [], lo
    while begin < hi:
        c = child(words[begin], depth)
        a, b = begin, hi  # words[a] goes on with c, words[b] does not
        while b - a > 1:
            mid = (a + b) // 2
            if child(words[mid], depth) == c:
                a = mid
            else:
                b = mid
        out.append((begin, b, c))
        begin = b
    return out


def nodes(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(depth, begin, end) of the branching nodes of sorted, distinct words: intervals of common prefixes of neighbours."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(words) + 1):
        depth = common_prefix(words[i - 1], words[i]) if i < len(words) else -1
        begin = i - 1
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            yield d, begin, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def crossing(words: list[str], before: str | None, after: str | None) -> dict[str, tuple[int, int]]:
    """Nodes of a range that also have words in the range ``before`` (its last word) or ``after`` (its first), with their intervals here."""
    out: dict[str, tuple[int, int]] = {}
    n = len(words)
    for other, at in ((before, 0), (after, n - 1)):
        if other is None:
            continue
        for depth in range(common_prefix(other, words[at]) + 1):
            u = words[at][:depth]
            if u in out:
                continue
            a, b = at, at  # all words between share u
            lo, hi = -1, at
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if words[mid][:depth] == u:
                    hi = mid
                else:
                    lo = mid
            a = hi
            lo, hi = at, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if words[mid][:depth] == u:
                    lo = mid
                else:
                    hi = mid
            b = hi
            out[u] = (a, b)
    return out


def copies(words: list[str], heavy: dict[str, str], shared: dict[str, tuple[int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """(terminal, kind, depth, index of the word) of all copies of light subtrees of one range.

    ``shared`` are the nodes that cross to other ranges, ``heavy`` their heavy children; a node without one has one child.
    """

    def merged(depth: int, parts: list[tuple[int, int, str]], h: str) -> Iterator[tuple[str, int, int, int]]:
        for lo, hi, c in parts:
            if c == h:
                continue
            for i in range(lo, hi):
                w = words[i]
                if h != END:
                    yield w[:depth] + h + w[depth:], MOVED, depth, i  # below the heavy child
                if c != END:
                    if h != END:
                        yield w[:depth] + h + w[depth + 1 :], REPLACED, depth, i  # to the heavy child
                    if child(w, depth + 1) != c:
                        yield w[:depth] + w[depth + 1 :], MOVED, depth, i  # to the parent

    for u, (lo, hi) in shared.items():
        if u in heavy:
            yield from merged(len(u), children(words, lo, hi, len(u)), heavy[u])
    for depth, lo, hi in nodes(words):
        if words[lo][:depth] not in shared:
            parts = children(words, lo, hi, depth)
            # an end is never heavy: it has one word, and the others have one at least
            h = max((p for p in parts if p[2] != END), key=lambda p: (p[1] - p[0], p[2]))[2]
            yield from merged(depth, parts, h)


def ranges(scratch: Scratch, words: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The words (word, n, part) stored by sorted ranges, and a row for each range: part, its first and last word and its neighbours'."""
    spark = words.sparkSession
    words = scratch.save(words, "words")
    parts = max(1, -(-words.count() // size))
    by_range = words.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id())
    stored = scratch.save(by_range, "ranges")
    order = Window.orderBy("part")  # a row for each range
    ends = stored.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    ends = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    return stored, scratch.save(ends, "borders")


def errata(scratch: Scratch, words: DataFrame, size: int = RANGE) -> DataFrame:
    """(terminal, kind, depth, word, n): each word's copies in the merged trie of ``words`` (word, n), which are distinct."""
    stored, borders = ranges(scratch, words, size)
    limits = {r.part: (r.before, r.after) for r in borders.toLocalIterator()}  # two words a range

    def sorted_words(table: pa.Table) -> tuple[int, list[str], np.ndarray]:
        table = table.sort_by("word")
        return table.column("part")[0].as_py(), table.column("word").to_pylist(), table.column("n").to_numpy()

    def sizes(table: pa.Table) -> pa.Table:
        part, w, _ = sorted_words(table)
        rows = [(u, c, b - a) for u, (lo, hi) in crossing(w, *limits[part]).items() for a, b, c in children(w, lo, hi, len(u))]
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("node", pa.string()), ("child", pa.string()), ("size", pa.int64())))})

    by_part = stored.groupBy("part")
    heavy: dict[str, str] = {}
    if len(limits) > 1:
        whole = by_part.applyInArrow(sizes, "node string, child string, size long").groupBy("node", "child").agg(F.sum("size").alias("size"))
        largest = whole.groupBy("node").agg(F.max_by("child", F.struct(F.col("child") != END, "size", "child")).alias("heavy"), F.count("*").alias("children"))
        # at most a border's common prefix each
        heavy = {r.node: r.heavy for r in largest.where("children > 1").toLocalIterator()}

    def merge(table: pa.Table) -> pa.Table:
        part, w, n = sorted_words(table)
        terminal, kind, depth, at = [], [], [], []
        for t, k, d, i in copies(w, heavy, crossing(w, *limits[part])):
            terminal.append(t)
            kind.append(k)
            depth.append(d)
            at.append(i)
        at = np.array(at, np.int64)
        return pa.table({"terminal": pa.array(terminal, pa.string()), "kind": pa.array(kind, pa.int32()), "depth": pa.array(depth, pa.int32()), "word": pa.array(w, pa.string()).take(pa.array(at)), "n": pa.array(n[at], pa.int64())})

    return by_part.applyInArrow(merge, "terminal string, kind int, depth int, word string, n long")


def _best(n: Column, word: Column) -> Column:
    """Sorts first for the largest n, then the smallest word."""
    return F.struct((-n).alias("n"), word.alias("word"))


def near_words(scratch: Scratch, words: DataFrame, size: int = RANGE) -> DataFrame:
    """(word, n_near, best) of every word of ``words`` (word, n) that has a near one: how many, and the most frequent.

    Near means one code point inserted, deleted or replaced. ``best`` is a struct of minus n and the word. No pair is
    written out within a group of words that differ in one place: its first and second word are all that the others need.
    """
    words = words.select("word", "n")
    copies_ = scratch.save(errata(scratch, words, size), "errata")
    met = copies_.join(words.select(F.col("word").alias("terminal"), F.col("n").alias("terminal_n")), "terminal", "left")
    # a copy that lost or won a character meets a word: both are near
    moved = met.where((F.col("kind") == MOVED) & F.col("terminal_n").isNotNull()).select(
        F.explode(F.array(
            F.struct("word", _best(F.col("terminal_n"), F.col("terminal")).alias("best")), F.struct(F.col("terminal").alias("word"), _best(F.col("n"), F.col("word")).alias("best"))
        )).alias("r")
    ).select("r.word", F.lit(1).cast("long").alias("n_near"), "r.best")
    # copies with the same place replaced meet each other and the heavy word: at most as many as the alphabet has letters
    light = met.where(F.col("kind") == REPLACED).groupBy("terminal", "depth").agg(F.collect_list(_best(F.col("n"), F.col("word"))).alias("light"), F.max("terminal_n").alias("terminal_n"))
    heavy = F.when(F.col("terminal_n").isNotNull(), F.array(_best(F.col("terminal_n"), F.col("terminal")))).otherwise(F.slice("light", 1, 0))
    group = light.select(F.array_sort(F.concat("light", heavy)).alias("g")).where(F.size("g") > 1)
    each = group.select("g", F.posexplode("g").alias("at", "one"))
    replaced = each.select("one.word", (F.size("g") - 1).cast("long").alias("n_near"), F.get("g", F.when(F.col("at") == 0, 1).otherwise(0)).alias("best"))
    return moved.union(replaced).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, spoil: bool = False, size: int = RANGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts with LENGTH code points and OCCURRENCES at least.

    A word's form is its most frequent near word (ties: the smallest) if that is TIMES as frequent at least, and its root is
    where the forms lead. Frequencies rise fivefold with each form, so the rounds are few: at most the logarithm to base
    TIMES of the largest count. A round joins words with the words whose form they are, which are bounded in number.

    Rows: a null or empty text has no words, a null id counts like any other (nothing is spoilt), equal rows and ids count
    each; of a text of any length all words count. Without texts there is no row. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    found = occurrences(docs)
    words = scratch.save(counted(spoilt(found) if spoil else found), "counted")
    near = near_words(scratch, words, size)
    row = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))
    has = F.col("near_n") >= TIMES * F.col("n")
    row = row.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    row = scratch.save(row, "forms")
    last, rounds = row.where("form IS NULL").withColumn("root", F.col("word")), []
    led = row.where("form IS NOT NULL")
    while True:
        rounds.append(last)
        last = scratch.save(led.join(last.select(F.col("word").alias("form"), "root"), "form").select(*row.columns, "root"), f"round{len(rounds)}")
        if last.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out
