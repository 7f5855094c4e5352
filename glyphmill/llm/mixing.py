"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about equal volume. A source of weight w gets a release time floor(i / w) and a
deadline ceil((i + 1) / w) for its block i, and earliest deadline first fills one slot after another: at any time a
source has had its share of blocks to within less than one block. Weights are taken as exact fractions and never rounded
to slots, so that holds over the whole run. When a source runs out, the weights of the others are scaled up and the
schedule starts anew from there, so every document keeps a place.

The schedule has a row for each block and is made on the cluster, a stretch of slots in a task. Which blocks are done at
a stretch's borders follows from the weights alone: earliest deadline first is followed from longer before the border
than any source waits for its next block, starting with the blocks that are due first. A stretch takes the blocks
between its two borders, those that must be done at its end with that end as their deadline, so stretches fit together
and every block keeps its release and deadline (``tests/llm`` checks both for every slot). The driver holds the
sources, their weights and the borders, and follows the last stretch before a source runs out, of which it keeps one
number for each source. Stretches are at least four times as long as the longest wait between two blocks of a source: a
source of weight w has a task of 4 / w slots or more, so a weight of next to nothing leaves the schedule to one task.
A source with a third of all rows is summed up in many salted chunks.

Rows: a null or empty text has no volume and goes with the block it falls in; a text is never cut, it goes whole with the
block that it begins in, so where texts are longer than blocks the volume (not the number of blocks) is off the target by
as much; a null source is a source of its own; repeated rows each have a place; ``mix`` keeps all columns in a struct
``row``, so names can't clash. An empty table mixes to an empty table. Weights given for sources that have no rows are
left out; sources without a given weight, and weights of zero or less, are an error.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch

#: Least number of slots of a stretch; rows of the schedule in a batch; documents of a chunk, whose volumes are summed up together.
STRETCH, BATCH, CHUNK_ROWS = 200_000, 50_000, 20_000
#: Most tasks that make the schedule.
TASKS = 10_000
#: Deadlines of sources with next to no weight end here, within a long.
FAR = 1 << 62
SCHEDULE = "s_source string, s_block long, slot long, release long, deadline long"


class Phase(NamedTuple):
    """The schedule from one source's end to the next: slots and blocks are counted from 0 behind ``base`` and ``begun``."""

    base: int
    begun: dict
    q: dict
    left: dict
    borders: list


def shares(weights: dict) -> tuple[dict, int]:
    """The weights as whole numbers in exactly their proportion, and their sum."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    q = {s: int(x * whole) for s, x in exact.items()}
    return q, sum(q.values())


def ordered(q: dict) -> list:
    return sorted(q, key=lambda s: (str(s), s is None))


def earliest_deadline(q: dict, done: dict, start: int, stop: int | None = None, until: dict | None = None) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) by the weights ``q`` from the slot ``start`` on, where ``done`` blocks of
    each source are done. With ``until``, just the blocks before it are taken, and all of them are due at ``stop``."""
    total, done, sources = sum(q.values()), dict(done), ordered(q)
    last = math.inf if stop is None else stop
    waiting, ready = [], []  # by release; by deadline

    def wait(i: int) -> None:
        s = sources[i]
        if until is None or done[s] < until[s]:
            heapq.heappush(waiting, (done[s] * total // q[s], i))

    for i in range(len(sources)):
        wait(i)
    for slot in itertools.count(start):
        if slot == stop:
            return
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            deadline = -(-(done[sources[i]] + 1) * total // q[sources[i]])
            heapq.heappush(ready, (deadline if until is None else min(deadline, last), i, release, deadline))
        _, i, release, deadline = heapq.heappop(ready)
        yield sources[i], done[sources[i]], slot, release, deadline
        done[sources[i]] += 1
        wait(i)


def longest_wait(q: dict) -> int:
    """Slots within which every source has a block that is released and due."""
    return -(-sum(q.values()) // min(q.values())) + 2


def done_at(q: dict, slot: int) -> dict:
    """Blocks of each source that are done before ``slot``, a border between stretches."""
    total, begin = sum(q.values()), max(0, slot - longest_wait(q))
    done = {s: begin * w // total for s, w in q.items()}
    # of the blocks that are neither due nor unreleased at ``begin``, those due first are done
    open_ = sorted((-(-(done[s] + 1) * total // q[s]), i, s) for i, s in enumerate(ordered(q)) if begin * q[s] % total)
    for _, _, s in open_[: begin - sum(done.values())]:
        done[s] += 1
    for s, *_ in earliest_deadline(q, done, begin, slot):
        done[s] += 1
    return done


def last_stretch(q: dict, left: dict, start: int) -> Iterator[tuple]:
    """From the border ``start`` up to the end of the first source of ``left`` that runs out."""
    for row in earliest_deadline(q, done_at(q, start), start):
        yield row
        if row[1] + 1 == left[row[0]]:
            return


def phases(blocks: dict, weights: dict) -> Iterator[Phase]:
    """From one source's end to the next; the driver follows the last stretch of each and keeps a number per source."""
    done, base = dict.fromkeys(blocks, 0), 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        q, total = shares({s: weights[s] for s in left})
        first_last = min((n - 1) * total // q[s] for s, n in left.items())  # no source's last block is released earlier
        length = max(STRETCH, 4 * longest_wait(q))
        borders = list(range(0, first_last + 1, length))
        yield Phase(base, {s: done[s] for s in left}, q, left, borders)
        for s, n in done_at(q, borders[-1]).items():
            done[s] += n
        base += borders[-1]
        for s, *_ in last_stretch(q, left, borders[-1]):
            done[s] += 1
            base += 1


def stretch(phase: Phase, k: int) -> Iterator[tuple]:
    """The rows of the schedule from the phase's border ``k`` to the next."""
    start = phase.borders[k]
    if k + 1 < len(phase.borders):
        stop = phase.borders[k + 1]
        rows = earliest_deadline(phase.q, done_at(phase.q, start), start, stop, done_at(phase.q, stop))
    else:
        rows = last_stretch(phase.q, phase.left, start)
    for s, i, slot, release, deadline in rows:
        yield s, phase.begun[s] + i, phase.base + slot, phase.base + release, min(phase.base + deadline, FAR)


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) of every block, slot by slot, for few blocks."""
    for phase in phases(blocks, weights):
        for k in range(len(phase.borders)):
            yield from stretch(phase, k)


def stored_schedule(scratch: Scratch, blocks: dict, weights: dict) -> DataFrame:
    """The schedule as a table SCHEDULE, each stretch made by a task."""
    every = list(phases(blocks, weights))
    kinds = pa.schema([("s_source", pa.string()), *((c, pa.int64()) for c in ("s_block", "slot", "release", "deadline"))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = stretch(every[p], k)
                while some := list(itertools.islice(made, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kinds)], schema=kinds)

    each = [(p, k) for p, phase in enumerate(every) for k in range(len(phase.borders))]
    # an Arrow table, as rows in a list would start further workers
    tasks = pa.table({c: pa.array([x[i] for x in each], pa.int64()) for i, c in enumerate(("phase", "border"))})
    tasks = scratch.spark.createDataFrame(tasks).repartition(min(max(len(each), 1), TASKS))
    return scratch.save(tasks.mapInArrow(rows, SCHEDULE), "schedule")


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_chars: int = 50_000, carry: list[str] | None = None) -> DataFrame:
    """``docs`` as ``row`` with source, block, slot, release, deadline and start: sort by (slot, start) to read the mixture.

    weights: target share by source; else the volumes to the power ``temperature``. carry: columns that ``row`` is to
    have, with doc_id among them, else all; texts that aren't carried are in no shuffle.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.col("source").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), source.alias("source"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.xxhash64("doc_id", source, "text").alias("hash"),
    )
    # chunks come from the documents alone, and their number from the corpus's size
    chunks = max(64, docs.count() // CHUNK_ROWS)
    rows = rows.withColumn("chunk", F.pmod(F.col("hash"), F.lit(chunks)))
    sums = scratch.save(rows.groupBy("source", "chunk").agg(F.sum("chars").alias("volume")), "chunks")
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch.save(sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("volume").over(before), F.lit(0)).alias("first")), "firsts")
    within = Window.partitionBy("source", "chunk").orderBy("hash", "row.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    rows = rows.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).drop("s", "c")
    rows = rows.withColumn("start", F.col("start") + F.col("first")).withColumn("block", F.floor(F.col("start") / block_chars))

    volumes = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("volume")).collect()}  # a row per source
    if weights is None:
        weights = {s: max(1, v) ** temperature for s, v in volumes.items()}
    if wrong := [s for s in volumes if not weights.get(s, 0) > 0]:
        raise ValueError(f"sources without a positive weight: {wrong[:5]}")
    planned = stored_schedule(scratch, {s: v // block_chars + 1 for s, v in volumes.items()}, weights)
    rows = rows.join(planned, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    return rows.select("row", "source", "block", "slot", "release", "deadline", "start")
