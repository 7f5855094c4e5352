"""Reply trees to training conversations.

Messages (thread, id, parent, score, role, text) form trees. Ancestors are found by repeated self-joins that double
their reach, so a path of n messages takes log2(n) joins. Leaves are ranked within their thread by the score summed
from root to leaf, and each chosen path is formatted as one conversation, with a mask of the spans to learn from.

The template puts "### role:" before and "</turn>" behind a turn. Inside texts and roles the backslash and those control
strings are escaped, and ``unescape`` undoes it exactly.

Rows: a null text or role is empty; a null thread is a thread of its own; a parent that is not there makes a root;
messages on or below a cycle have no root and give no path; equal scores go to the longer path, then the smaller leaf
id. Several rows of one (thread, id) are one message, the least by parent, score, role and text. ``linear`` orders equal
turns by role and text, and equal rows are messages each. Other columns are not read. An empty table gives an empty
table. A path is one row of the result, so the longest conversation has to fit a task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch
from glyphmill.sources.catalog import with_row_ids

#: (text, escaped); the backslash is first when escaping and last when undoing it
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
END = "\n</turn>\n"


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def linear(rows: DataFrame) -> DataFrame:
    """Messages from (conv_id, turn, role, text): each replies to the row before it.

    Ids run through the whole sorted table, so that no thread's rows have to meet in one task.
    """
    rows = rows.select(F.col("conv_id").alias("thread"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_row_ids(rows.withColumn("order", F.struct("thread", "turn", "role", "text")), "order", "id").drop("order")
    firsts = rows.groupBy(F.col("thread").alias("t")).agg(F.min("id").alias("first"))
    rows = rows.join(firsts, F.col("thread").eqNullSafe(F.col("t")))
    return rows.select("thread", "id", F.when(F.col("id") > F.col("first"), F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def once(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """One message of each (key, id): of unlike ones the least by parent, score, role and text."""
    many = scratch.save(nodes.groupBy("key", "id").count().where("count > 1").select("key", "id"), "repeated")
    if many.isEmpty():
        return nodes
    rest = ("parent", "score", "role", "text")
    single = nodes.groupBy("key", "id").agg(F.first("thread").alias("thread"), F.min(F.struct(*rest)).alias("m"))
    return scratch.save(single.select("key", "thread", "id", *(f"m.{c}" for c in rest)), "once")


def best_paths(messages: DataFrame, top: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """(thread, leaf, rank, pos, role, text): the messages on the ``top`` best root-to-leaf paths of each thread."""
    scratch = scratch or Scratch(messages.sparkSession, "chat")
    # a null thread gets a key that no other one has
    key = F.coalesce(F.concat(F.lit("t"), F.col("thread").cast("string")), F.lit("null")).alias("key")
    nodes = scratch.save(messages.select(key, "thread", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "nodes")
    nodes = once(nodes, scratch)
    ids = nodes.select("key", F.col("id").alias("parent"), F.lit(True).alias("there"))
    # only ids and sums travel from here on
    step = nodes.select("key", "id", "parent", "score").join(ids, ["key", "parent"], "left")
    step = step.select("key", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    step = scratch.save(step, "up0")
    steps, ended = [step.where("up IS NOT NULL")], [step.where("up IS NULL")]  # steps[k]: ancestors at 2^k, where there is one
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    while len(steps) <= rounds and not steps[-1].isEmpty():  # only messages that haven't reached their root go on
        known = reduce(DataFrame.union, ended, steps[-1])
        far = known.select("key", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        step = steps[-1].join(far, ["key", "up"]).select(
            "key", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")
        )
        step = scratch.save(step, f"up{len(steps)}")
        steps.append(step.where("up IS NOT NULL"))
        ended.append(step.where("up IS NULL"))
    # what never ended hangs on a cycle
    whole = reduce(DataFrame.union, ended).select("key", "id", "total", "depth")
    parents = steps[0].select("key", F.col("up").alias("id")).distinct()
    order = Window.partitionBy("key").orderBy(F.desc("total"), F.desc("depth"), "id")
    chosen = whole.join(parents, ["key", "id"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    path = chosen.select("key", F.col("id").alias("leaf"), "rank", "id")
    path = scratch.save(path, "chosen")
    for k, step in reversed(list(enumerate(steps[:-1]))):  # ancestors at 2^k, each distance exactly once
        up = step.select("key", "id", "up")
        path = scratch.save(path.union(path.join(up, ["key", "id"]).select("key", "leaf", "rank", F.col("up").alias("id"))), f"path{k}")
    path = path.join(whole.select("key", "id", F.col("depth").alias("pos")), ["key", "id"])
    return path.join(nodes, ["key", "id"]).select("key", "thread", "leaf", "rank", "pos", "role", "text")


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """(thread, leaf, formatted, mask): mask lists the character spans [from, to) of the texts to learn from."""
    turns = paths.groupBy("key", "leaf").agg(F.first("thread").alias("thread"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escape(t["role"], ROLE_ESCAPES), F.lit(":\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    turns = turns.select("thread", "leaf", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def add(so_far: Column, part: Column) -> Column:
        body = so_far["at"] + F.length(part["head"])
        end = body + F.length(part["body"])
        span = F.array(F.struct(body.alias("from"), end.alias("to")))
        return F.struct((end + len(END)).alias("at"), F.when(part["learn"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return turns.select("thread", "leaf", formatted.alias("formatted"), F.aggregate("parts", start, add)["spans"].alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(thread, leaf, turns array<struct<role, text>>, learned array<string>) from the formatted text and its mask."""
    parts = F.split("formatted", END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    head = lambda p: F.position(F.lit(":\n"), p)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring(p, F.lit(5), head(p) - 5), ROLE_ESCAPES).alias("role"), unescape(F.substring(p, head(p) + 2, F.length(p))).alias("text")))
    learned = F.transform("mask", lambda m: unescape(F.substring("formatted", m["from"] + 1, m["to"] - m["from"])))
    return formatted.select("thread", "leaf", "formatted", turns.alias("turns"), learned.alias("learned"))
