"""Personal data: base entities by pattern, further identifiers by bootstrapped contextual extraction.

1. ``scan`` finds the base entities (email, ip, card, phone), credentials after a telling word, and candidates: other
   tokens with digits, of any length, where those with one space between them are one (an identifier without a digit is
   none). Each comes with its lexical pattern: the two words before it, and
   with them the word that punctuation before it belongs to.
2. Base entities and credentials are the seeds. Spark scores the graph of patterns and instances round by round: a
   pattern is as good as the share of its distinct instances that are trusted, an instance as good as the patterns it
   is found in.
3. Candidates behind a high-confidence pattern are identifiers that no base pattern saw.

All texts are read whole, in time linear in their length. Spans count code points, the end is exclusive.

Rows: a null or empty text has no spans; repeated rows and ids are scanned each; other columns are not read. An empty
table gives an empty table. Without seeds no pattern is trusted and only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match can't begin inside a run of digits: the run's start would have matched, or failed the same way
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9_/+-]{16,})")
SPACE = re.compile(r"\s")
#: Characters that a candidate is freed from at its ends.
EDGES = "\"'`.,;:!?()[]{}<>*#$%&="
TRUSTED, SUPPORT, REACH = 0.7, 5, 3
BROADCAST_ROWS = 200_000
SPAN = "array<struct<from:int,to:int,kind:string,pattern:string,instance:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, looked for from each @, so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        reach = 64
        while True:
            lo = max(last, at - reach)
            start = lo + len(text[lo:at].rstrip(LOCAL))
            if start > lo or lo == last:
                break
            reach *= 4
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def short(text: str) -> str:
    """The text, or its hash where it is long: a name for it."""
    return text if len(text) <= 64 else hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def pattern_before(text: str, start: int) -> str:
    """The two words before, lower-cased, with digits made alike; empty where they hold no letter.

    Words without a letter are punctuation, which stands behind anything: up to REACH of them come on top, back to a word that
    has one.
    """
    reach = 32
    while True:
        before = text[max(0, start - reach) : start]
        words = before.rsplit(None, REACH + 2)
        if reach >= start or len(words) == REACH + 3:
            break
        reach *= 4
    for k in range(2, REACH + 3):
        last = " ".join(words[-k:])
        if any(c.isalpha() for c in last):
            return short(" ".join(DIGIT.sub("0", last.lower()).split()))
    return ""


def tokens_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """White-space tokens that hold a digit, without the characters EDGES at their ends."""
    done = 0
    for m in DIGIT.finditer(text):
        if m.start() < done:
            continue
        before = text[done : m.start()]
        a = m.start() - (0 if not before or before[-1].isspace() else len(before.rsplit(None, 1)[-1]))
        end = SPACE.search(text, m.end())
        b = done = end.start() if end else len(text)
        word = text[a:b]
        yield a + len(word) - len(word.lstrip(EDGES)), b - len(word) + len(word.rstrip(EDGES))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and further ones: credentials ("secret") and candidates (""), which overlap no other."""
    base = base_spans(text)

    def union(spans: list[tuple[int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def free(spans: Iterator[tuple[int, int]], taken: list[list[int]]) -> Iterator[tuple[int, int]]:
        """Of spans in order those that touch nothing in ``taken``."""
        k = 0
        for a, b in spans:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or b <= taken[k][0]:
                yield a, b

    taken = union([(a, b) for _, a, b in base])
    secrets = list(free((m.span(1) for m in SECRET.finditer(text)), taken))
    runs: list[list[int]] = []
    for a, b in free(tokens_with_digits(text), union([*map(tuple, taken), *secrets])):
        # groups with one space between them are one identifier
        if runs and a == runs[-1][1] + 1 and text[a - 1] == " " and text[a - 2].isalnum() and text[a].isalnum():
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return base, [*(("secret", a, b) for a, b in secrets), *(("", a, b) for a, b in runs)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.get(s[0], 9), s[1])))


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document with base counts, digest, spans, and ``found``: its seeds and candidates with their patterns."""
    small_batches(docs.sparkSession)
    schema = f"doc_id long, hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found {SPAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.string())]))
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), kind]
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                base, more = scan(text)
                line = listed(base)
                n = [sum(k == s[0] for s in base) for k in KINDS]
                found = [{"from": a, "to": b, "kind": k, "pattern": pattern_before(text, a), "instance": short(text[a:b].lower())} for k, a, b in [*base, *more]]
                rows.append((doc, key, *n, hashlib.sha256(line.encode()).hexdigest(), line, found))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in schema.split(", ", 8)])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), F.col("text").cast("string")).mapInArrow(run, schema)


def trusted_patterns(found: DataFrame, scratch: Scratch, trusted: float = TRUSTED, support: int = SUPPORT) -> DataFrame:
    """Patterns of high confidence from found(kind, pattern, instance).

    The graph has an edge per distinct (pattern, instance), counted before it is shuffled again. In each round a pattern's
    confidence is the trust in its instances by their number, and an instance that is no seed is trusted as much as
    its best pattern that has support. Confidences only rise; the rounds end when they have settled.
    """
    edges = found.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max((F.col("kind") != "").cast("double")).alias("seed"))
    edges = scratch.save(edges, "edges")  # one row a pair: a text in a third of all documents weighs no more than others
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("trust"))
    scores = scratch.save(seeds, "trust0")
    i, before = 0, None
    while True:
        i += 1
        known = edges.join(scores, "instance").groupBy("pattern").agg(
            (F.sum("trust") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("trust") > 0.5).cast("long")).alias("support")
        )
        good = known.where((F.col("support") >= support) & (F.col("confidence") >= trusted))
        good = scratch.save(good, f"patterns{i}")
        now = good.agg(F.count("*"), F.round(F.sum("confidence"), 6)).first()
        if now == before or not now[0]:
            return good.select("pattern")
        before = now
        new = edges.join(F.broadcast(good) if now[0] <= BROADCAST_ROWS else good, "pattern", "left").groupBy("instance").agg(F.greatest(F.max("seed"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("trust"))
        scores = scratch.save(new, f"trust{i}")


def further_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, hash, from, to, kind) of credentials, and of candidates behind trusted patterns."""
    found = rows.select("doc_id", "hash", F.explode("found").alias("f")).select("doc_id", "hash", "f.*")
    good = trusted_patterns(found, scratch)
    n = good.count()
    candidates = found.where("kind = ''")
    behind = candidates.join(F.broadcast(good) if n <= BROADCAST_ROWS else good, "pattern", "left_semi")
    secrets = found.where("kind = 'secret'")
    return secrets.unionByName(behind.withColumn("kind", F.lit("id"))).select("doc_id", "hash", "from", "to", "kind").distinct()


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    scratch = Scratch(documents.sparkSession, "personal-data")
    rows = scratch.save(scanned(documents), "scanned")
    each = further_spans(rows, scratch)
    each = each.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("kind", "from", "to"))).alias("s"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")
    each = each.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), text.alias("further"))
    rows = rows.join(each, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "further").alias("spans")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans)


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all other columns stay."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "redaction")
    rows = scratch.save(scanned(documents).select("doc_id", "hash", "found").where(F.size("found") > 0), "scanned")
    each = scratch.save(further_spans(rows, scratch).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("kind", "from", "to")).alias("further")), "further")

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, further in batches:
            out = []
            for t, more in zip(texts, further):
                spans = base_spans(t or "") + ([(s["kind"], s["from"], s["to"]) for s in more] if more is not None else [])
                if spans:
                    parts, at = [], 0
                    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if b > at:
                            parts += [t[at:a], f"<{kind.upper()}>"] if a >= at else []
                            at = b
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pd.Series(out, dtype=object)

    n = each.count()
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    key = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(f"row.{text}") == F.col("hash"))
    joined = rows.join(F.broadcast(each) if n <= BROADCAST_ROWS else each, key, "left")
    return joined.select(F.col("row").withField(text, replaced(F.col(f"row.{text}"), F.col("further"))).alias("row")).select("row.*")
