"""Toxicity by a weighted pattern grammar of finite-state transducers that score clauses, not words.

A lexical transducer reads tokens: stems and whole words that labelled texts show to be toxic become insults with a weight,
fixed words become targets, negations, reporting verbs, announcements and violence, quotation marks become quotes. Over
these symbols four small transducers are composed:

- ``threat``: violence behind an announcement ("will hurt") is a threat; bare violence is kept as such,
- ``negation``: an insult or threat within three tokens behind a negation is negated,
- ``report``: behind a reporting verb, or inside quotation marks, it is reported,
- ``target``: whether somebody is addressed before it, and, read from the right, behind it.

A clause's matches end in 16 tags: insult or threat, plain or negated, plain or reported, aimed or not. What a tag is worth is
fitted by logistic regression on the labelled rows, from fixed starting values that hold where no row shows otherwise: a
negated or reported insult counts little until labels say so.

Labels are learned in three steps on the cluster: texts with toxic labels are counted by stem and word, those that are
frequent there are counted in the other texts, and Newton's steps sum up gradients. A training row's own contribution
is taken out of the counts before its features are made, so that the fit isn't misled by words that only it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, small_batches

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:…\n\"“”„«»]")
# fixed values: words of the grammar in English, German, French and Spanish
INSULTS = "idiot moron loser scum trash stupid worthless pathetic disgusting clown dumb fool jerk bastard depp trottel dummkopf abschaum versager crétin imbécile connard ordure abruti imbécil estúpido basura escoria".split()
VIOLENCE = "kill hurt beat stab shoot burn destroy murder töten schlagen umbringen verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split()
ANNOUNCED = "will gonna going shall should must werde wirst soll vais vas doit voy vas debe".split()
TARGETS = "you your yourself he she they them him her people du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn aren wasn don doesn nicht kein keine nie pas jamais nunca ni".split()
REPORTS = "said says say called calls wrote claimed reported quoted sagte sagt nannte schrieb behauptete dit disait appelait écrit dijo dice llamó escribió".split()
BOUNDARIES, QUOTES = ".!?;:…\n", "\"“”„«»"

#: What an insult or an act of violence of the lists weighs before labels are seen.
SEED = 2.0
#: Lengths of stems, in characters.
STEMS = range(3, 9)
#: A stem or word is counted if this share of the toxic texts has it, and FEWEST texts at least. A text has a bounded number of them, so they are bounded by a text's mean number over SHARE.
SHARE, FEWEST = 0.005, 5
#: The lower bound of the logarithm of the odds from which on a stem or word is an insult, and its width in standard errors.
LEAST, ERRORS = 1.5, 1.0
#: Labels that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
RIDGE, STEPS, SCOPE, NEAR = 1.0, 25, 3, 4

OTHER, BOUNDARY, QUOTE, TARGET, NEGATION, REPORT, ANNOUNCE, HARM, INSULT = "o.qtnrmvi"
THREAT = "h"
TAGS = [k + n + r + t for k in (INSULT, THREAT) for n in ("", "-") for r in ("", "~") for t in ("", "@")]
#: Starting values: of a bias, the largest weight, the density, then of the tags.
START = np.array([-4.0, 0.5, 0.3] + [0.8 * (0.1 if "-" in t else 1.0) * (0.15 if "~" in t else 1.0) * (1.25 if "@" in t else 1.0) for t in TAGS])


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: from a state and a symbol to the next state and what is written."""

    start: tuple
    step: Callable[[tuple, str], tuple[tuple, str]]

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def step(state: tuple, symbol: str) -> tuple[tuple, str]:
            mine, written = self.step(state[0], symbol)
            theirs, out = other.step(state[1], written)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)

    def compiled(self) -> Transducer:
        """The same with its arcs in a table, filled as they are met: the states are few."""
        arcs: dict[tuple, tuple[tuple, str]] = {}
        plain = self.step

        def step(state: tuple, symbol: str) -> tuple[tuple, str]:
            found = arcs.get((state, symbol))
            if found is None:
                found = arcs[state, symbol] = plain(state, symbol)
            return found

        return Transducer(self.start, step)

    def read(self, symbols) -> list[str]:
        state, out, step = self.start, [], self.step
        for s in symbols:
            state, written = step(state, s)
            out.append(written)
        return out


def is_match(symbol: str) -> bool:
    return symbol[0] in (INSULT, THREAT, HARM)


def threat() -> Transducer:
    """Violence within NEAR tokens behind an announcement becomes a threat."""

    def step(left: tuple, s: str) -> tuple[tuple, str]:
        if s == HARM and left[0]:
            return left, THREAT
        return ((NEAR,) if s == ANNOUNCE else (max(0, left[0] - 1),)), s

    return Transducer((0,), step)


def negation() -> Transducer:
    def step(left: tuple, s: str) -> tuple[tuple, str]:
        if s == NEGATION:
            return (SCOPE,), s
        return (max(0, left[0] - 1),), s + "-" if left[0] and is_match(s) else s

    return Transducer((0,), step)


def report() -> Transducer:
    """State: behind a reporting verb, inside quotation marks."""

    def step(at: tuple, s: str) -> tuple[tuple, str]:
        if s == REPORT:
            return (True, at[1]), s
        if s == QUOTE:
            return (at[0], not at[1]), s
        return at, s + "~" if (at[0] or at[1]) and is_match(s) else s

    return Transducer((False, False), step)


def target() -> Transducer:
    """Marks what follows a target; read from the right, what stands before one."""

    def step(seen: tuple, s: str) -> tuple[tuple, str]:
        if s == TARGET:
            return (True,), s
        return seen, s + "@" if seen[0] and is_match(s) and not s.endswith("@") else s

    return Transducer((False,), step)


GRAMMAR, FROM_RIGHT = (threat() @ negation() @ report() @ target()).compiled(), target().compiled()


def tags_of(symbols: list[str]) -> list[str]:
    """What the grammar makes of a clause's symbols; violence that isn't announced is a threat only if it is aimed."""
    found = FROM_RIGHT.read(reversed(GRAMMAR.read(symbols)))[::-1]
    return [THREAT + t[1:] if t[0] == HARM and t.endswith("@") else t for t in found]


def stems(word: str) -> list[str]:
    """A word, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """A lower bound of the logarithm of how much likelier toxic texts have it than others."""
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)) - ERRORS * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


@dataclass
class Model:
    """Weights of stems and words: as learned, without one toxic text, and without one other text; and what features are worth."""

    weights: dict[str, tuple[float, float, float]]
    values: np.ndarray


class Lexicon(dict):
    """Token to a number: its symbol is ``symbols[number]``, its weight ``weight[which][number]``; 0 is a token without a role.

    Tokens are looked up once; the table is emptied when it gets large, which changes no result.
    """

    LARGEST = 1 << 20

    def __init__(self, model: Model):
        self.model = model
        self.fixed = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (ANNOUNCED, ANNOUNCE), (VIOLENCE, HARM)) for w in words}
        self.fixed |= dict.fromkeys(BOUNDARIES, BOUNDARY) | dict.fromkeys(QUOTES, QUOTE)
        self.insults, self.symbols, self.rows = set(INSULTS), [OTHER], [(0.0, 0.0, 0.0)]
        self.roles: dict[tuple, int] = {(OTHER, self.rows[0]): 0}

    def __missing__(self, token: str) -> int:
        if len(self) > self.LARGEST:
            self.clear()
        word = token.lower()
        learned = [self.model.weights[s] for s in stems(word) if s in self.model.weights]
        seed = SEED if word in self.insults else 0.0
        row = tuple(max([seed, *(w[i] for w in learned)]) for i in range(3))
        if word not in self.fixed and max(row) >= LEAST:
            role = (INSULT, row)
        else:
            symbol = self.fixed.get(word, OTHER)
            role = (symbol, (SEED,) * 3 if symbol == HARM else (0.0,) * 3)
        number = self.roles.get(role)
        if number is None:
            number = self.roles[role] = len(self.symbols)
            self.symbols.append(role[0])
            self.rows.append(role[1])
        self[token] = number
        return number


def matches(text: str, lexicon: Lexicon, which: int = 0) -> tuple[int, list[tuple[int, int, list[tuple[str, float]]]]]:
    """Number of tokens, and (first token, end, [(tag, weight)]) of each clause that the grammar matches."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return 0, []
    codes = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
    roles = codes[codes > 0]
    if not any(lexicon.symbols[c] in (INSULT, HARM) for c in set(roles.tolist())):
        return len(tokens), []
    symbols = np.array(lexicon.symbols)[codes]
    cuts = np.concatenate([[-1], np.flatnonzero(symbols == BOUNDARY), [len(codes)]])
    hits = np.flatnonzero((symbols == INSULT) | (symbols == HARM))
    found = []
    for k in np.unique(np.searchsorted(cuts, hits)).tolist():
        lo, hi = int(cuts[k - 1]) + 1, int(cuts[k])
        tagged = [(t, lexicon.rows[codes[lo + i]][which]) for i, t in enumerate(tags_of(symbols[lo:hi].tolist())) if t[0] in (INSULT, THREAT)]
        tagged = [(t, w) for t, w in tagged if w >= LEAST]
        if tagged:
            found.append((lo, hi, tagged))
    return len(tokens), found


def features(n_tokens: int, found: list[tuple[int, int, list[tuple[str, float]]]]) -> np.ndarray:
    total, most = dict.fromkeys(TAGS, 0.0), 0.0
    for _, _, tagged in found:
        for t, w in tagged:
            total[t] += w
            if "-" not in t and "~" not in t:
                most = max(most, w)
    plain = sum(w for t, w in total.items() if "-" not in t and "~" not in t)
    return np.array([1.0, most, math.log1p(100 * plain / max(1, n_tokens)), *(math.log1p(total[t]) for t in TAGS)])


def is_held_out(doc_id: Column) -> Column:
    """Null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled texts that aren't held out; equal texts with equal labels count once.

    Of several labels of one id the larger holds; a null label or id is none.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(~is_held_out(F.col("doc_id")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return texts.join(known, "doc_id").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"]).drop("h")


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def _distinct(text: str) -> set[str]:
    return {w.lower() for w in TOKEN.findall(text) if w not in BOUNDARIES and w not in QUOTES}


def stem_counts(rows: DataFrame) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Texts that have a stem or word, toxic and others, of those that enough toxic ones have; numbers of both."""
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            count = Counter(s for t in texts for s in {s for w in _distinct(t) for s in stems(w)})
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["stem", "n"])

    found = rows.where("toxic = 1").select("text").mapInArrow(all_, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    toxic = {r.stem: r.n for r in found.where(F.col("n") >= max(FEWEST, math.ceil(SHARE * n_toxic))).toLocalIterator()}
    shared = rows.sparkSession.sparkContext.broadcast(toxic)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, words = shared.value, {}
        for _, texts in _texts(batches):
            count: Counter = Counter()
            for t in texts:
                here = set()
                for w in _distinct(t):
                    if w not in words:
                        words[w] = [s for s in stems(w) if s in of]
                    here.update(words[w])
                count.update(here)
            if len(words) > Lexicon.LARGEST:
                words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["stem", "n"])

    found = rows.where("toxic = 0").select("text").mapInArrow(known, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    clean = {r.stem: r.n for r in found.toLocalIterator()}
    return {s: (k, clean.get(s, 0)) for s, k in toxic.items()}, n_toxic, n_clean


def learned_weights(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, tuple[float, float, float]]:
    out = {}
    for s, (t, c) in counts.items():
        row = odds(t, c, n_toxic, n_clean), odds(t - 1, c, n_toxic - 1, n_clean) if n_toxic > 1 else 0.0, odds(t, max(0, c - 1), n_toxic, max(0, n_clean - 1))
        if max(row) >= LEAST:
            out[s] = row
    return out


def newton(rows: DataFrame, start: np.ndarray = START, steps: int = STEPS) -> np.ndarray:
    """Values of the features of rows (toxic, f): logistic regression, held to the starting values by a ridge."""
    d, v = len(start), start.copy()
    for _ in range(steps):
        now = v

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + d * d)
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy().reshape(len(y), d)
                p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                total[:d] += x.T @ (p - y)
                total[d:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "total"])

        total = np.zeros(d + d * d)
        for r in rows.select("toxic", "f").mapInArrow(sums, "entry long, total double").groupBy("entry").agg(F.sum("total").alias("total")).collect():  # d + d * d rows
            total[r.entry] = r.total
        change = np.linalg.solve(total[d:].reshape(d, d) + RIDGE * np.eye(d), total[:d] + RIDGE * (v - start))
        v = v - change * min(1.0, 2.0 / max(1e-12, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    return v


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From every labelled text that isn't held out. Without toxic ones, the lists and the starting values stand."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    rows = scratch.save(training_rows(docs, labels), "training")
    counts, n_toxic, n_clean = stem_counts(rows)
    model = Model(learned_weights(counts, n_toxic, n_clean), START)
    if not n_toxic:
        return model
    shared = spark.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch, texts in _texts(batches):
            label = batch.column(1).to_pylist()
            f = [features(*matches(t, lexicon, 1 if y else 2)).tolist() for t, y in zip(texts, label)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    table = scratch.save(rows.select("text", "toxic").mapInArrow(made, "toxic int, f array<double>"), "features")
    scratch.drop("training")
    return Model(model.weights, newton(table))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc_id and other columns to ``keep``, score, clauses) of every text.

    ``clauses`` are what the grammar matched: start and end in code points, tags, and their weight.

    Rows: a null or empty text has the score of a text without a match. Nulls in other columns, equal ids and equal rows
    stay, a row for each; a text of any length is read whole. Other columns than ``text`` and those to keep are not read.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    clause = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tags", pa.list_(pa.string())), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, values = Lexicon(shared.value), shared.value.values
        for batch, texts in _texts(batches, len(keep)):
            scores, clauses = [], []
            for t in texts:
                n, found = matches(t, lexicon)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(n, found) @ values))))))
                places = [m.span() for m in TOKEN.finditer(t)] if found else []
                clauses.append([{"start": places[lo][0], "end": places[hi - 1][1], "tags": [x for x, _ in tagged], "weight": sum(w for _, w in tagged)} for lo, hi, tagged in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array(clauses, pa.list_(clause))], [*keep, "score", "clauses"])

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double, clauses array<struct<start: bigint, end: bigint, tags: array<string>, weight: double>>")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses): the model fitted on the labels and applied to every text.

    A null id is not held out, and never learned from.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
