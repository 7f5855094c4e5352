"""Multilingual language identification by mixtures.

Each language is a distribution over hashed character trigrams. A document is a mixture of languages and of one flat
background for what is no language; expectation-maximisation finds the proportions from the trigrams' likelihoods, and
languages enter the document's set one by one, by share, as long as the penalised likelihood grows.

The counts are taken over every labelled training document and summed per (language, trigram); only that table, of at
most 2^16 rows a language, reaches the driver.

Rows: a null text, or one without any letter, is "und" with score 0; documents without a language, or with a null
doc_id, teach nothing; repeated rows are counted and judged each; other columns are not read. An empty table gives an
empty table, and if nothing could be learned every document is "und".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches

BITS = 16
BUCKETS = 1 << BITS
SMOOTHING, STEPS, SETTLED = 0.05, 40, 1e-3
#: Neighbouring trigrams share characters: a third of them counts as independent evidence. Log-likelihood that another language must gain.
OVERLAP, PENALTY = 3.0, 2.0
RESULT = "lang string, score double, background double, languages string"
_letters = None


def letters() -> np.ndarray:
    """Which code points are letters, from the Unicode database."""
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text in which each run of other characters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    chars = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    chars = np.concatenate([[np.uint64(32)], chars, [np.uint64(32)]])
    h = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (chars[2:] * np.uint64(0x165667B19E3779F9))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Columns of ``p``: the languages in order, then the flat background."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        cols = [(counts[s] + SMOOTHING) / (counts[s].sum() + SMOOTHING * BUCKETS) for s in self.languages]
        self.p = np.stack([*cols, np.full(BUCKETS, 1 / BUCKETS)], 1)

    def mixture(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the columns of ``p``, and the log-likelihood."""
        share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
        for _ in range(STEPS):
            new = share * (p.T @ (n / (p @ share))) / total
            settled = np.abs(new - share).max() < SETTLED
            share = new
            if settled:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, float, str]:
        grams = trigrams(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0, 1.0, ""
        grams, n = np.unique(grams, return_counts=True)
        n, p = n.astype(float), self.p[grams]
        back = len(self.languages)
        share, _ = self.mixture(p, n)
        order = [k for k in np.argsort(-share, kind="stable") if k != back]
        chosen, best = [order[0]], self.mixture(p[:, [order[0], back]], n)
        cost = PENALTY * np.log(n.sum() + 1)
        for k in order[1:]:
            if share[k] * n.sum() < 1:
                break
            more = self.mixture(p[:, [*chosen, k, back]], n)
            if (more[1] - best[1]) / OVERLAP <= cost:
                break
            chosen, best = [*chosen, k], more
        share = best[0]
        top = int(np.argmax(share[:-1]))
        spoken = share[:-1].sum()
        names = ",".join(f"{self.languages[k]}:{s:.3f}" for k, s in zip(chosen, share))
        return self.languages[chosen[top]], float(min(1.0, share[top] / spoken)) if spoken > 0 else 0.0, float(share[-1]), names


def fit(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang) that have both."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = trigrams(text.as_py())
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                at, n = np.unique(grams, return_counts=True)
                sums[lang][at] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, gram int, n long")
    counts: dict[str, np.ndarray] = {}
    for lang, gram, n in rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts.setdefault(lang, np.zeros(BUCKETS))[gram] = n
    return Model(counts)


def infer(model: Model, text: Column, spark) -> Column:
    """A struct RESULT for each text: the main language, its share of the languages, the background's share, the set."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^16 rows of (languages + 1) numbers

    @F.pandas_udf(RESULT)
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.infer(t) for t in batch], columns=["lang", "score", "background", "languages"])

    return udf(text)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, background, languages; learnt from the documents that aren't held out."""
    model = fit(documents.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    out = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), infer(model, F.col("text"), documents.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.background", "p.languages")
