"""The library's functions under names that SQL can call.

Scalar functions are SQL functions, which Catalyst puts in place like any expression. Windows are a table function that takes
a table and works on Arrow batches; encoding with a vocabulary is an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import normalize as N
from glyphmill.functions.scalars import DECAY, FLOOR, MASS
from glyphmill.operators import subword
from glyphmill.operators.windows import parts_of, window_batches


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def translation(text: str, table: dict[str, str]) -> str:
    return f"translate({text}, {literal(''.join(table))}, {literal(''.join(table.values()))})"


NFKC = "CASE WHEN s IS NOT NULL THEN reflect('com.ibm.icu.text.Normalizer', 'compose', coalesce(s, ''), true) END"
#: Name and arguments, type, and what it stands for.
SCALARS = [
    ("nfkc(s STRING)", "STRING", NFKC),
    ("full_width(s STRING)", "STRING", translation("s", N.WIDTH)),
    ("normalize_text(s STRING)", "STRING", translation(NFKC, N.FULL)),
    ("white_space_tokens(s STRING)", "ARRAY<STRING>", r"filter(split(s, r'\s+'), t -> t <> '')"),
    ("distance_weight(d DOUBLE)", "DOUBLE", "1.0D / pow(d, 0.25D)"),
    ("nucleus_mass(n BIGINT)", "DOUBLE", f"greatest({MASS}D * pow({DECAY}D, n), {FLOOR}D)"),
    ("safe_ratio(n DOUBLE, d DOUBLE)", "DOUBLE", "CASE WHEN d > 0 THEN n / d ELSE 0.0D END"),
]


def _number(x: pa.Array) -> int:
    n = x[0].as_py()
    if n is None or n < 1:
        raise ValueError("width and slide must be positive")
    return n


@F.arrow_udtf(returnType="row_id bigint, pos int, y string, indices array<string>, values array<double>")
class ContextWindows:
    """context_windows(TABLE(t), width, slide): the windows of a table of a key and an array of tokens, its first two columns.

    Rows come in any order; a null array has no tokens, a null key stays null.
    """

    def eval(self, table: pa.RecordBatch, width: pa.Array, slide: pa.Array) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            lists = table.column(1).cast(pa.list_(pa.string()))
            for ids, part in parts_of(table.column(0).cast(pa.int64()), lists):
                yield from window_batches(ids, part, "<s>", "</s>", _number(width), _number(slide))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session, for as long as it lasts; returns their names."""
    for head, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("context_windows", ContextWindows)
    return [*(head.split("(")[0] for head, _, _ in SCALARS), "context_windows"]


def register_vocabulary(spark: SparkSession, model: subword.Vocabulary, name: str = "encode_pieces") -> str:
    """encode_pieces(words): struct<ids, pieces> of the words that ``subword_words(text)`` gives."""
    spark.udf.register(name, subword.word_encoder(spark, model))
    blanks = f"translate(s, {literal(subword.BLANK + subword.TILDE + subword.DROPPED)}, {literal(' ' * len(subword.BLANK) + subword.ASIDE)})"
    plain = f"translate({NFKC.replace('coalesce(s,', f'coalesce({blanks},')}, {literal(subword.ASIDE)}, {literal(subword.TILDE)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION subword_words(s STRING) RETURNS ARRAY<STRING> RETURN transform(filter(split(coalesce({plain}, ''), ' '), w -> w <> ''), w -> concat({literal(subword.SPACE)}, w))")
    return name
