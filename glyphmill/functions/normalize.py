"""Japanese text normalisation: Unicode NFKC and one character map, all inside the JVM.

After NFKC every step maps single characters, so the whole chain is one ``translate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the corpus's normal form.
OPEN_BRACKETS = "（［｛〈《「『【〔〖〘〚〝‘“｟〿⦅⦃⟨⟪⦇⟦⟬⟮⦉⦋⦍⦏⦑⦓⦕⦗"
CLOSE_BRACKETS = "）］｝〉》」』】〕〗〙〛〟’”｠⦆⦄⟩⟫⦈⟧⟭⟯⦊⦌⦎⦐⦒⦔⦖⦘"
BARS = "－−‐-‒–—―⁃﹘﹣ーｰ─━╌╍┄┅┈┉╴╶╸╺"
COMMAS = "、，,､﹐﹑"
PERIODS = "。．.｡﹒"
SLASHES = "／/＼\\⁄∕"
WAVES = "〜～~∼∽∿"
OPEN_QUOTES = "“‘〝＂\"'"
CLOSE_QUOTES = "”’〟＂\"'"

WIDTH = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)}
CASE = {chr(0xFF41 + k): chr(0xFF21 + k) for k in range(26)}
DIGITS = {chr(0xFF10 + k): chr(0xFF10 + (0 if k == 0 else 1 if k <= 2 else 3)) for k in range(10)}


def to_one(chars: str, target: str) -> dict[str, str]:
    return {c: target for c in chars}


#: The classes' maps in the order in which they take effect on widened text.
STEPS: dict[str, list[dict[str, str]]] = {
    "brackets": [to_one(OPEN_BRACKETS, "（"), to_one(CLOSE_BRACKETS, "）")],
    "bars": [to_one(BARS, "－")],
    "case": [CASE],
    "commas": [to_one(COMMAS, "、")],
    "periods": [to_one(PERIODS, "．")],
    "slashes": [to_one(SLASHES, "／")],
    "waves": [to_one(WAVES, "～")],
    "quotes": [to_one(OPEN_QUOTES, "「"), to_one(CLOSE_QUOTES, "」")],
    "digits": [DIGITS],
}


def composed(*maps: dict[str, str]) -> dict[str, str]:
    """The one map that has the effect of all in turn."""
    out: dict[str, str] = {}
    for start in {c for m in maps for c in m}:
        c = start
        for m in maps:
            c = m.get(c, c)
        if c != start:
            out[start] = c
    return dict(sorted(out.items()))


FULL = composed(WIDTH, *(m for maps in STEPS.values() for m in maps))


def mapped(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def nfkc(text: Column) -> Column:
    """Unicode NFKC by ICU, which Spark bundles for its collations; null stays null."""
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNotNull(), whole)


def full_width(text: Column) -> Column:
    """U+0021 to U+007E become full-width; the space stays."""
    return mapped(text, WIDTH)


def unify(text: Column, step: str) -> Column:
    """One class of STEPS on widened text."""
    return mapped(text, composed(*STEPS[step]))


def normalize(text: Column) -> Column:
    """NFKC, full width and all classes."""
    return mapped(nfkc(text), FULL)
