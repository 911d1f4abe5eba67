"""Problem 1: one consistent form for visually identical text, by confusables skeleton.

Two forms are made of a text. ``consistent`` is the text as it should be stored: ordinary
characters, composed accents, words of another alphabet left alone. ``skeleton`` is a comparison
key only: decompose, replace every character by its prototype, decompose again. Texts with equal
skeletons look alike and fall in one group. The prototypes are those of the Unicode confusables data
(``unicode_table``), with a few letters, quotation marks and dashes of this module.

Null text has null forms and is no case; empty text is its own form. Only texts with a character
beyond ASCII are sent to Python, for all others the text is already its form.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: look-alike letters of other alphabets and their Latin prototypes ---
CYRILLIC = "а a, е e, о o, р p, с c, х x, у y, і i, ѕ s, ј j, һ h, ԁ d, ԛ q, ԝ w, к k, м m, т t, в b, н h, А A, В B, Е E, К K, М M, Н H, О O, Р P, С C, Т T, Х X, У Y, І I, Ѕ S, Ј J"
GREEK = "ο o, ν v, α a, ρ p, τ t, ι i, κ k, υ u, χ x, γ y, η n, ω w, ε e, Α A, Β B, Ε E, Ζ Z, Η H, Ι I, Κ K, Μ M, Ν N, Ο O, Ρ P, Τ T, Υ Y, Χ X"
# --- fixed values: characters of no width, spaces, hyphens, and quotation marks or dashes that only the skeleton unites ---
ZERO_WIDTH = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
SPACES = "               　"
HYPHENS = "‐‑⁃﹣"
QUOTES_AND_DASHES = {"‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "–": "-", "—": "-", "―": "-", "−": "-"}

LOOK_ALIKE = {a: b for pair in f"{CYRILLIC}, {GREEK}".split(", ") for a, b in [pair.split(" ")]}
_PLAIN = {ord(c): None for c in ZERO_WIDTH} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
#: Full-width forms, ligatures, and the letters and digits of mathematical print stand for their plain characters.
_PLAIN |= {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D6A4), *range(0x1D7CE, 0x1D800)]}
_UNITED = {ord(a): b for a, b in QUOTES_AND_DASHES.items()}
_OTHER = "Ͱ-ϿЀ-ԯԱ-֏א-תႠ-ჿᎠ-᏿ἀ-῿Ⅰ-ↈⲀ-⳿"
_WORD = re.compile(r"[^\W\d_]*(?:[A-Za-zÀ-ɏ][̀-ͯ]*[" + _OTHER + "]|[" + _OTHER + r"][̀-ͯ]*[A-Za-zÀ-ɏ])[^\W\d_]*")
NOT_ASCII = r"[^\x00-\x7F]"


def has_mixed_word(text: str) -> bool:
    """Whether a word holds letters of the Latin and of another alphabet."""
    return _WORD.search(text.translate(_PLAIN)) is not None


#: Characters that the consistent form may replace; a text without any is only composed.
_ODD = frozenset(map(chr, _PLAIN)) | {chr(c) for a, b in zip(_OTHER[::3], _OTHER[2::3]) for c in range(ord(a), ord(b) + 1)}


class Table(NamedTuple):
    """Prototypes of look-alike characters, and the Latin letters that letters of other alphabets stand for."""

    prototype: dict[int, str]
    letters: dict[int, str]


def _table(prototype: dict[int, str]) -> Table:
    """The given prototypes with this module's own; a letter's Latin counterpart has the same prototype and the same case."""
    own = {ord(a): prototype.get(ord(b), b) for a, b in LOOK_ALIKE.items()}
    latin: dict[str, list[str]] = {}
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        latin.setdefault(prototype.get(ord(c), c), []).append(c)
    letters = {}
    for code, p in prototype.items():
        if code > 127 and p in latin and unicodedata.category(chr(code)) in ("Lu", "Ll", "Lo", "Nl") and not unicodedata.name(chr(code), "").startswith("LATIN"):
            letters[code] = next((c for c in latin[p] if c.isupper() == chr(code).isupper()), latin[p][0])
    plain = {c: None if v is None else "".join(prototype.get(ord(x), x) for x in v) for c, v in (_PLAIN | _UNITED).items()}
    return Table(prototype | own | plain, letters | {ord(a): b for a, b in LOOK_ALIKE.items()})


#: The table without the library of the engine: this module's pairs alone.
OWN = _table({})
_known: Table | None = None


def unicode_table(spark: SparkSession) -> Table:
    """The prototypes of the Unicode confusables data that the engine's library carries, for every assigned character outside the
    large ideographic and syllabic blocks. Some thousand entries whatever the input, so they can be sent to every worker."""
    global _known
    if _known is None:
        chars = [chr(c) for c in range(33, 0x1FBFA) if unicodedata.category(chr(c))[0] in "LNPSM" and not (0x3400 <= c < 0xA4D0 or 0xAC00 <= c < 0xD7B0 or 0xF900 <= c < 0xFB00 or 0x12000 <= c < 0x1D100)]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton(0, "\n".join(chars)).split("\n")
        _known = _table({ord(c): p for c, p in zip(chars, found, strict=True) if p != unicodedata.normalize("NFD", c)})
    return _known


def consistent_form(text: str | None, table: Table = OWN) -> str | None:
    if text is None or text.isascii():
        return text
    if not _ODD.isdisjoint(text):
        text = text.translate(_PLAIN)
        text = _WORD.sub(lambda m: m[0].translate(table.letters), text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def skeleton_form(text: str | None, table: Table = OWN) -> str | None:
    """Decomposed, every character replaced by its prototype, decomposed again."""
    return None if text is None else unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table.prototype))


def is_case(text: str, table: Table, beyond: dict[int, str]) -> bool:
    """Whether a text beyond ASCII is no case of ordinary characters.

    Candidates are texts whose skeleton (``beyond``: the prototypes of characters beyond ASCII), composed
    again, is another text; of these the consistent form decides.
    """
    if unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(beyond)) == text:
        return False
    return consistent_form(text, table) != text or has_mixed_word(text)


def _beyond_ascii(text: Column) -> Column:
    return F.when(text.rlike(NOT_ASCII), text)


def consistent(text: Column, table: Table) -> Column:
    """The consistent form; ASCII text never leaves the JVM."""

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: consistent_form(t, table), na_action="ignore")

    return F.coalesce(form(_beyond_ascii(text)), text)


def skeleton(text: Column, table: Table) -> Column:
    """The comparison key of a text; that of an ASCII text is made in the JVM."""

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: skeleton_form(t, table), na_action="ignore")

    plain = text
    for code, p in sorted(table.prototype.items()):
        if code < 128 and p != chr(code):
            plain = F.replace(plain, F.lit(chr(code)), F.lit(f"\ue000{code}\ue001"))
    for code, p in sorted(table.prototype.items()):
        if code < 128 and p != chr(code):
            plain = F.replace(plain, F.lit(f"\ue000{code}\ue001"), F.lit(p))
    return F.coalesce(form(_beyond_ascii(text)), plain)


def is_inconsistent(text: Column, table: Table) -> Column:
    """Whether the text is a case; null for null. ASCII text is none."""
    beyond = {c: p for c, p in table.prototype.items() if c > 127}

    @F.pandas_udf(T.BooleanType())
    def case(s: pd.Series) -> pd.Series:
        return s.map(lambda t: is_case(t, table, beyond), na_action="ignore").astype("boolean")

    return F.when(text.isNotNull(), F.coalesce(case(_beyond_ascii(text)), F.lit(False)))


def skeleton_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: key, class_id (least key with an equal skeleton), class_size, consistent_text.

    Rows whose text is null have class_size 0 and no class. The groups are made of 128-bit keys of the
    skeletons and pre-aggregated before the shuffle, so a group with a third of all rows is one small
    partial row per task; the join back is skew-split by the engine.
    """
    table = unicode_table(df.sparkSession)
    k = skeleton(F.col(text), table)
    rows = df.select(F.col(key).alias("row_key"), consistent(F.col(text), table).alias("consistent_text"), F.when(k.isNotNull(), F.md5(k)).alias("skeleton_key"))
    groups = rows.where("skeleton_key is not null").groupBy("skeleton_key").agg(F.min("row_key").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(groups, "skeleton_key", "left").select("row_key", "class_id", F.coalesce("class_size", F.lit(0)).alias("class_size"), "consistent_text")
