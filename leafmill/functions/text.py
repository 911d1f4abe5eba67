"""Scalar text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: ligatures and invisible signs of printed text, and what stands for them ---
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "­": "", "\x0c": ""}
# --- fixed value: signs that sentences may hold besides letters, digits and spaces ---
SENTENCE_SIGNS = ".,;:!?'\"—–()-"
# --- fixed values: entities that markup holds most often ---
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


# --- fixed values: patterns of markers in proofread texts, of model replies, and of ids ---
START_MARK, END_MARK, NOTES = r"\*\*\* ?start of .*?\*\*\*", r"\*\*\* ?end of", r"(?i)\[(illustration|transcriber[^\]]*)\]"
REASONING = r"(?s)<think>.*?</think>"
ARTICLE_ID = r"^(.+)_[au]\d+$"


def strip(x: Column) -> Column:
    """Without white space at both ends; SQL's trim takes spaces only."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_chars(line: Column) -> Column:
    """Ligatures and invisible signs resolved, runs of blanks inside the line made one, the indent kept."""
    for a, b in LIGATURES.items():
        line = F.replace(line, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(line, r"\s+$", ""), r"(?<=\S)[ \t]+", " ")


def garbage_score(line: Column) -> Column:
    """Share of signs that no sentence holds; at least 0.9 for a line with few letters. 0 for an empty line."""
    s = strip(line)
    n = F.length(s)
    bad = F.length(F.regexp_replace(s, r"[\p{L}\p{N} .,;:!?'\"—–()\-]", "")) / n
    letters = (n - F.length(F.regexp_replace(s, r"\p{L}", ""))) / n
    return F.when(n == 0, 0.0).when((n > 6) & (letters < 0.3), F.greatest(bad, F.lit(0.9))).otherwise(bad)


def is_folio(line: Column) -> Column:
    """A line that is one to four digits."""
    return strip(line).rlike(r"^\d{1,4}$")


def looks_like_word(x: Column) -> Column:
    """The shape of an English word: 2 to 20 letters with a vowel, signs around it aside."""
    w = F.regexp_replace(F.lower(x), r"^[.,;:!?'\"]+|[.,;:!?'\"]+$", "")
    return w.rlike("^[a-z]{2,20}$") & w.rlike("[aeiouy]")


def html_to_text(markup: Column) -> Column:
    """Breaks and paragraph ends as newlines, tags removed, then all entities resolved. Null is ''.

    Only text that still holds an ampersand leaves the JVM.
    """
    x = F.regexp_replace(F.coalesce(markup, F.lit("")), r"<br\s*/?>|</p>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    return strip(F.coalesce(unescaped(F.when(x.contains("&"), x)), x))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Named and numbered entities as their characters; null for null."""
    return text.map(html.unescape, na_action="ignore")


def url_encoded(text: Column) -> Column:
    """Percent-encoded as the path of an address: a space is %20, a slash stays."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def base64_of(data: Column) -> Column:
    """Bytes, or text as UTF-8, in base 64."""
    return F.base64(data.cast("binary"))


def numbered_id(prefix: Column, letter: str, number: Column) -> Column:
    """prefix_a007: numbers of more than three digits stay whole."""
    return F.concat(prefix, F.lit(f"_{letter}"), F.format_string("%03d", number))


def norm_scoring(text: Column) -> Column:
    """The form in which texts are measured: plain quotes and dashes, lower case, single spaces."""
    return strip(F.regexp_replace(F.lower(F.translate(text, "‘’“”—–", "''\"\"--")), r"\s+", " "))


def strip_boilerplate(text: Column) -> Column:
    """The text between a start and an end marker, if both stand; notes in brackets removed."""
    framed = f"(?is){START_MARK}(.*){END_MARK}"
    return F.regexp_replace(F.when(text.rlike(framed), F.regexp_extract(text, framed, 1)).otherwise(text), NOTES, " ")


def strip_think(text: Column) -> Column:
    """A reply without the reasoning that some models write before it. Null is ''."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), REASONING, ""))


def first_json(reply: Column) -> Column:
    """The first {...} block of a chatty reply, null without one."""
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def head_words(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def tail_words(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - (n - 1)), n), " ")


def normalize_label(label: Column) -> Column:
    """A layout label by its letters alone."""
    return F.regexp_replace(F.lower(label), "[^a-z]", "")


def stage_input(stage: Column) -> Column:
    """The stage that a stage was made from: rules_<x> from <x>, llm_<backend>_<x> from rules_<x>."""
    return F.when(stage.startswith("rules_"), F.regexp_replace(stage, "^rules_", "")).when(
        stage.rlike("^llm_[^_]*_.+"), F.concat(F.lit("rules_"), F.regexp_extract(stage, "^llm_[^_]*_(.+)$", 1))
    )


def issue_of_article(article_id: Column) -> Column:
    """The issue in an article id such as <issue>_a012 or <issue>_u003; null where there is none."""
    x = F.regexp_extract(article_id, ARTICLE_ID, 1)
    return F.when(x != "", x)
