"""Problem 6: repetition inside a single document, and lines that many documents of a host share.

``line_frequency`` is the named method: hash normalised lines, count the distinct documents of each
host that hold a line, remove lines above the limit, reject documents that lose too much by it.

That count says nothing about a phrase that comes back within one document, so ``repeated_share``
applies the same method with other units: the host is the document, a line is every run of six
normalised words, the limit is one occurrence, and the document is depleted by the letters of the
runs that stood earlier. A run counts wherever it stands, so the print's line breaks don't matter.

Null and empty texts, and texts of fewer than seven words, have a share of 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A passage is at least so many words.
PASSAGE = 6
#: Share of letters in repeated passages from which a document is a case.
REPEATED = 0.4

_BREAK = re.compile(r"[-¬]\s*\n\s*")
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Words by letters alone: no case, digits, punctuation or line breaks."""
    if "\n" in text:
        text = _BREAK.sub("", text)
    return _WORDS.findall(text.lower().replace("'", "").replace("’", ""))


def repeated_shares(texts: list[str | None]) -> np.ndarray:
    """For each text the share of its letters in passages that already stood earlier in it."""
    out = np.zeros(len(texts))
    found = [words_of(t) if t else [] for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for ws in found for w in ws]
    if len(flat) < PASSAGE:
        return out
    codes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), n)
    m = len(flat) - PASSAGE + 1
    run = np.zeros(m, np.uint64)
    for k in range(PASSAGE):
        run = (run ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    whole = doc[:m] == doc[PASSAGE - 1 :]
    run = run ^ (doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(whole)
    _, first = np.unique(run[at], return_index=True)  # of equal runs the first
    again = np.ones(len(at), bool)
    again[first] = False
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, at[again], 1)
    np.add.at(edges, at[again] + PASSAGE, -1)
    marked = np.cumsum(edges[:-1]) > 0
    total = np.bincount(doc, letters, len(texts))
    np.divide(np.bincount(doc, letters * marked, len(texts)), total, out=out, where=total > 0)
    return out


def repeated_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, repeated_share: one row for each input row. No shuffle: a document is its own host."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "repeated_share": repeated_shares(b["_text"].tolist())})

    rows = df.select(F.col(key), F.col(text).alias("_text"))
    return rows.mapInPandas(share, f"`{key}` {dict(rows.dtypes)[key]}, repeated_share double")


def normal_line(line):
    """A line without case, digits and punctuation."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def line_frequency(df: DataFrame, key: str, host: str, text: str, limit: int = 10, least_kept: float = 0.6) -> DataFrame:
    """One row per document: key, host, n_chars, removed_chars, kept_share, rejected.

    A line is removed where more than ``limit`` distinct documents of the host hold it. Lines are
    counted by 64-bit hash, first within a document, then partially on the map side, so neither a hot
    host nor a hot line meets in one task before it is one row. Null hosts count as one host; a document
    without a line keeps all (share 1); repeated input rows count as one document.
    """
    lines = df.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_line"))
    n = normal_line(F.col("_line"))
    per_doc = lines.select("_key", "_host", F.when(n != "", F.xxhash64(n)).alias("_h"), F.length("_line").alias("_n")).groupBy("_host", "_h", "_key").agg(F.sum("_n").alias("_n"))
    counts = per_doc.where("_h is not null").groupBy(F.col("_host").alias("_host2"), F.col("_h").alias("_h2")).agg(F.count("*").alias("_docs")).where(F.col("_docs") > limit)
    hit = per_doc.join(counts, (F.col("_host").eqNullSafe(F.col("_host2"))) & (F.col("_h") == F.col("_h2")), "left")
    out = hit.groupBy("_key", "_host").agg(F.sum("_n").alias("n_chars"), F.sum(F.when(F.col("_docs").isNotNull(), F.col("_n")).otherwise(0)).alias("removed_chars"))
    kept = F.when(F.col("n_chars") > 0, 1 - F.col("removed_chars") / F.col("n_chars")).otherwise(1.0)
    return out.select(F.col("_key").alias(key), F.col("_host").alias(host), "n_chars", "removed_chars", kept.alias("kept_share"), (kept < least_kept).alias("rejected"))
