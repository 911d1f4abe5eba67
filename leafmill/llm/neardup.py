"""Problem 2: near-duplicate records by circulant MinHash, banding and exact verification.

A text is reduced to a sequence of folded words: line-end hyphens joined, letters that scans take for
one another made equal, numbers dropped. Its five-word shingles are sent through one permutation into
a ring of 2^20 places; a second permutation of that ring, shifted by one place for each coordinate,
gives all signature coordinates (circulant MinHash): coordinate k of a set is the least value of the
second permutation at the places of the set moved on by k. A few coordinates make a band (``banding``
takes their number from the size of the collection and the bands from the recall that is kept); classes
of equal folded text that share two bands are candidates, and every candidate is verified on its words:
TESTDATA.md asks for the share of words in common runs, and the exact Jaccard similarity stands beside it.

Texts equal after folding are one class before anything is compared, so a text with any number of
copies costs one signature. A text shorter than a shingle is one shingle of all its words. Null texts
and texts below ``least_chars`` are left out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.graph import components
from leafmill.session import cut

SHINGLE = 5
#: Coordinates of a band; one more for every GROWTH-fold of DOCUMENTS, as chance pairs grow with the square of the collection.
ROWS, DOCUMENTS, GROWTH = 3, 200_000, 20
#: The least similarity that is sought, and the share of such pairs that must share two bands.
LEAST_SIMILAR, RECALL = 0.44, 0.92
RING = 1 << 20
#: Share of each text's words that must stand in passages the other has too.
SHARED = 0.6

# --- fixed values: letters and signs that scans take for one another, each line one class ---
GLYPH_CLASSES = ["aceo0", "il1j|!", "tf", "hb68", "gq9", "nu", "s5", "vy"]
GLYPH_PAIRS = {"rn": "m", "ri": "n", "li": "h", "cl": "d", "vv": "w"}

_FOLD = {ord(c): group[0] for group in GLYPH_CLASSES for c in group}
_PAIRS = sorted({(a.translate(_FOLD), b.translate(_FOLD)) for a, b in GLYPH_PAIRS.items()})
_JOIN = re.compile(r"(?<=[^\W\d_]) ?[-¬] ?\s+(?=[^\W\d_A-Z])")
_TOKEN = re.compile(r"[\w|]+")


class Words(dict):
    """Word to the 64-bit hash of its folded form; 0 for what is no word. Cleared when it grows large."""

    def __missing__(self, word: str) -> int:
        folded = word.translate(_FOLD)
        for a, b in _PAIRS:
            folded = folded.replace(a, b)
        code = 0 if not any(c.isalpha() for c in word) else xxhash.xxh3_64_intdigest(folded.encode()) | 1
        if len(self) > 500_000:
            self.clear()
        self[word] = code
        return code


_WORDS = Words()


def folded_words(text: str) -> np.ndarray:
    """The hashes of a text's folded words, in order."""
    text = _JOIN.sub("", text.lower().replace("'", "").replace("’", "")) if "-" in text or "¬" in text else text.lower().replace("'", "").replace("’", "")
    words = _TOKEN.findall(text)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    return codes[codes != 0]


def shingles(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words by position; one run of all words where there are fewer."""
    n = max(1, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(codes))):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def banding(documents: int) -> tuple[int, int]:
    """Bands and rows for a collection: rows by its size, and as many bands as keep RECALL at LEAST_SIMILAR whatever the rows."""
    rows = ROWS
    while documents > DOCUMENTS * GROWTH ** (rows - ROWS):
        rows += 1
    equal, bands = LEAST_SIMILAR**rows, 2
    while (1 - equal) ** bands + bands * equal * (1 - equal) ** (bands - 1) > 1 - RECALL:
        bands += 1
    return bands, rows


class Circulant:
    """Two permutations of the ring: a hash takes shingles to places, ``order`` is the one that is shifted."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        order = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
        k = bands * rows
        self.n_bands, self.n_rows = bands, rows
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:k]]), k)
        self.mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, bands, np.int64).astype(np.uint64) | np.uint64(1)

    def signature(self, runs: np.ndarray) -> np.ndarray:
        at = ((runs * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        least = self.windows[at[0]].copy()
        for start in range(0, len(at), 4096):  # bounds the memory of a very long text
            np.minimum(least, self.windows[at[start : start + 4096]].min(axis=0), out=least)
        return least

    def bands(self, runs: np.ndarray) -> np.ndarray:
        rows = self.signature(runs).reshape(self.n_bands, self.n_rows).astype(np.uint64)
        key = self.mix.copy()
        for k in range(self.n_rows):
            key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


@functools.cache
def circulant(bands: int, rows: int) -> Circulant:
    return Circulant(bands, rows)


SIGNED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("class_key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sign(bands: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = circulant(bands, rows)
        for b in batches:
            codes = [folded_words(t) for t in b["_text"]]
            keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes() if len(x) else t.encode()) for x, t in zip(codes, b["_text"])], np.uint64)
            runs = [shingles(x) if len(x) else keys[k : k + 1] for k, x in enumerate(codes)]  # a text without words is like its equals only
            yield pd.DataFrame({"doc": b["doc"], "class_key": keys.view(np.int64), "bands": [c.bands(r) for r in runs]})

    return sign


def signed(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """doc, class_key, bands of every text of at least ``least_chars`` characters, cut from its lineage."""
    rows = df.where(F.length(text) >= max(1, least_chars)).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"))
    return cut(rows.mapInPandas(_sign(*banding(df.count())), SIGNED))


def coverage(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> float:
    """Share of a's words that stand in runs of ``size`` words which b has too."""
    runs = shingles(a, size)
    hit = np.isin(runs, shingles(b, size))
    if len(a) < size:
        return float(len(a) > 0 and hit[0])
    edges = np.zeros(len(a) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return float((np.cumsum(edges[:-1]) > 0).mean())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of the two texts' sets of shingles."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


PAIRS = "class_a long, class_b long, coverage double, jaccard double"


def _verify(share: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, np.ndarray] = {}
            rows = []
            for p, q, x, y in zip(b["class_a"], b["class_b"], b["text_a"], b["text_b"]):
                for t in (x, y):
                    if t not in known:
                        known[t] = folded_words(t)
                least = min(coverage(known[x], known[y]), coverage(known[y], known[x]))
                if least >= share:
                    rows.append((p, q, least, jaccard(known[x], known[y])))
            yield pd.DataFrame(rows, columns=["class_a", "class_b", "coverage", "jaccard"]).astype({"class_a": "int64", "class_b": "int64", "coverage": "float64", "jaccard": "float64"})

    return verify


def candidates(sign: DataFrame) -> DataFrame:
    """class_a < class_b: the pairs of classes that share at least two bands.

    Texts of one collection share stock phrases, so a single common band is mostly chance; of 48 bands of
    three a pair with a Jaccard similarity of 0.57 shares two in 99.8 % of cases, one of 0.7 always.
    The rows of one band are joined to one another by key. Copies are already one class, so a band's
    group holds different texts only; the engine splits a group that is still large over several tasks.
    """
    classes = sign.groupBy("class_key").agg(F.first("bands").alias("bands"))
    rows = classes.select("class_key", F.explode("bands").alias("band"))
    a, b = rows.withColumnRenamed("class_key", "class_a"), rows.withColumnRenamed("class_key", "class_b")
    return a.join(b, "band").where("class_a < class_b").groupBy("class_a", "class_b").agg(F.count("*").alias("_bands")).where("_bands >= 2").select("class_a", "class_b")


def class_pairs(df: DataFrame, key: str, text: str, sign: DataFrame, share: float = SHARED) -> DataFrame:
    """class_a < class_b, coverage (the lesser), jaccard: the verified pairs of different classes, cut from their lineage."""
    pairs = cut(candidates(sign))
    first = sign.groupBy("class_key").agg(F.min("doc").alias("doc"))
    wanted = pairs.select(F.col("class_a").alias("class_key")).union(pairs.select(F.col("class_b").alias("class_key"))).distinct()
    texts = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")).join(first.join(wanted, "class_key", "left_semi"), "doc").select("class_key", "_text")
    both = pairs.join(texts.select(F.col("class_key").alias("class_a"), F.col("_text").alias("text_a")), "class_a").join(texts.select(F.col("class_key").alias("class_b"), F.col("_text").alias("text_b")), "class_b")
    return cut(both.mapInPandas(_verify(share), PAIRS))


def near_duplicate_links(df: DataFrame, key: str, text: str, title: str, least_chars: int = 1, share: float = SHARED) -> DataFrame:
    """doc_id_a < doc_id_b, coverage, jaccard, same_title of every pair of different classes, by their least doc_ids.

    ``coverage`` is the lesser share of a text's words in runs the other has too, ``jaccard`` the exact
    similarity of the shingle sets; copies of one class have 1.0 with one another and no row here.
    Titles are compared folded; a null title is the same as none.
    """
    sign = signed(df, key, text, least_chars)
    links = class_pairs(df, key, text, sign, share)
    first = sign.groupBy("class_key").agg(F.min("doc").alias("doc"))
    folded = F.trim(F.regexp_replace(F.lower(F.col(title)), r"[^\p{L}\p{N}]+", " "))
    named = first.join(df.select(F.col(key).cast("long").alias("doc"), folded.alias("title")).groupBy("doc").agg(F.max("title").alias("title")), "doc")
    side = lambda x: named.select(F.col("class_key").alias(f"class_{x}"), F.col("doc").alias(f"_doc_{x}"), F.col("title").alias(f"_title_{x}"))
    rows = links.join(side("a"), "class_a").join(side("b"), "class_b")
    same = F.coalesce(F.col("_title_a") == F.col("_title_b"), F.lit(False))
    return rows.select(F.least("_doc_a", "_doc_b").alias("doc_id_a"), F.greatest("_doc_a", "_doc_b").alias("doc_id_b"), F.round("coverage", 6).alias("coverage"), F.round("jaccard", 6).alias("jaccard"), same.alias("same_title")).where("doc_id_a < doc_id_b")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, least_chars: int = 300, share: float = SHARED) -> DataFrame:
    """doc_id_a < doc_id_b of every pair of near-copies, members of one class included.

    A doc_id that comes with several texts is paired by each of them; every pair comes once.
    """
    sign = signed(df, key, text, least_chars)
    links = class_pairs(df, key, text, sign, share)
    member = sign.select("class_key", "doc").distinct()
    a, b = member.select(F.col("class_key").alias("class_a"), F.col("doc").alias("x")), member.select(F.col("class_key").alias("class_b"), F.col("doc").alias("y"))
    same = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    other = a.join(links, "class_a").join(b, "class_b").select("x", "y")
    pairs = same.unionByName(other).where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: str, least_chars: int = 1, share: float = SHARED) -> DataFrame:
    """One row per document: doc_id, group_id (least doc_id of its group), n_links (classes linked to its own), n_copies.

    A document without a text of ``least_chars`` characters is a group of its own.
    """
    sign = signed(df, key, text, least_chars)
    links = class_pairs(df, key, text, sign, share)
    degree = links.select(F.col("class_a").alias("class_key")).union(links.select(F.col("class_b").alias("class_key"))).groupBy("class_key").agg(F.count("*").alias("n_links"))
    classes = sign.groupBy("class_key").agg(F.count_distinct("doc").alias("n_copies"), F.min("doc").alias("_least"))
    label = components(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v"))).withColumnRenamed("node", "class_key")
    labelled = classes.join(label, "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
    group = labelled.groupBy("component").agg(F.min("_least").alias("group_id"))
    per_class = labelled.join(group, "component").join(degree, "class_key", "left").select("class_key", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    placed = sign.groupBy("doc").agg(F.min("class_key").alias("class_key")).join(per_class, "class_key")
    docs = df.select(F.col(key).cast("long").alias("doc")).distinct().join(placed, "doc", "left")
    return docs.select(F.col("doc").alias("doc_id"), F.coalesce("group_id", "doc").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
