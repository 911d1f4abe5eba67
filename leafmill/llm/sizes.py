"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut

#: Vocabulary file of the tokenizer; read on every executor, never copied.
TOKENIZER = os.environ.get("LEAFMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# --- fixed value: the pattern of the vocabulary's pre-tokens ---
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoding: dict = {}


def encoding(path: str):
    if path not in _encoding:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoding[path] = tiktoken.Encoding("leafmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def token_counts(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens: one row per distinct doc_id, cut from its lineage so texts are read once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": pd.array(token_counts(b["text"].tolist(), path), "int64")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInPandas(count, "doc_id long, source string, n_tokens long")
    return cut(counted.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens")))
