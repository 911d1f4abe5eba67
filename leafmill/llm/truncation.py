"""Problem 3: replies that stopped before the page was complete.

Copies of one page are its stages' texts and the near-copies that stand under other keys, as in a bound
volume. The first meet by (issue, page), equal folded texts are taken as one class, every pair is verified
and aligned word by word, and the copy whose alignment ends early was cut, however little of it was kept.
The others meet by min-hash bands, for every text whose end no copy of its own page bears out; as another
printing may have other page breaks, such a copy must begin where the text begins, and what it has beyond
the text's end must not stand overleaf.
Where the cut text was not kept (accepted is false), no alignment can see it and the record itself tells:
its tokens stand at the limit of its model, or are as many fewer than the page needs as its similarity to
the page says; ``reason`` says for each row which it was. A text without any verified copy is scored by
its closing word: a text that ends within a sentence, on a word that rarely closes one, was cut.

A model's limit is its greatest number of tokens, if replies pile up there as they would not by chance.
Limits and tokens a character are statistics over all rows. Failed calls are left out. Null tokens,
similarities and texts leave the tests that need them undecided, which counts as not cut; exact
duplicate rows count once, and of several texts under one key any that ends early makes it cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import neardup
from leafmill.session import cut

#: Share of the longer copy's letters that must follow the end of the alignment.
MISSING = 0.025
#: A closing word that ends a sentence less often than this is no ending.
TERMINAL = 0.5
#: Share of a near-copy's letters that may stand before the text begins in it.
HEADROOM = 0.1
_WORDS = re.compile(r"\w+")


def rest_of(a: str, b: str, missing: float = MISSING) -> str:
    """What b has, in lower case, beyond a's end, if the alignment of a with its longer copy b ends well before b's end."""
    a, b = a.lower(), b.lower()
    x, y = list(_WORDS.finditer(a)), list(_WORDS.finditer(b))
    u, v = [m[0] for m in x], [m[0] for m in y]
    whole = sum(map(len, v))
    if len(u) < 4 or len(v) <= 4 or sum(map(len, u)) > whole * (1 - 0.8 * missing):
        return ""
    at: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(v) - 2):
        at.setdefault(tuple(v[k : k + 3]), []).append(k + 3)
    for back in range(0, len(u) - 2):  # the last words may be halves or misread
        end = len(u) - back
        places = at.get(tuple(u[end - 3 : end]))
        if places:
            stop = min(places, key=lambda p: abs(p - end))
            stop = min(len(v), stop + back)
            rest = sum(map(len, v[stop:]))
            return b[y[stop].start() :] if rest >= max(missing * whole, 3) else ""
    return ""


def ends_early(a: str, b: str, missing: float = MISSING) -> bool:
    """Whether the alignment of a with its longer copy b ends at a's end but well before b's."""
    return bool(rest_of(a, b, missing))


def stops_short(a: str, b: str, overleaf: list[str]) -> bool:
    """Whether a, a page's text, was cut by the witness of b, a near-copy under another key.

    a stands in b, both begin together, b goes on, and not with what a's printed page has ``overleaf``.
    """
    rest = rest_of(a, b)
    if not rest or neardup.coverage(neardup.folded_words(a), neardup.folded_words(b)) < neardup.SHARED or ends_early(a[::-1], b[::-1], HEADROOM):
        return False
    codes = neardup.folded_words(rest)
    size = min(neardup.SHINGLE, len(codes))
    return size > 0 and all(neardup.coverage(codes, neardup.folded_words(t), size) < neardup.SHARED for t in overleaf)


_LAST = re.compile(r"([^\W\d_]+)[\W\d_]*$")
_CLOSED = re.compile(r"[.!?][\"'”’)\]]*\s*$")
EVIDENCE = "issue string, page int, stage string, doc long, matched boolean, early boolean, sought boolean, n_chars int, word string, open_end boolean, bands array<long>"
KEYS = "issue string, stage string, page int"


def page_evidence(texts: list[str], codes: list[np.ndarray]) -> list[tuple[bool, bool, bool]]:
    """For each text of a page: whether another one is a verified copy, whether it ends before such a copy, whether one ends with it."""
    keys = [c.tobytes() if len(c) else t for c, t in zip(codes, texts)]
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    seen = {k: [keys.count(k) > 1, False, keys.count(k) > 1] for k in first}
    reps = sorted(first.values())
    for n, i in enumerate(reps):
        for j in reps[n + 1 :]:
            if max(neardup.coverage(codes[i], codes[j]), neardup.coverage(codes[j], codes[i])) >= neardup.SHARED:  # the shorter one stands in the longer
                a, b = seen[keys[i]], seen[keys[j]]
                a[0] = b[0] = True
                short, long = ends_early(texts[i], texts[j]), ends_early(texts[j], texts[i])
                a[1] |= short
                b[1] |= long
                if not short and not long:
                    a[2] = b[2] = True
    return [tuple(seen[k]) for k in keys]


def _compare(bands: int, rows: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signature = neardup.circulant(bands, rows)
        for b in batches:
            out = []
            for issue, page, copies in zip(b["issue"], b["page"], b["copies"]):
                texts = [c["text"] for c in copies]
                codes = [neardup.folded_words(t) for t in texts]
                signed = set()
                for c, code, (matched, early, held) in zip(copies, codes, page_evidence(texts, codes)):
                    last = _LAST.search(c["text"])
                    own = None  # a class of the page is signed once
                    if len(code) and code.tobytes() not in signed:
                        signed.add(code.tobytes())
                        own = signature.bands(neardup.shingles(code))
                    out.append((issue, page, c["stage"], c["doc"], matched, early, own is not None and not early and not held, len(c["text"]), last[1].lower() if last else "", _CLOSED.search(c["text"]) is None, own))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVIDENCE.split(", ")]).astype({"page": "Int32", "doc": "int64", "matched": bool, "early": bool, "sought": bool, "n_chars": "int32", "open_end": bool})

    return compare


def _witnessed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        short = [stops_short(t, other, [] if overleaf is None else list(overleaf)) for t, other, overleaf in zip(b["text"], b["other"], b["overleaf"])]
        yield b.loc[short, ["issue", "stage", "page"]]


def closing_words(pages: DataFrame) -> DataFrame:
    """word, terminality: the share of a word's uses that close a sentence. Counts are partial before the shuffle."""
    words = pages.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)([.!?]?)"), F.lit(0))).alias("_w"))
    letters = F.lower(F.regexp_extract("_w", r"^(\p{L}+)", 1))
    return words.groupBy(letters.alias("word")).agg(F.avg(F.when(F.col("_w").rlike(r"[.!?]$"), 1.0).otherwise(0.0)).alias("terminality"))


def cut_elsewhere(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """issue, stage, page of the texts that a near-copy under another key shows to be cut.

    Sought are only texts whose end no copy of their own page bears out, so a page that stands in many
    issues is compared with as many copies as such texts, not all with all. One common band is enough, as
    what is kept of a cut reply may be little; every candidate is verified.
    """
    bands = seen.where("bands is not null").select("issue", "page", "doc", "sought", F.explode("bands").alias("band"))
    mine = bands.where("sought and issue is not null and page is not null").select(F.col("issue").alias("_issue"), F.col("page").alias("_page"), F.col("doc").alias("doc_a"), "band")
    other_page = ~(F.col("issue").eqNullSafe(F.col("_issue")) & F.col("page").eqNullSafe(F.col("_page")))
    pairs = cut(mine.join(bands, "band").where(other_page).select("doc_a", F.col("doc").alias("doc_b")).distinct())
    texts = rows.select("issue", "stage", "page", "text", F.xxhash64("issue", "stage", "page", "text").alias("doc"))
    both = pairs.join(texts.withColumnRenamed("doc", "doc_a"), "doc_a").join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("other")), "doc_b")
    wanted = texts.withColumnRenamed("doc", "doc_a").join(pairs, "doc_a", "left_semi").select("issue", "page").distinct()
    after = rows.select("issue", (F.col("page") - 1).alias("page"), "text").join(wanted, ["issue", "page"], "left_semi").groupBy("issue", "page").agg(F.collect_set("text").alias("overleaf"))
    return both.join(after, ["issue", "page"], "left").select("issue", "stage", "page", "text", "other", "overleaf").mapInPandas(_witnessed, KEYS).distinct()


def text_evidence(pages: DataFrame) -> DataFrame:
    """issue, page, stage, matched, early, n_chars, word, open_end of every page with a text, cut from its lineage.

    A page has as many texts as stages; they are shuffled once, by page, compared and signed. Of the other
    texts only those go further that share a band with one whose end no copy of its own page bears out.
    """
    rows = pages.where("text is not null and text <> ''").select("issue", "stage", "page", "text")
    doc = F.xxhash64("issue", "stage", "page", "text").alias("doc")
    copies = rows.groupBy("issue", "page").agg(F.collect_set(F.struct("stage", "text", doc)).alias("copies"))  # exact copies fall together in the one shuffle
    seen = cut(copies.mapInPandas(_compare(*neardup.banding(pages.count())), EVIDENCE))
    per_key = seen.groupBy("issue", "page", "stage").agg(F.max("matched").alias("matched"), F.max("early").alias("early"), F.max("n_chars").alias("n_chars"), F.max_by("word", F.struct("open_end", "n_chars")).alias("word"), F.max("open_end").alias("open_end"))
    elsewhere = cut_elsewhere(rows, seen).withColumn("_short", F.lit(True))
    short = F.coalesce("_short", F.lit(False))
    out = per_key.join(elsewhere, ["issue", "stage", "page"], "left").withColumns({"matched": F.col("matched") | short, "early": F.col("early") | short})
    return cut(out.select("issue", "page", "stage", "matched", "early", "n_chars", "word", "open_end"))


def limits(calls: DataFrame, least: int = 3, times: float = 5.0) -> DataFrame:
    """stage, model, limit of the models whose replies pile up at their greatest number of tokens.

    Without a limit the greatest number would be about as frequent as any other near it: a limit needs
    ``least`` replies and ``times`` as many as a number in the tenth below it has on average.
    """
    counts = calls.where("tokens > 0").groupBy("stage", "model", "tokens").agg(F.count("*").alias("n"))
    top = counts.groupBy("stage", "model").agg(F.max_by("n", "tokens").alias("n_top"), F.max("tokens").alias("limit"))
    near = counts.join(top, ["stage", "model"]).where("tokens < limit and tokens >= 0.9 * limit").groupBy("stage", "model").agg(F.sum("n").alias("n_near"))
    average = F.coalesce("n_near", F.lit(0)) / F.greatest(F.lit(1.0), 0.1 * F.col("limit"))
    return top.join(near, ["stage", "model"], "left").where((F.col("n_top") >= least) & (F.col("n_top") >= times * average)).select("stage", "model", "limit")


def cut_replies(meta: DataFrame, pages: DataFrame, source_stage: str = "rules_routeA") -> DataFrame:
    """issue, stage, page, model, reason of every reply that was cut: 'alignment', 'limit', 'tokens' or 'closing word'."""
    keys = ["issue", "stage", "page"]
    calls = cut(meta.where("error is null").select(*keys, "model", "similarity", "accepted", F.coalesce("out_tokens", "completion_tokens").alias("tokens")).distinct())
    evidence = text_evidence(pages)
    source = evidence.where(F.col("stage") == source_stage).groupBy("issue", "page").agg(F.max("n_chars").alias("_chars"))
    seen = calls.join(evidence.drop("n_chars"), keys, "left").join(source, ["issue", "page"], "left")
    rate = F.col("tokens") / F.col("_chars")
    per_char = seen.where("coalesce(accepted, true) and tokens > 0 and _chars > 0").groupBy("stage", "model").agg(F.percentile_approx(rate, 0.5).alias("_rate"), (F.percentile_approx(rate, 0.9) / F.percentile_approx(rate, 0.5)).alias("_spread"))
    closing = closing_words(pages.select("stage", "issue", "page", "text").distinct())
    unmatched = seen.where("not coalesce(matched, true) and open_end").select("word").distinct()
    rare = closing.join(unmatched, "word", "left_semi").where(F.col("terminality") >= TERMINAL).select("word").withColumn("_closes", F.lit(True))
    rows = seen.join(limits(calls), ["stage", "model"], "left").join(per_char, ["stage", "model"], "left").join(rare, "word", "left")
    kept = F.col("tokens") / (F.col("_rate") * F.col("_chars"))
    at_limit = F.col("tokens") == F.col("limit")
    rejected = ~F.coalesce("accepted", F.lit(True))
    matched = F.coalesce("matched", F.lit(False))
    told = rejected & (F.col("_spread") < 1.15) & (kept < 0.97) & (F.abs(F.col("similarity") - 2 * kept / (1 + kept)) < 0.03)
    reason = (
        F.when(~rejected & F.coalesce("early", F.lit(False)), "alignment")
        .when(at_limit & (rejected | ~matched), "limit")
        .when(told, "tokens")
        .when(~rejected & F.col("matched").isNotNull() & ~matched & F.col("open_end") & F.col("_closes").isNull(), "closing word")
    )
    return rows.select(*keys, "model", reason.alias("reason")).where("reason is not null").distinct()


def cut_rates(meta: DataFrame, found: DataFrame) -> DataFrame:
    """stage, model, n_replies, n_cut, rate over the calls that did not fail."""
    calls = meta.where("error is null").select("issue", "stage", "page", "model").distinct()
    hit = found.select("issue", "stage", "page", "model").distinct().withColumn("_hit", F.lit(1))
    out = calls.join(hit, ["issue", "stage", "page", "model"], "left").groupBy("stage", "model").agg(F.count("*").alias("n_replies"), F.sum(F.coalesce("_hit", F.lit(0))).alias("n_cut"))
    return out.withColumn("rate", F.round(F.col("n_cut") / F.col("n_replies"), 6))
