"""Line rules over pages: characters, noise, heads and folios, broken words, paragraphs; all of it logged.

Every rule has its change log, so lines kept, changed and removed add up to the input. Windows run over
a page, which is small; what passes from page to page goes over one row per page, so an issue with a
tenth of all pages is no bottleneck.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import heads
from leafmill.session import cut

KEYS = ["issue", "page"]


def marked_lines(lines: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """lines with ``raw`` (right-stripped), ``line`` (rule R1) and ``rule``: R2 noise, R3 head or folio, null kept.

    Null lines count as empty. Heads are those of ``heads.running_heads`` over the raw lines.
    """
    if running is None:
        running = heads.running_heads(lines)
    rows = lines.select(*KEYS, "line_no", "n_lines", F.regexp_replace("line", r"\s+$", "").alias("raw"), X.normalize_chars(F.col("line")).alias("line"))
    s = X.strip(F.col("line"))
    noise = (X.garbage_score(F.col("line")) > 0.5) & (F.length(s) > 2)
    edge = (F.col("line_no") <= 2) | (F.col("line_no") >= F.col("n_lines") - 1)
    known = running.select("issue", F.col("head").alias("_head")).withColumn("_known", F.lit(True))
    rows = rows.withColumn("_head", F.when(s != "", heads.head_key(F.col("line")))).join(known, ["issue", "_head"], "left")
    rule = F.when(s == "", None).when(noise, "R2").when(edge & (F.col("_known").isNotNull() | X.is_folio(F.col("line"))), "R3")
    return rows.select(*KEYS, "line_no", "n_lines", "raw", "line", rule.alias("rule"))


#: A broken word's two halves; the second takes the signs behind it along.
BROKEN, REST = r"([A-Za-z]{2,})-$", r"([A-Za-z]+)[^\sA-Za-z]*"
_LEFT, _RIGHT, _BLANKS, _WORDLIKE = re.compile(BROKEN), re.compile(REST), re.compile(r"(?<=\S)[ \t]+"), re.compile(r"(?=[a-z]*[aeiouy])[a-z]{2,20}")
_SIGNS = str.maketrans(X.LIGATURES)


def listed(joined: str, words: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """rows with ``name``: whether the word in column ``joined`` is in the list (column word); '' is in none."""
    known = words.select(F.lower("word").alias("_word")).where("_word <> ''").distinct().withColumn(name, F.lit(True))
    return rows.join(known, F.lower(joined) == F.col("_word"), "left").drop("_word").na.fill({name: False})


def walked(lines: list[str], before: str | None, after: str | None, fits: Callable[[str], bool]) -> list[tuple[str, str | None]]:
    """For each printed line of a page the line after rule R4 and the log's text, null where nothing was joined.

    ``before`` and ``after`` are the printed lines around the page. A line that gives its only word away
    is empty and has nothing left to join.
    """

    def halves(a: str | None, b: str | None) -> tuple[str, re.Match] | None:
        left, right = _LEFT.search(a or ""), _RIGHT.match((b or "").strip())
        return (left[1], right) if left and right and fits(left[1] + right[1]) else None

    out: list[tuple[str, str | None]] = []
    taken = halves(before, lines[0]) if lines else None
    for line, following in zip(lines, [*lines[1:], after]):
        rest = line if taken is None else line.strip()[taken[1].end() :].lstrip()
        taken = halves(rest, following)
        if taken is None:
            out.append((rest, None))
        else:
            left, right = taken
            out.append((rest[:-1] + right[0], f"{left}- + {right[1]} -> {left}{right[0]}"))
    return out


JOINED = "issue string, page int, line_no int, line string, joined string"


def dehyphenated(kept: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """issue, page, line_no, line (rule R4), joined (the log's text, null where nothing was joined).

    A line that ends in a broken word takes the first word of the next line that isn't blank, with the
    signs behind it, if the two make a word; the next page's first line counts as next. A line of one
    word that the line before has taken has nothing left to join; such chains are followed in a page.
    Two halves make a word where the list (``words``, column word) holds it, or without a list, or with an
    empty one, where it has the shape of one. A page is one row, and its neighbours hand on one line each.
    """
    rows = kept.where("issue is not null and page is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))).alias("_lines"))
    printed = kept.where(X.strip(F.col("line")) != "")
    edges = printed.groupBy(*KEYS).agg(F.min_by("line", "line_no").alias("_first"), F.max_by("line", "line_no").alias("_last"))
    pages = Window.partitionBy("issue").orderBy("page")  # two lines a page
    edges = edges.select(*KEYS, F.lag("_last").over(pages).alias("_before"), F.lead("_first").over(pages).alias("_after"))
    rows = rows.join(edges, KEYS, "left")
    by_list = words is not None and not words.where("word <> ''").isEmpty()
    good = F.lit(None).cast("array<string>").alias("_good")
    if by_list:
        rows = cut(rows)
        text = F.concat_ws("\n", F.col("_before"), F.array_join(F.filter(F.transform("_lines", lambda x: x["line"]), lambda x: X.strip(x) != ""), "\n"), F.col("_after"))
        halves = rows.select(*KEYS, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{2,}-\n\s*[A-Za-z]+"), F.lit(0))).alias("_pair"))
        found = listed("_w", words, halves.select(*KEYS, F.regexp_replace("_pair", r"-\s+", "").alias("_w")).distinct(), "_ok").where("_ok")
        rows = rows.join(found.groupBy(*KEYS).agg(F.collect_set(F.lower("_w")).alias("_good")), KEYS, "left")
        good = F.col("_good")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for issue, page, lines, before, after, held in zip(b["issue"], b["page"], b["_lines"], b["_before"], b["_after"], b["_good"]):
                fits = _member(held) if by_list else looks_whole
                there = [x for x in lines if x["line"].strip()]
                done = dict(zip((x["line_no"] for x in there), walked([x["line"] for x in there], before, after, fits)))
                out += [(issue, page, x["line_no"], *done.get(x["line_no"], ("", None))) for x in lines]
            yield pd.DataFrame(out, columns=["issue", "page", "line_no", "line", "joined"]).astype({"page": "int32", "line_no": "int32"})

    return rows.select(*KEYS, "_lines", "_before", "_after", good).mapInPandas(walk, JOINED)


def paragraphs(lines: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, text (rule R5): lines joined into paragraphs, paragraphs parted by a blank line.

    A paragraph starts after a blank line, at an indent of two, or at a quotation mark after a sentence's
    end. A page of blank lines has the text ''.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    s = X.strip(F.col("line"))
    rows = lines.select(*keys, "line_no", "line", s.alias("_s")).withColumn("_prev", F.lag("_s").over(w))
    fresh = F.coalesce(F.col("_prev"), F.lit("")) == ""
    opens = fresh | F.col("line").rlike(r"^\s{2,}") | (F.col("_s").startswith('"') & F.coalesce(F.col("_prev").rlike(r"[.!?]$"), F.lit(False)))
    rows = rows.withColumn("_para", F.sum(F.when((F.col("_s") != "") & opens, 1).otherwise(0)).over(w))
    rows = rows.withColumn("_new", F.coalesce(F.lag("_para").over(w) != F.col("_para"), F.lit(True)))
    pieces = F.array_sort(F.collect_list(F.when(F.col("_s") != "", F.struct("line_no", "_s", "_new"))))
    text = F.array_join(F.transform(F.col("_pieces"), lambda p: F.concat(F.when(p["_new"], "\n\n").otherwise(" "), p["_s"])), "")
    return rows.groupBy(*keys).agg(pieces.alias("_pieces")).select(*keys, F.regexp_replace(text, r"^\s+", "").alias("text"))


def joined_lines(lines: list[str], fits: Callable[[str], bool]) -> list[str]:
    """Lines with a word broken at a line's end made whole by the very next line, which loses it."""
    out: list[str] = []
    now: str | None = None
    for line in lines:
        left, right = _LEFT.search(now or ""), _RIGHT.match(line.lstrip())
        if left and right and fits(left[1] + right[1]):
            out.append(now[:-1] + right[0])
            now = line.lstrip()[right.end() :].lstrip()
        else:
            out += [] if now is None else [now]
            now = line
    return out if now is None else [*out, now]


def flowing_text(text: str | None, fits: Callable[[str], bool]) -> str:
    """A text in paragraphs: characters normalised, broken words joined, lines joined up to a blank one."""
    lines = [_BLANKS.sub(" ", x.translate(_SIGNS).rstrip()) for x in (text or "").split("\n")]
    runs = groupby((x.strip() for x in joined_lines(lines, fits)), bool)
    return "\n\n".join(" ".join(run) for printed, run in runs if printed)


def looks_whole(word: str) -> bool:
    return _WORDLIKE.fullmatch(word.lower()) is not None


def article_texts(df: DataFrame, keys: list[str], text: str, words: DataFrame | None = None) -> DataFrame:
    """keys, text: each row's text cleaned as an article. Null is ''.

    Only the very next line can end a broken word, and only a blank line ends a paragraph. With a word
    list (column word) the row's few candidates are looked up by a join and travel with the row; an
    empty list counts as none.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.col(text).alias("_raw"))
    if words is not None and not words.where("word <> ''").isEmpty():
        number = F.monotonically_increasing_id()
        rows = cut(rows.withColumn("_row", number))
        halves = rows.select("_row", F.explode(F.regexp_extract_all("_raw", F.lit(r"[A-Za-z]{2,}-[ \t]*\n\s*[A-Za-z]+"), F.lit(0))).alias("_pair"))
        found = listed("_w", words, halves.select("_row", F.regexp_replace("_pair", r"-\s+", "").alias("_w")).distinct(), "_ok").where("_ok")
        rows = rows.join(found.groupBy("_row").agg(F.collect_set(F.lower("_w")).alias("_good")), "_row", "left").drop("_row")
    else:
        rows = rows.withColumn("_good", F.lit(None).cast("array<string>"))
        words = None

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [_member(g) if by_list else looks_whole for g in b["_good"]]
            yield b[keys].assign(text=[flowing_text(t, f) for t, f in zip(b["_raw"], fits)])

    by_list = words is not None
    return rows.mapInPandas(clean, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string")


def _member(good) -> Callable[[str], bool]:
    held = frozenset(good) if good is not None else frozenset()
    return lambda w: w.lower() in held


def cleaned_pages(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """issue, page, text after all rules. A page whose lines were all removed has the text ''.

    The lines, and the lines with their marks, are read several times further on, so both are written
    once to the shared folder.
    """
    lines = cut(lines)
    marked = cut(marked_lines(lines))
    text = paragraphs(dehyphenated(marked.where("rule is null").select(*KEYS, "line_no", "line"), words))
    return lines.select(*KEYS).distinct().join(text, KEYS, "left").select(*KEYS, F.coalesce("text", F.lit("")).alias("text"))


def change_log(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """issue, page, line_no, rule, before, after, removed, joined: one row per change, sparse by rule."""
    marked = cut(marked_lines(cut(lines)))
    null = F.lit(None).cast("string")
    r1 = marked.where("line <> raw").select(*KEYS, "line_no", F.lit("R1").alias("rule"), F.col("raw").alias("before"), F.col("line").alias("after"), null.alias("removed"), null.alias("joined"))
    r23 = marked.where("rule is not null").select(*KEYS, "line_no", "rule", null.alias("before"), null.alias("after"), F.col("line").alias("removed"), null.alias("joined"))
    r4 = dehyphenated(marked.where("rule is null").select(*KEYS, "line_no", "line"), words).where("joined is not null").select(*KEYS, "line_no", F.lit("R4").alias("rule"), null.alias("before"), null.alias("after"), null.alias("removed"), "joined")
    return r1.unionByName(r23).unionByName(r4)
