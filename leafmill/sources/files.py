"""Readers and writers for the files a page corpus is made of."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X

ISSUE = "id string, ia_identifier string, magazine string, cover_date string, genre string, format string, why string, gold struct<type: string, pg_ebook: bigint, pg_ebooks: array<bigint>, note: string>"
TIMING = "ts string, stage string, issue string, pages bigint, seconds double, src string, backend string, model string, route string, error string"
EVENT = "event_id bigint, ts string, user_name string, issue string, event_action string, article_id string, title string, author string, art_type string, text string, frag_order array<string>, frag string, to_id string, frag_role string, into_id string"
#: A page of OCR output, of the newer (blocks) and the older (text_lines) schema.
OCR_PAGE = "image_bbox array<double>, blocks array<struct<label: string, bbox: array<double>, html: string, text: string, confidence: double, skipped: boolean>>, text_lines array<struct<bbox: array<double>, text: string, confidence: double>>"


def issue_list(spark: SparkSession, path: str, require_approval: bool = False) -> DataFrame:
    """The issues of a config file, one row each. With ``require_approval`` an unapproved file is an error."""
    issue = ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in re.split(r", (?=\w+ )", ISSUE)))
    config = spark.read.option("multiLine", True).schema(f"approved boolean, issues array<struct<{issue}>>").json(path)
    if require_approval and config.where("coalesce(approved, false)").isEmpty():
        raise ValueError(f"{path} is not approved")
    return config.select(F.explode("issues").alias("i")).select("i.*")


def select_issues(issues: DataFrame, issue: str | None = None, everything: bool = False) -> DataFrame:
    """One issue or all of them; neither is an error."""
    if issue is not None:
        return issues.where(F.col("id") == issue)
    if not everything:
        raise ValueError("name an issue or ask for all")
    return issues


def gold_books(issues: DataFrame) -> DataFrame:
    """issue, type, book: every proofread book of an issue, from a single number or a list of them."""
    books = F.coalesce("gold.pg_ebooks", F.when(F.col("gold.pg_ebook").isNotNull(), F.array("gold.pg_ebook")))
    return issues.where("gold is not null").select(F.col("id").alias("issue"), F.col("gold.type").alias("type"), F.explode(books).alias("book"))


def json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a JSON-lines log, and its unreadable lines (line), which are kept for review."""
    lines = spark.read.text(path)
    rows = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value").where("trim(value) <> ''")
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.where(bad).select(F.col("value").alias("line"))


def form_feed_pages(texts: DataFrame, key: str = "issue", text: str = "text") -> DataFrame:
    """key, page from 1, text: the pages of texts whose pages are parted by form feeds. Null texts have none."""
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\f")).alias("_p", "text")).select(key, (F.col("_p") + 1).alias("page"), "text")


def page_at(texts: DataFrame, page: Column, key: str = "issue", text: str = "text", unsplit: str = "[no page boundaries]") -> DataFrame:
    """key, text of one page: ``unsplit`` for any page but the first of a text without boundaries, '' beyond the end."""
    pages = F.split(text, "\f")
    one = F.when((F.size(pages) == 1) & (page > 1), F.lit(unsplit)).when((page >= 1) & (page <= F.size(pages)), F.element_at(pages, F.greatest(F.lit(1), F.least(page, F.size(pages))))).otherwise("")
    return texts.select(key, one.alias("text"))


def with_fallback(pages: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """Pages of the split stage, and the raw text's pages of those issues that have none."""
    return pages.select("issue", "page", "text").unionByName(raw_pages.join(pages.select("issue").distinct(), "issue", "left_anti").select("issue", "page", "text"))


def pick_file(names: Column, suffixes: list[str]) -> Column:
    """The first name with the first suffix that any name has, whatever its case; null if none has."""

    def first(suffix: str) -> Column:
        return F.get(F.filter(names, lambda n: F.lower(n).endswith(suffix.lower())), F.lit(0))

    return F.coalesce(*map(first, suffixes))


class _Hocr(HTMLParser):
    """Lines of words by page. Character elements inside a word are joined without spaces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pages: list[list[list[str]]] = []
        self.line: list[str] | None = None
        self.glue = False
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kind = dict(attrs).get("class") or ""
        if "ocr_page" in kind:
            self.pages.append([])
            self.line = None  # text before the page's first line belongs to no line
        elif any(k in kind for k in ("ocr_line", "ocrx_line", "ocr_header", "ocr_textfloat", "ocr_caption")):
            if not self.pages:
                self.pages.append([])
            self.line = []
            self.pages[-1].append(self.line)
            self.fresh, self.glue = True, False
        elif "ocrx_word" in kind:
            self.fresh, self.glue = True, False
        elif "ocrx_cinfo" in kind:
            self.glue = True

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if self.line is None or not data:
            return
        if self.glue and not self.fresh and self.line:
            self.line[-1] += data
        else:
            self.line.append(data)
        self.fresh = False


def hocr_lines(markup: str | None) -> list[str]:
    """The text of each page of positional OCR markup; no page for null."""
    reader = _Hocr()
    reader.feed(markup or "")
    return ["\n".join(" ".join(words) for words in lines if words) for lines in reader.pages]


def hocr_pages(df: DataFrame, key: str = "issue", markup: str = "markup") -> DataFrame:
    """key, page from 1, text of positional OCR markup."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, text) for k, m in zip(b[key], b["_m"]) for n, text in enumerate(hocr_lines(m), 1)]
            yield pd.DataFrame(rows, columns=[key, "page", "text"]).astype({"page": "int32"})

    rows = df.select(F.col(key).cast("string").alias(key), F.col(markup).alias("_m"))
    return rows.mapInPandas(split, f"`{key}` string, page int, text string")


def ocr_regions(pages: DataFrame, ocr: str = "ocr") -> DataFrame:
    """issue, page, region_order, label, bbox, conf, text, lines of OCR pages of either schema.

    Skipped blocks are left out but keep their number; a page of neither schema is an error.
    """
    o = F.col(ocr)
    block = F.filter(
        F.transform(
            o["blocks"],
            lambda b, i: F.struct(
                F.coalesce(b["label"], F.lit("Text")).alias("label"), F.coalesce(b["bbox"], F.array(*[F.lit(0.0)] * 4)).alias("bbox"), i.alias("region_order"),
                F.round(F.coalesce(b["confidence"], F.lit(0.0)), 3).alias("conf"), F.coalesce(F.nullif(b["html"], F.lit("")), b["text"], F.lit("")).alias("text"), F.lit(True).alias("markup"),
                F.array().cast("array<struct<bbox:array<double>,text:string,conf:double>>").alias("lines"), F.coalesce(b["skipped"], F.lit(False)).alias("skipped"),
            ),
        ),
        lambda b: ~b["skipped"],
    )
    lines = F.transform(o["text_lines"], lambda t: F.struct(t["bbox"].alias("bbox"), F.coalesce(t["text"], F.lit("")).alias("text"), F.round(F.coalesce(t["confidence"], F.lit(0.0)), 3).alias("conf")))
    whole = F.array(
        F.struct(
            F.lit("Text").alias("label"), F.coalesce(o["image_bbox"], F.array(*[F.lit(0.0)] * 4)).alias("bbox"), F.lit(0).alias("region_order"), F.lit(0.0).alias("conf"),
            F.array_join(F.transform(lines, lambda t: t["text"]), "\n").alias("text"), F.lit(False).alias("markup"), lines.alias("lines"), F.lit(False).alias("skipped"),
        )
    )
    regions = F.when(o["blocks"].isNotNull(), block).when(o["text_lines"].isNotNull(), whole).otherwise(F.raise_error(F.lit("a page of no known schema")))
    rows = pages.select("issue", "page", F.explode(regions).alias("r")).select("issue", "page", "r.*")
    text = F.when(F.col("markup"), X.html_to_text(F.when(F.col("markup"), F.col("text")))).otherwise(F.col("text"))
    return rows.select("issue", "page", "region_order", "label", "bbox", "conf", text.alias("text"), "lines")


def number_pages(files: DataFrame) -> DataFrame:
    """issue, page, ocr: the pages of an issue's files (file, pages), numbered through in order of file name."""
    from pyspark.sql import Window

    rows = files.select("issue", "file", F.posexplode("pages").alias("_p", "ocr"))
    return rows.withColumn("page", F.row_number().over(Window.partitionBy("issue").orderBy("file", "_p"))).select("issue", "page", "ocr")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as a table by stage; a second run replaces the stages it brings."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines log."""
    rows.write.mode("append").json(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys were not written yet: what a run that was broken off still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def page_name(page: Column) -> Column:
    """page_0007: a page's file name without ending; numbers of more than four digits stay whole."""
    return F.format_string("page_%04d", page)


def parse_page_name(name: str) -> int | None:
    """The number in a page's file name."""
    m = re.match(r"page_(\d+)", name)
    return int(m[1]) if m else None


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, modified of the files of a folder, without reading them."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def word_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """word: the lower-case words of the first of the files that exists, one a line; no rows without any."""
    import os

    for path in paths:
        if os.path.exists(path):
            return spark.read.text(path).select(F.lower(X.strip(F.col("value"))).alias("word")).where("word <> ''").distinct()
    return spark.createDataFrame([], "word string")


def write_version(rows: DataFrame, path: str, version: str) -> None:
    """Rows as a version of a table: earlier versions stay as they are, and writing one again is an error."""
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version whose name is last."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*").withColumn("version", F.col("version").cast("string"))
    last = rows.agg(F.max("version").alias("v")).first().v
    return rows.where(F.col("version") == last).drop("version")
