"""Roll-ups over pages, stages, calls and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.ranks import running_totals_by

#: Pages of an issue that one task sorts.
PAGES = 1000


def timing_rollup(runs: DataFrame, pages: str = "pages", seconds: str = "seconds", corpus_pages: int = 1_700_000) -> DataFrame:
    """stage, runs, pages, seconds, sec_per_page, projected_hours: null pages and seconds count as 0; no pages, no rate.

    The projection is the rate carried on to ``corpus_pages`` pages, in whole hours.
    """
    out = runs.groupBy("stage").agg(F.count("*").alias("runs"), F.sum(F.coalesce(pages, F.lit(0))).alias("pages"), F.round(F.sum(F.coalesce(seconds, F.lit(0.0))), 4).alias("seconds"))
    rate = F.when(F.col("pages") > 0, F.col("seconds") / F.col("pages"))
    return out.withColumn("sec_per_page", F.round(rate, 10)).withColumn("projected_hours", F.round(F.nullif(rate, F.lit(0.0)) * corpus_pages / 3600).cast("long"))


def last_rates(runs: DataFrame, order: str = "seq") -> DataFrame:
    """issue, stage, sec_per_page of the last run that had pages."""
    rated = runs.where("pages > 0")
    return rated.groupBy("issue", "stage").agg(F.round(F.max_by(F.col("seconds") / F.col("pages"), order), 10).alias("sec_per_page"))


def stages_present(pages: DataFrame, order: list[str]) -> DataFrame:
    """issue, stages: the stages an issue has, known ones in their order, others by name."""
    rows = pages.select("issue", "stage").distinct()
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("stage")), F.lit(0)), F.lit(len(order) + 1))
    return rows.groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "stage"))), lambda s: s["stage"]), ",").alias("stages"))


def stage_pairs(pages: DataFrame) -> DataFrame:
    """issue, page, stage, text, source_stage, source_text: each page beside the page it was made from."""
    made = pages.withColumn("source_stage", X.stage_input(F.col("stage"))).where("source_stage is not null")
    source = pages.select("issue", "page", F.col("stage").alias("source_stage"), F.col("text").alias("source_text"))
    return made.join(source, ["issue", "page", "source_stage"]).select("issue", "page", "stage", "text", "source_stage", "source_text")


def page_facts(meta: DataFrame, rates: DataFrame) -> DataFrame:
    """issue, stage, page, model, seconds: a page's own latency, else the rate of its issue and stage; 0 is no latency."""
    return meta.join(rates, ["issue", "stage"], "left").select("issue", "stage", "page", "model", F.round(F.coalesce(F.nullif("latency_s", F.lit(0.0)), F.nullif("sec_per_page", F.lit(0.0))), 10).alias("seconds"))


def failure_streaks(meta: DataFrame) -> DataFrame:
    """issue, stage, first_page, last_page, n_failed: runs of failed calls on following pages.

    An island is numbered by the calls that went well before it, a running total over chunks of pages,
    so the largest issue is no single sort.
    """
    rows = meta.where("issue is not null and stage is not null and page is not null").groupBy("issue", "stage", "page").agg(F.max(F.col("error").isNotNull()).alias("_failed"))
    rows = running_totals_by(rows, ["issue", "stage"], "page", {"_island": (~F.col("_failed")).cast("int")}, PAGES)
    return rows.where("_failed").groupBy("issue", "stage", "_island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_failed")).drop("_island")


def sessions(events: DataFrame, user: str, time: str, key: str, gap_seconds: int, span_seconds: int = 30 * 86400) -> DataFrame:
    """events with session_no (from 1 for each user): a session ends where nothing happens for longer than the gap.

    A task sorts one user's events of one span of time; over a user go one row a span (when it begins and
    ends) and one count. Events without a user or a time are left out. Equal times are one moment.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = events.where(F.col(user).isNotNull() & F.col(time).isNotNull()).withColumn("_at", seconds).withColumn("_span", F.floor(F.col("_at") / span_seconds))
    edges = rows.groupBy(user, "_span").agg(F.max("_at").alias("_last"))
    before = edges.select(user, "_span", F.lag("_last").over(Window.partitionBy(user).orderBy("_span")).alias("_before"))
    within = Window.partitionBy(user, "_span").orderBy("_at", key)
    rows = rows.join(before, [user, "_span"]).withColumn("_prev", F.coalesce(F.lag("_at").over(within), "_before"))
    rows = rows.withColumn("_starts", F.when(F.col("_at") - F.col("_prev") <= gap_seconds, 0).otherwise(1)).withColumn("_in", F.sum("_starts").over(within))
    sums = rows.groupBy(user, "_span").agg(F.sum("_starts").alias("_n"))
    earlier = sums.select(user, "_span", F.coalesce(F.sum("_n").over(Window.partitionBy(user).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return rows.join(earlier, [user, "_span"]).withColumn("session_no", F.col("_earlier") + F.col("_in")).drop("_at", "_span", "_before", "_prev", "_starts", "_in", "_earlier")


def call_stats(meta: DataFrame) -> DataFrame:
    """stage, model, n_calls, n_failed, n_rejected, in_tokens, out_tokens over distinct calls."""
    rows = meta.select("issue", "stage", "page", "model", "error", "accepted", F.coalesce("in_tokens", "prompt_tokens").alias("i"), F.coalesce("out_tokens", "completion_tokens").alias("o")).distinct()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("stage", "model").agg(F.count("*").alias("n_calls"), count(F.col("error").isNotNull()).alias("n_failed"), count(F.col("error").isNull() & (F.col("accepted") == F.lit(False))).alias("n_rejected"), F.sum("i").alias("in_tokens"), F.sum("o").alias("out_tokens"))


def next_in_ring(articles: DataFrame, open_only: DataFrame) -> DataFrame:
    """issue, article_id, next_id: for each article the next open one of its issue in order of id, round to the first.

    ``open_only`` has the open articles (issue, article_id). An article that is the only open one of its
    issue is its own next; an issue without open articles has null. Ids are sorted in blocks that share
    the issue and the first digit of the number; over an issue goes one row a block.
    """
    marked = articles.select("issue", "article_id").distinct().join(open_only.select("issue", "article_id").distinct().withColumn("_open", F.col("article_id")), ["issue", "article_id"], "left")
    marked = marked.withColumn("_block", F.left("article_id", F.length("issue") + 4))
    w = Window.partitionBy("issue", "_block").orderBy("article_id").rowsBetween(1, Window.unboundedFollowing)
    blocks = marked.groupBy("issue", "_block").agg(F.min("_open").alias("_first"))
    over = Window.partitionBy("issue")
    blocks = blocks.select("issue", "_block", F.min("_first").over(over.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)).alias("_later"), F.min("_first").over(over).alias("_least"))
    return marked.withColumn("_ahead", F.min("_open").over(w)).join(blocks, ["issue", "_block"]).select("issue", "article_id", F.coalesce("_ahead", "_later", "_least").alias("next_id"))


def newest_first(rows: DataFrame, order: str) -> DataFrame:
    """rows in reverse order of arrival: the last one first."""
    return rows.orderBy(F.desc(order))


def people_listed(users: DataFrame) -> DataFrame:
    """users (user_name, display_name, status) with those that wait for approval first, then by name; no status means active."""
    state = F.coalesce("status", F.lit("active"))
    return users.withColumn("status", state).orderBy(state != "pending", "user_name")


def with_display_names(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows (user_name) with shown_name: the account's display name, without one the user name itself."""
    names = users.where("display_name <> ''").groupBy("user_name").agg(F.max("display_name").alias("_shown"))
    return rows.join(names, "user_name", "left").withColumn("shown_name", F.coalesce("_shown", "user_name")).drop("_shown")


def status_counts(done: DataFrame) -> DataFrame:
    """issue, n_articles, n_verified, n_modified of replayed articles (issue, status)."""
    return done.groupBy("issue").agg(F.count("*").alias("n_articles"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if(F.col("status") == "modified").alias("n_modified"))


def page_export(pages: DataFrame) -> DataFrame:
    """issue, stage, page, start_at, text: the full text of a stage as its pages, with the place of each in the whole.

    The whole is the pages in order, parted by blank lines; ``start_at`` counts its characters from 0. A
    volume's text never stands in one row. Null texts are left out; of several texts of a page the greatest counts.
    """
    rows = pages.where("text is not null and issue is not null and stage is not null and page is not null").groupBy("issue", "stage", "page").agg(F.max("text").alias("text"))
    sizes = running_totals_by(rows.select("issue", "stage", "page", F.length("text").alias("_n")), ["issue", "stage"], "page", {"start_at": F.col("_n") + 2}, PAGES)
    return rows.join(sizes.drop("_n"), ["issue", "stage", "page"]).select("issue", "stage", "page", F.col("start_at").cast("long").alias("start_at"), "text")


def write_export(pages: DataFrame, path: str) -> None:
    """The full texts as text files in folders by issue and stage; the files' names and lines are in the order of the pages."""
    parts = page_export(pages).withColumn("part", F.floor(F.col("page") / PAGES))
    rows = parts.repartition("issue", "stage", "part").sortWithinPartitions("issue", "stage", "part", "page")
    rows.select("issue", "stage", "part", F.concat("text", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("issue", "stage", "part").text(path)


def dictionary_rate(texts: DataFrame, key: list[str], words: DataFrame) -> DataFrame:
    """key, rate: the share of a text's alphabetic words that the word list holds, 4 places; 0.0 without words.

    Words are counted per text first and joined by word to the list, so no list is sent anywhere whole.
    """
    tokens = texts.select(*key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("_n"))
    listed = words.select("word").distinct().withColumn("_listed", F.lit(1))
    share = tokens.join(listed, "word", "left").groupBy(*key).agg(F.round(F.sum(F.col("_n") * F.coalesce("_listed", F.lit(0))) / F.sum("_n"), 4).alias("rate"))
    return texts.select(*key).distinct().join(share, key, "left").select(*key, F.coalesce("rate", F.lit(0.0)).alias("rate"))
