"""Running heads: lines that come back at the edges of an issue's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip

def lines_of(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no from 1, line, n_lines. Null text has no lines, empty text one empty line."""
    parts = df.select(*keys, F.split(F.col(text), "\n").alias("_parts")).where("_parts is not null")
    return parts.select(*keys, F.size("_parts").alias("n_lines"), F.posexplode("_parts").alias("_at", "line")).select(*keys, (F.col("_at") + 1).alias("line_no"), "line", "n_lines")


def head_key(line: Column) -> Column:
    """Comparable form of a head: no case, digit runs as #, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(line)), r"\d+", "#"), r"\s+", " ")


def running_heads(lines: DataFrame, group: str = "issue", page: str = "page", least: int = 3, share: int = 4, longest: int = 80) -> DataFrame:
    """group, head, n: keys seen at least max(least, pages div share) times on page edges.

    The edges are the first and the last two lines that aren't blank; a page of fewer than four such
    lines counts a line at both ends. Pages are small, so the page windows are bounded; the count per
    group is pre-aggregated on the map side and no group is gathered in one task.
    """
    w = Window.partitionBy(group, page)
    printed = lines.where(strip(F.col("line")) != "")
    edges = printed.select(group, page, "line", F.row_number().over(w.orderBy("line_no")).alias("_top"), F.count("*").over(w).alias("_all"))
    edges = edges.withColumn("_bottom", F.col("_all") - F.col("_top") + 1)
    times = F.when(F.col("_top") <= 2, 1).otherwise(0) + F.when(F.col("_bottom") <= 2, 1).otherwise(0)
    counts = edges.withColumn("_times", times).where("_times > 0").groupBy(group, head_key(F.col("line")).alias("head")).agg(F.sum("_times").alias("n"))
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("_pages"))
    enough = F.greatest(F.lit(least), F.floor(F.col("_pages") / share))
    return counts.where(F.length("head") < longest).join(pages, group).where(F.col("n") >= enough).select(group, "head", F.col("n").cast("long").alias("n"))
