"""Layout regions to units, units to works, and the checks that nothing is lost or claimed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.heads import lines_of
from leafmill.operators.ranks import running_totals_by
from leafmill.operators.rules import article_texts

# --- fixed values: labels that are no reading text, and types of works ---
DROPPED_LABELS = ["picture", "figure", "image", "table", "pageheader", "pagefooter", "caption", "footnote", "handwriting", "equation", "form"]
WORK_TYPES = ["story", "serial_part", "poem", "feature", "letters", "toc", "ad", "other"]


def reading_text(regions: DataFrame) -> DataFrame:
    """issue, page, text: the regions that are reading text, in order, parted by blank lines. Copies count once."""
    kept = regions.where("text is not null and text <> ''").where(~X.normalize_label(F.col("label")).isin(DROPPED_LABELS)).select("issue", "page", "region_order", "text")
    parts = F.array_sort(F.collect_set(F.struct("region_order", "text")))
    return kept.groupBy("issue", "page").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n").alias("text"))


def page_units(regions: DataFrame) -> DataFrame:
    """issue, page, region_order, kind, unit_no, title, author, continues: the unit of every region with text.

    Furniture are headers, footers and bare folios; ads name themselves or are capitals with a price; a
    heading opens a fragment titled by its first line, what follows on the page belongs to it, and text
    before any heading continues an earlier page. The first by-line below a unit's first region names its
    author. Furniture and ads are units of one region.
    """
    w = Window.partitionBy("issue", "page").orderBy("region_order", "text")
    label, text = X.normalize_label(F.col("label")), F.col("text")
    rows = regions.where(X.strip(F.coalesce(text, F.lit(""))) != "").select("issue", "page", "region_order", "label", "text").distinct()
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    kind = (
        F.when(label.isin("pageheader", "pagefooter") | X.is_folio(text), "furniture")
        .when(F.lower(text).contains("advertisement") | (capitals & text.contains("$")), "ad")
        .otherwise("fragment")
    )
    rows = rows.withColumn("kind", kind).withColumn("_heads", (F.col("kind") == "fragment") & label.isin("sectionheader", "title"))
    fragment = F.sum(F.when(F.col("_heads"), 1).otherwise(0)).over(w)
    rows = rows.withColumn("_fragment", fragment).withColumn("_unit", F.when(F.col("kind") == "fragment", F.concat(F.lit("f"), "_fragment")).otherwise(F.concat(F.lit("r"), "region_order")))
    per = Window.partitionBy("issue", "page", "_unit")
    rows = rows.withColumn("_first", F.min("region_order").over(per))
    title = F.when(F.col("kind") == "fragment", F.first(F.when(F.col("_heads"), F.substring(F.split(X.strip(text), "\n")[0], 1, 120)), True).over(per))
    by_line = F.nullif(F.regexp_extract(text, r"^\s*[Bb]y\s+([A-Z][\w. ]+)", 1), F.lit(""))
    below = F.when((F.col("kind") == "fragment") & ~F.col("_heads") & (F.col("region_order") > F.col("_first")), F.trim(by_line))
    author = F.first(below, True).over(per.orderBy("region_order", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.dense_rank().over(Window.partitionBy("issue", "page").orderBy("_first", "_unit")) - 1
    return rows.select("issue", "page", "region_order", "kind", number.alias("unit_no"), title.alias("title"), author.alias("author"), ((F.col("kind") == "fragment") & (F.col("_fragment") == 0)).alias("continues"))


def stitched(units: DataFrame) -> DataFrame:
    """issue, page, unit_no, work_no: fragments joined over pages; an ad is a work of its own.

    A fragment that continues joins the nearest open work before it; ads do not close it. Works are
    numbered by a running count over one row per unit; the count runs over pages' sums first, so an
    issue of any size is one row per page where it is gathered.
    """
    per_unit = units.where("kind <> 'furniture'").groupBy("issue", "page", "unit_no").agg(F.first("kind").alias("kind"), F.first("continues").alias("continues"))
    page = Window.partitionBy("issue", "page").orderBy("unit_no")
    opens = F.when((F.col("kind") == "fragment") & ~F.col("continues"), 1).otherwise(0)
    rows = per_unit.withColumn("_opens", opens).withColumn("_within", F.sum("_opens").over(page))
    sums = rows.groupBy("issue", "page").agg(F.sum("_opens").alias("_sum"))
    pages = Window.partitionBy("issue").orderBy("page")
    before = sums.select("issue", "page", F.coalesce(F.sum("_sum").over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(before, ["issue", "page"])
    return rows.select("issue", "page", "unit_no", "kind", F.when(F.col("kind") == "fragment", F.concat(F.lit("w"), F.col("_before") + F.col("_within"))).otherwise(F.concat(F.lit("ad"), "page", F.lit("."), "unit_no")).alias("work_no"))


def work_records(regions: DataFrame, units: DataFrame, works: DataFrame) -> DataFrame:
    """issue, work_no, art_type, title, author, pages, n_regions, n_chars of every stitched work; title and author are its opener's."""
    rows = units.where("kind <> 'furniture'").join(works.drop("kind"), ["issue", "page", "unit_no"])
    sizes = regions.where("text is not null").select("issue", "page", "region_order", "text").distinct().groupBy("issue", "page", "region_order").agg(F.sum(F.length("text")).alias("_chars"))
    rows = rows.join(sizes, ["issue", "page", "region_order"])
    return rows.groupBy("issue", "work_no").agg(
        F.when(F.max(F.col("kind") == "ad"), "ad").otherwise("story").alias("art_type"),
        F.min_by(F.col("title"), F.struct("page", "unit_no", "region_order")).alias("title"),
        F.min_by(F.col("author"), F.struct("page", "unit_no", "region_order")).alias("author"),
        F.sort_array(F.collect_set("page")).alias("pages"),
        F.count("*").alias("n_regions"),
        F.sum("_chars").alias("n_chars"),
    )


def article_records(regions: DataFrame, units: DataFrame, works: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """issue, article_id, art_type, title, author, pages, text of every stitched work.

    Works are numbered by their first fragment; pages hand on one count each, so no issue is gathered. The
    text is that of the regions in order, cleaned as an article's. Title and author are the opener's.
    """
    records = work_records(regions, units, works)
    rows = units.where("kind <> 'furniture'").join(works.drop("kind"), ["issue", "page", "unit_no"])
    first = rows.groupBy("issue", "work_no").agg(F.min(F.struct("page", "unit_no")).alias("_at")).select("issue", "work_no", F.col("_at.page").alias("_page"), F.col("_at.unit_no").alias("_unit"))
    per_page = first.groupBy("issue", "_page").agg(F.count("*").alias("_n"))
    before = running_totals_by(per_page, ["issue"], "_page", {"_before": F.col("_n")}, 1000).select("issue", "_page", "_before")
    number = F.col("_before") + F.row_number().over(Window.partitionBy("issue", "_page").orderBy("_unit"))
    first = first.join(before, ["issue", "_page"]).select("issue", "work_no", X.numbered_id(F.col("issue"), "a", number.cast("int")).alias("article_id"))
    texts = regions.where("text is not null").select("issue", "page", "region_order", "text").distinct()
    parts = F.array_sort(F.collect_list(F.struct("page", "unit_no", "region_order", "text")))
    raw = rows.join(texts, ["issue", "page", "region_order"]).groupBy("issue", "work_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("raw"))
    cleaned = article_texts(raw, ["issue", "work_no"], "raw", words)
    return records.join(first, ["issue", "work_no"]).join(cleaned, ["issue", "work_no"]).select("issue", "article_id", "art_type", "title", "author", "pages", "text")


def claims(articles: DataFrame) -> DataFrame:
    """article_id, issue, page, region_order, at (fragment, region): every region an article claims, in its order."""
    rows = articles.select("article_id", "issue", F.posexplode("fragments").alias("_f", "fragment"))
    return rows.select("article_id", "issue", F.col("fragment.page").alias("page"), "_f", F.posexplode("fragment.region_ids").alias("_r", "region_order")).select(
        "article_id", "issue", "page", "region_order", F.struct(F.col("_f").alias("f"), F.col("_r").alias("r")).alias("at")
    )


def first_claims(articles: DataFrame) -> DataFrame:
    """claims with only the first copy of a region in an article."""
    return claims(articles).groupBy("article_id", "issue", "page", "region_order").agg(F.min("at").alias("at"))


def unclaimed(regions: DataFrame, articles: DataFrame) -> DataFrame:
    """issue, page, region_order, label: regions with text, furniture aside, that no article claims."""
    held = regions.where("text is not null and text <> ''").where(~X.normalize_label(F.col("label")).isin(DROPPED_LABELS)).select("issue", "page", "region_order", "label").distinct()
    return held.join(claims(articles), ["issue", "page", "region_order"], "left_anti")


def double_claims(articles: DataFrame) -> DataFrame:
    """issue, page, region_order, n_articles: regions that several articles claim."""
    return claims(articles).select("issue", "page", "region_order", "article_id").distinct().groupBy("issue", "page", "region_order").agg(F.count("*").alias("n_articles")).where("n_articles > 1")


def article_index(articles: DataFrame) -> DataFrame:
    """article_id, issue, art_type, title, author, first_page, last_page, n_pages, words."""
    known = F.when(F.col("art_type").isin(WORK_TYPES), F.col("art_type")).otherwise("other")
    pages = F.array_distinct("pages")
    return articles.select("article_id", "issue", known.alias("art_type"), "title", "author", F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"), F.size(pages).alias("n_pages"), F.size(X.words_of(F.coalesce("text", F.lit("")))).alias("words"))


def search(articles: DataFrame, text: str = "", art_type: str = "", status: str = "") -> DataFrame:
    """Articles whose title or author holds ``text``, whatever its case, of the given type and status; '' means any."""
    q = text.strip().lower()
    rows = articles
    if q:
        rows = rows.where(F.coalesce(F.lower("title").contains(q), F.lit(False)) | F.coalesce(F.lower("author").contains(q), F.lit(False)))
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.where(F.coalesce("art_type", F.lit("other")) == art_type) if art_type else rows


def box_map(regions: DataFrame, owners: DataFrame, furniture: DataFrame, unsorted: DataFrame) -> DataFrame:
    """issue, page, region_order, box, owner, kind: every region's short id and what it belongs to.

    The id is the page and a letter in reading order (Z and the number from the 27th on). The kind is the
    first that applies of article, furniture, unsorted, unassigned. ``owners`` has issue, page,
    region_order, owner with one row for a region; ``furniture`` and ``unsorted`` have the keys alone.
    """
    keys = ["issue", "page", "region_order"]
    w = Window.partitionBy("issue", "page").orderBy("region_order")
    boxes = regions.select(*keys).distinct().withColumn("_i", F.row_number().over(w) - 1)
    letter = F.when(F.col("_i") < 26, F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("_i") + 1, F.lit(1))).otherwise(F.concat(F.lit("Z"), "_i"))
    marked = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = boxes.join(owners.select(*keys, "owner"), keys, "left").join(marked(furniture, "_furniture"), keys, "left").join(marked(unsorted, "_unsorted"), keys, "left")
    kind = F.when(F.col("owner").isNotNull(), "article").when(F.col("_furniture"), "furniture").when(F.col("_unsorted"), "unsorted").otherwise("unassigned")
    return rows.select(*keys, F.concat(F.col("page"), letter).alias("box"), "owner", kind.alias("kind"))


def coverage(regions: DataFrame, articles: DataFrame) -> DataFrame:
    """issue, n_pages, n_covered: the pages of an issue, and those that hold a part of an article."""
    pages = regions.select("issue", "page").distinct()
    held = claims(articles).select("issue", "page").distinct().withColumn("_held", F.lit(1))
    return pages.join(held, ["issue", "page"], "left").groupBy("issue").agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("_held", F.lit(0))).alias("n_covered"))


BY_LINE = r"^\s*[Bb]y\s+([A-Z][\w. ]+)"


def shared_pages(articles: DataFrame, regions: DataFrame) -> DataFrame:
    """issue, page, earlier_id, later_id: stories of which one ends on the page where the other begins, with no by-line between them.

    Two such stories are one continuous text, so each row is a fault to review. Stories on one page only are no case.
    """
    stories = articles.where("art_type = 'story' and size(pages) > 0").select("issue", "article_id", F.array_min("pages").alias("_first"), F.array_max("pages").alias("_last"))
    ends = stories.where("_first < _last").select("issue", F.col("_last").alias("page"), F.col("article_id").alias("earlier_id"))
    begins = stories.select("issue", F.col("_first").alias("page"), F.col("article_id").alias("later_id"))
    signed = regions.where(F.col("text").rlike(BY_LINE)).select("issue", "page").distinct()
    return ends.join(begins, ["issue", "page"]).where("earlier_id <> later_id").join(signed, ["issue", "page"], "left_anti").distinct()


def lost_in_span(regions: DataFrame, articles: DataFrame) -> DataFrame:
    """issue, page, region_order, label: regions with text between a story's first and last page that belong to nothing."""
    stories = articles.where("art_type = 'story' and size(pages) > 0").select("issue", F.explode(F.sequence(F.array_min("pages"), F.array_max("pages"))).alias("page")).distinct()
    return unclaimed(regions, articles).join(stories, ["issue", "page"], "left_semi")


def chapter_headings(units: DataFrame) -> DataFrame:
    """issue, page, region_order, role of the headings that stay in an open story: no by-line below them, and a work before them.

    The role is chapter_number for a number, with or without the word, and chapter_title for any other.
    """
    fragments = units.where("kind = 'fragment'")
    first = fragments.groupBy("issue").agg(F.min(F.struct("page", "unit_no")).alias("_start"))
    heads = fragments.where("not continues").groupBy("issue", "page", "unit_no").agg(F.min("region_order").alias("region_order"), F.max("title").alias("title"), F.max("author").alias("author"))
    inside = heads.join(first, "issue").where(F.col("author").isNull() & (F.struct("page", "unit_no") > F.col("_start")))
    number = F.lower(X.strip(F.col("title"))).rlike(r"^(chapter\s+)?([ivxlc]+|\d+)\.?$")
    return inside.select("issue", "page", "region_order", F.when(number, "chapter_number").otherwise("chapter_title").alias("role"))


def contents_entries(pages: DataFrame) -> DataFrame:
    """issue, page, line_no, title, author, start_page: the entries of contents pages.

    An entry is a line of a title, leaders of three points or more, perhaps an author, and a page number.
    """
    rows = lines_of(pages, ["issue", "page"])
    entry = r"^\s*(.*?\S)\s*\.{3,}\s*(.*?)\s*(\d{1,4})\s*$"
    part = lambda k: F.regexp_extract("line", entry, k)
    return rows.where(F.col("line").rlike(entry)).select("issue", "page", "line_no", part(1).alias("title"), F.nullif(part(2), F.lit("")).alias("author"), part(3).cast("int").alias("start_page"))


def contents_ranges(entries: DataFrame) -> DataFrame:
    """issue, title, start_page, end_page: the printed pages from an entry to the next; the last one is open (null)."""
    starts = entries.select("issue", "title", "start_page").distinct()
    pages = starts.select("issue", "start_page").distinct()
    after = pages.select("issue", "start_page", (F.lead("start_page").over(Window.partitionBy("issue").orderBy("start_page")) - 1).alias("end_page"))
    return starts.join(after, ["issue", "start_page"]).select("issue", "title", "start_page", "end_page")


def folio_offsets(regions: DataFrame) -> DataFrame:
    """issue, scan_offset, n_pages: how far the scan's page numbers run ahead of the printed ones, by most folios.

    Of offsets with equally many pages the least.
    """
    folio = F.regexp_extract(X.strip(F.col("text")), r"(?:^|\s)[\[(-]?\s?(\d{1,4})\s?[\])-]?$", 1)
    seen = regions.where(X.normalize_label(F.col("label")).isin("pageheader", "pagefooter") & (folio != "")).select("issue", "page", (F.col("page") - folio.cast("int")).alias("scan_offset")).distinct()
    votes = seen.groupBy("issue", "scan_offset").agg(F.count("*").alias("n_pages"))
    return votes.groupBy("issue").agg(F.max_by("scan_offset", F.struct("n_pages", -F.col("scan_offset"))).alias("scan_offset"), F.max("n_pages").alias("n_pages"))


def claimable_span(boxes: DataFrame, issue: str, page: int, region_order: int, through: int, target: str, most_pages: int = 30) -> DataFrame:
    """The boxes (of box_map) that a claim takes: from one in reading order to the end of page ``through``.

    No further than ``most_pages`` pages on; furniture and what the target already owns are left out.
    """
    last = max(page, min(through, page + most_pages))
    after = (F.col("page") > page) | ((F.col("page") == page) & (F.col("region_order") >= region_order))
    return boxes.where((F.col("issue") == issue) & after & (F.col("page") <= last)).where((F.col("kind") != "furniture") & ~F.col("owner").eqNullSafe(F.lit(target)))


def moved(order: list[str], frag: str, up: bool) -> list[str]:
    """A full order of fragments after one of them was moved a place up or down; unchanged at the ends."""
    if frag not in order:
        return list(order)
    at = order.index(frag)
    to = at - 1 if up else at + 1
    out = list(order)
    if 0 <= to < len(out):
        out[at], out[to] = out[to], out[at]
    return out
