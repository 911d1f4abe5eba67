"""Queries of the document-processing operators, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import similarity as M
from leafmill.functions import text as X
from leafmill.operators import assembly, heads, replay, reports, rules
from leafmill.plans.replay_sql import CLEAN_SQL, REPLAY_SQL
from leafmill.registry import Registry
from leafmill.session import cut, table
from leafmill.sources import files
from leafmill.streaming import logs

REGISTRY = Registry()

#: The printed lines of a page, regions in reading order; exact copies of a region count once.
PAGE_LINES_SQL = r"""
regions AS (SELECT DISTINCT issue, page, region_order, text FROM layout_regions WHERE text IS NOT NULL AND text <> ''),
page_texts AS (SELECT issue, page, string_agg(text, chr(10) ORDER BY region_order, text) AS text FROM regions GROUP BY issue, page),
page_lines AS (SELECT issue, page, n_lines, i AS line_no, parts[i] AS line FROM (SELECT issue, page, parts, len(parts) AS n_lines, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT issue, page, string_split(text, chr(10)) AS parts FROM page_texts)))
"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue, page, text: the regions of a page in reading order. A page is small, so is its group."""
    regions = table(spark, sf_dir, "layout_regions").select("issue", "page", "region_order", "text").where("text is not null and text <> ''")
    parts = F.array_sort(F.collect_set(F.struct("region_order", "text")))  # exact copies fall together in the one shuffle
    return regions.groupBy("issue", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.lines_of(page_texts(spark, sf_dir), ["issue", "page"])


@REGISTRY.add("running_heads", f"""
WITH {PAGE_LINES_SQL},
printed AS (SELECT issue, page, line_no, regexp_replace(regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\d+', '#', 'g'), '\\s+', ' ', 'g') AS head FROM page_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> ''),
edges AS (SELECT *, row_number() OVER (PARTITION BY issue, page ORDER BY line_no) AS t, row_number() OVER (PARTITION BY issue, page ORDER BY line_no DESC) AS b FROM printed),
hits AS (SELECT issue, head FROM edges WHERE t <= 2 UNION ALL SELECT issue, head FROM edges WHERE b <= 2),
pages AS (SELECT issue, count(DISTINCT page) AS pages FROM page_lines GROUP BY issue)
SELECT issue, head, count(*) AS n FROM hits JOIN pages USING (issue) WHERE length(head) < 80 GROUP BY issue, head, pages HAVING count(*) >= greatest(3, pages // 4)
""")  # fmt: skip
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.running_heads(page_lines(spark, sf_dir))


# ---- lines and rules ----
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: Rule R1 in SQL: capture groups stand in for the lookbehind that this dialect lacks.
NORM = (
    "regexp_replace(rtrim(replace(replace(replace(replace(replace(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(173), ''), chr(12), ''), "
    "' ' || chr(9) || chr(13)), '(\\S)[ \\t]+', '\\1 ', 'g')"
)
NORM_LINES_SQL = PAGE_LINES_SQL + f""",
norm AS (SELECT issue, page, line_no, n_lines, rtrim(line, ' ' || chr(9) || chr(13)) AS raw, {NORM.format('line')} AS line FROM page_lines),
scored AS (SELECT *, {STRIP.format('line')} AS s FROM norm),
measured AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[\\p{{L}}\\p{{N}} .,;:!?''"—–()\\-]', '', 'g')) AS bad, length(s) - length(regexp_replace(s, '\\p{{L}}', '', 'g')) AS letters FROM scored),
graded AS (SELECT *, CASE WHEN n = 0 THEN 0.0 WHEN n > 6 AND letters / n < 0.3 THEN greatest(bad / n, 0.9) ELSE bad / n END AS score FROM measured)
"""


@REGISTRY.add("split_lines", f"WITH {PAGE_LINES_SQL} SELECT issue, page, line_no, line FROM page_lines")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(spark, sf_dir).select("issue", "page", "line_no", "line")


@REGISTRY.add("norm_chars", f"WITH {NORM_LINES_SQL} SELECT issue, page, line_no, raw AS text_before, line AS text_after FROM norm WHERE raw <> line")
def norm_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.marked_lines(page_lines(spark, sf_dir))
    return marked.where("raw <> line").select("issue", "page", "line_no", F.col("raw").alias("text_before"), F.col("line").alias("text_after"))


@REGISTRY.add("garbage_score", f"WITH {NORM_LINES_SQL} SELECT issue, page, line_no, round(score, 4) AS score FROM graded WHERE score > 0")
def garbage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_lines(spark, sf_dir).withColumn("score", X.garbage_score(X.normalize_chars(F.col("line"))))
    return rows.where("score > 0").select("issue", "page", "line_no", F.round("score", 4).alias("score"))


@REGISTRY.add("garbage_drop", f"WITH {NORM_LINES_SQL} SELECT issue, page, line_no, line AS removed FROM graded WHERE score > 0.5 AND n > 2")
def garbage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.marked_lines(page_lines(spark, sf_dir)).where("rule = 'R2'").select("issue", "page", "line_no", F.col("line").alias("removed"))


@REGISTRY.add("change_log_noise", r"""
WITH t AS (SELECT DISTINCT change_id, removed, regexp_replace(removed, '^\s+|\s+$', '', 'g') AS s FROM change_log WHERE rule = 'R2' AND removed IS NOT NULL),
m AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[\p{L}\p{N} .,;:!?''"—–()\-]', '', 'g')) AS bad, length(s) - length(regexp_replace(s, '\p{L}', '', 'g')) AS letters FROM t)
SELECT change_id, round(CASE WHEN n = 0 THEN 0.0 WHEN n > 6 AND letters / n < 0.3 THEN greatest(bad / n, 0.9) ELSE bad / n END, 4) AS score FROM m
""")
def change_log_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "change_log").where("rule = 'R2' and removed is not null").select("change_id", "removed").distinct()
    return rows.select("change_id", F.round(X.garbage_score(F.col("removed")), 4).alias("score"))


@REGISTRY.add("head_keys", r"""
WITH t AS (SELECT issue, text FROM layout_regions WHERE label IN ('PageHeader', 'PageFooter') AND text IS NOT NULL AND text <> '')
SELECT issue, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\d+', '#', 'g'), '\s+', ' ', 'g') AS head, count(*) AS n FROM t GROUP BY ALL
""")
def head_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "layout_regions").where("label in ('PageHeader', 'PageFooter') and text is not null and text <> ''")
    return rows.groupBy("issue", heads.head_key(F.col("text")).alias("head")).agg(F.count("*").alias("n"))


@REGISTRY.add("drop_heads_folios", f"""
WITH {NORM_LINES_SQL},
printed AS (SELECT issue, page, line_no, regexp_replace(regexp_replace(lower({STRIP.format('line')}), '\\d+', '#', 'g'), '\\s+', ' ', 'g') AS head FROM page_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> ''),
edges AS (SELECT *, row_number() OVER (PARTITION BY issue, page ORDER BY line_no) AS t, row_number() OVER (PARTITION BY issue, page ORDER BY line_no DESC) AS b FROM printed),
hits AS (SELECT issue, head FROM edges WHERE t <= 2 UNION ALL SELECT issue, head FROM edges WHERE b <= 2),
pages AS (SELECT issue, count(DISTINCT page) AS pages FROM page_lines GROUP BY issue),
heads AS (SELECT issue, head FROM hits JOIN pages USING (issue) WHERE length(head) < 80 GROUP BY issue, head, pages HAVING count(*) >= greatest(3, pages // 4)),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(s), '\\d+', '#', 'g'), '\\s+', ' ', 'g') AS k FROM graded)
SELECT k.issue, page, line_no, line AS removed FROM keyed k LEFT JOIN heads h ON h.issue = k.issue AND h.head = k.k
WHERE n > 0 AND NOT (score > 0.5 AND n > 2) AND (line_no <= 2 OR line_no >= n_lines - 1) AND (h.head IS NOT NULL OR regexp_full_match(s, '\\d{{1,4}}'))
""")
def drop_heads_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.marked_lines(page_lines(spark, sf_dir)).where("rule = 'R3'").select("issue", "page", "line_no", F.col("line").alias("removed"))


#: Rule R4 as a walk: the lines that are not blank of an issue one after another over its pages, ``now`` being what the line before has left.
WALK_SQL = NORM_LINES_SQL + f""",
printed AS (SELECT issue, page, line_no, regexp_replace(regexp_replace(lower({STRIP.format('line')}), '\\d+', '#', 'g'), '\\s+', ' ', 'g') AS head FROM page_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> ''),
edges AS (SELECT *, row_number() OVER (PARTITION BY issue, page ORDER BY line_no) AS t, row_number() OVER (PARTITION BY issue, page ORDER BY line_no DESC) AS b FROM printed),
hits AS (SELECT issue, head FROM edges WHERE t <= 2 UNION ALL SELECT issue, head FROM edges WHERE b <= 2),
n_pages AS (SELECT issue, count(DISTINCT page) AS pages FROM page_lines GROUP BY issue),
heads AS (SELECT issue, head FROM hits JOIN n_pages USING (issue) WHERE length(head) < 80 GROUP BY issue, head, pages HAVING count(*) >= greatest(3, pages // 4)),
ruled AS (SELECT g.*, CASE WHEN n = 0 THEN NULL WHEN score > 0.5 AND n > 2 THEN 'R2' WHEN (line_no <= 2 OR line_no >= n_lines - 1) AND (h.head IS NOT NULL OR regexp_full_match(s, '\\d{{1,4}}')) THEN 'R3' END AS rule
  FROM graded g LEFT JOIN heads h ON h.issue = g.issue AND h.head = regexp_replace(regexp_replace(lower(s), '\\d+', '#', 'g'), '\\s+', ' ', 'g')),
kept AS (SELECT issue, page, line_no, line, s FROM ruled WHERE rule IS NULL),
flow AS (SELECT issue, page, line_no, line, row_number() OVER (PARTITION BY issue ORDER BY page, line_no) AS k FROM kept WHERE s <> ''),
walk AS (
  SELECT issue, page, line_no, k, line AS now, CAST(NULL AS INTEGER) AS from_page, CAST(NULL AS BIGINT) AS from_line, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS VARCHAR) AS joined FROM flow WHERE k = 1
  UNION ALL
  SELECT issue, next_page, next_line, k + 1, CASE WHEN joins THEN ltrim(substr(after, length(taken) + 1)) ELSE line END, page, line_no, CASE WHEN joins THEN substr(now, 1, length(now) - 1) || taken ELSE now END,
    CASE WHEN joins THEN lft || '- + ' || regexp_extract(after, '^[A-Za-z]+') || ' -> ' || lft || taken END
  FROM (
    SELECT *, regexp_extract(after, '^[A-Za-z]+[^\\sA-Za-z]*') AS taken, coalesce(lft <> '' AND regexp_matches(after, '^[A-Za-z]') AND {{IS_WORD}}, false) AS joins
    FROM (SELECT w.*, x.line, x.page AS next_page, x.line_no AS next_line, ltrim(x.line) AS after, regexp_extract(now, '([A-Za-z]{{2,}})-$', 1) AS lft FROM walk w LEFT JOIN flow x ON x.issue = w.issue AND x.k = w.k + 1 WHERE w.page IS NOT NULL)
  )
),
joins AS (SELECT issue, from_page AS page, from_line AS line_no, done AS line, joined FROM walk WHERE k > 1)
"""
#: Whether two halves make a word: by its shape, or by the list of all words of the articles.
SHAPE_SQL = "regexp_full_match(lower(lft || regexp_extract(after, '^[A-Za-z]+')), '[a-z]{2,20}') AND regexp_matches(lower(lft || regexp_extract(after, '^[A-Za-z]+')), '[aeiouy]')"
LISTED_SQL = "listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM articles)"
MEMBER_SQL = "lower(lft || regexp_extract(after, '^[A-Za-z]+')) IN (SELECT word FROM fitting)"
#: Of the list the words that any line's end makes with the next line's beginning.
FITTING_SQL = "fitting AS MATERIALIZED (SELECT DISTINCT word FROM listed WHERE word IN (SELECT lower(regexp_extract(a.line, '([A-Za-z]{2,})-$', 1) || regexp_extract(ltrim(b.line), '^[A-Za-z]+')) FROM flow a JOIN flow b ON b.issue = a.issue AND b.k = a.k + 1))"
WALK_LISTED_SQL = LISTED_SQL + ", " + WALK_SQL.replace("{IS_WORD}", MEMBER_SQL).replace("\nwalk AS (", f"\n{FITTING_SQL},\nwalk AS (")
WALK_SQL = WALK_SQL.replace("{IS_WORD}", SHAPE_SQL)


@REGISTRY.add("dehyphenate", f"WITH RECURSIVE {WALK_SQL} SELECT issue, page, line_no, joined FROM joins WHERE joined IS NOT NULL")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.marked_lines(page_lines(spark, sf_dir))
    return rules.dehyphenated(marked.where("rule is null").select("issue", "page", "line_no", "line")).where("joined is not null").select("issue", "page", "line_no", "joined")


@REGISTRY.add("dehyphenate_listed", f"WITH RECURSIVE {WALK_LISTED_SQL} SELECT issue, page, line_no, joined FROM joins WHERE joined IS NOT NULL")
def dehyphenate_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule R4 where a list says what is a word: here all words of the articles."""
    marked = rules.marked_lines(page_lines(spark, sf_dir))
    return rules.dehyphenated(marked.where("rule is null").select("issue", "page", "line_no", "line"), _article_words(spark, sf_dir)).where("joined is not null").select("issue", "page", "line_no", "joined")


@REGISTRY.add("para_unwrap", r"""
WITH l AS (SELECT doc_id, i AS line_no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
v AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM s),
o AS (SELECT *, CASE WHEN s <> '' AND (coalesce(prev, '') = '' OR regexp_matches(line, '^\s{2,}') OR (starts_with(s, '"') AND coalesce(regexp_matches(prev, '[.!?]$'), false))) THEN 1 ELSE 0 END AS opens FROM v),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM o),
p AS (SELECT doc_id, para, string_agg(s, ' ' ORDER BY line_no) AS t FROM g WHERE s <> '' GROUP BY doc_id, para),
d AS (SELECT DISTINCT doc_id FROM l)
SELECT d.doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY para), '') AS text FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id
""")
def para_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.paragraphs(heads.lines_of(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


@REGISTRY.add("rules_full", f"""
WITH RECURSIVE {WALK_SQL},
l AS (SELECT issue, page, line_no, line FROM joins UNION ALL SELECT issue, page, line_no, '' FROM kept WHERE s = ''),
t AS (SELECT *, {STRIP.format('line')} AS s FROM l),
v AS (SELECT *, lag(s) OVER (PARTITION BY issue, page ORDER BY line_no) AS prev FROM t),
o AS (SELECT *, CASE WHEN s <> '' AND (coalesce(prev, '') = '' OR regexp_matches(line, '^\\s{{2,}}') OR (starts_with(s, '"') AND coalesce(regexp_matches(prev, '[.!?]$'), false))) THEN 1 ELSE 0 END AS opens FROM v),
g AS (SELECT *, sum(opens) OVER (PARTITION BY issue, page ORDER BY line_no) AS para FROM o),
p AS (SELECT issue, page, para, string_agg(s, ' ' ORDER BY line_no) AS t FROM g WHERE s <> '' GROUP BY ALL),
d AS (SELECT DISTINCT issue, page FROM page_lines)
SELECT d.issue, d.page, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY para), '') AS text FROM d LEFT JOIN p ON p.issue = d.issue AND p.page = d.page GROUP BY ALL
""")
def rules_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cleaned_pages(page_lines(spark, sf_dir))


@REGISTRY.add("change_log_full", f"""
WITH RECURSIVE {WALK_SQL}
SELECT issue, page, line_no, 'R1' AS rule, raw AS "before", line AS "after", NULL AS removed, NULL AS joined FROM norm WHERE raw <> line
UNION ALL SELECT issue, page, line_no, rule, NULL, NULL, line, NULL FROM ruled WHERE rule IS NOT NULL
UNION ALL SELECT issue, page, line_no, 'R4', NULL, NULL, NULL, joined FROM joins WHERE joined IS NOT NULL
""")
def change_log_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.change_log(page_lines(spark, sf_dir))


@REGISTRY.add("change_log_by_rule", "SELECT issue, stage, rule, count(*) AS n_changes, count(DISTINCT page) AS n_pages FROM change_log GROUP BY ALL")
def change_log_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "change_log").groupBy("issue", "stage", "rule").agg(F.count("*").alias("n_changes"), F.count_distinct("page").alias("n_pages"))


# ---- markup, labels, sources ----
@REGISTRY.add("html_to_text", r"""
WITH t AS (SELECT doc_id, '<p class="x">' || replace(replace(text, '&', '&amp;'), chr(10), '<br/>') || '</p><i>&mdash;&eacute;&#8217;&#x41;</i>' AS html FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&mdash;&eacute;&#8217;&#x41;', '—é’A'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS text FROM t
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts written as markup, with named and numbered entities, and read again."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    html = F.concat(F.lit('<p class="x">'), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("<br/>")), F.lit("</p><i>&mdash;&eacute;&#8217;&#x41;</i>"))
    return docs.select("doc_id", X.html_to_text(html).alias("text"))


#: Printed pages in one file of the round trips below.
FILE_PAGES = 10


@REGISTRY.add("hocr_pages", f"""
WITH {PAGE_LINES_SQL}
SELECT issue, page // {FILE_PAGES} AS file_no, CAST(row_number() OVER (PARTITION BY issue, page // {FILE_PAGES} ORDER BY page) AS INTEGER) AS page, text
FROM (SELECT issue, page, string_agg(trim(regexp_replace(line, '\\s+', ' ', 'g')), chr(10) ORDER BY line_no) AS text FROM page_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> '' GROUP BY issue, page)
""")
def hocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as positional markup, a span for each line and word, some in a file, and read again."""
    esc = F.replace(F.replace(F.replace(X.strip(F.col("line")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = F.concat(F.lit("<span class='ocr_line'><span class='ocrx_word'>"), F.regexp_replace(esc, r"\s+", "</span> <span class='ocrx_word'>"), F.lit("</span></span>"))
    lines = page_lines(spark, sf_dir).where(X.strip(F.col("line")) != "")
    pages = lines.groupBy("issue", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", words.alias("w")))), lambda l: l["w"]), "\n").alias("m"))
    file = F.to_json(F.struct("issue", F.floor(F.col("page") / FILE_PAGES).cast("int").alias("file_no")))
    written = pages.groupBy(file.alias("issue")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "m"))), lambda p: F.concat(F.lit("<div class='ocr_page'>"), p["m"], F.lit("</div>"))), "\n").alias("markup"))
    read = files.hocr_pages(written).withColumn("_f", F.from_json("issue", "issue string, file_no int"))
    return read.select("_f.issue", "_f.file_no", "page", "text")


@REGISTRY.add("form_feed_pages", f"""
SELECT issue, page // {FILE_PAGES} AS file_no, CAST(row_number() OVER (PARTITION BY issue, page // {FILE_PAGES} ORDER BY page) AS INTEGER) AS page, text FROM (SELECT DISTINCT issue, page, text FROM stage_pages WHERE stage = 'rules_routeA' AND text IS NOT NULL)
""")
def form_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written with form feeds between them, some in a file, and read again."""
    pages = table(spark, sf_dir, "stage_pages").where("stage = 'rules_routeA' and text is not null").select("issue", "page", "text").distinct()
    file = F.to_json(F.struct("issue", F.floor(F.col("page") / FILE_PAGES).cast("int").alias("file_no")))
    whole = pages.groupBy(file.alias("issue")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\f").alias("text"))
    read = files.form_feed_pages(whole).withColumn("_f", F.from_json("issue", "issue string, file_no int"))
    return read.select("_f.issue", "_f.file_no", "page", "text")


DROPPED = "('picture', 'figure', 'image', 'table', 'pageheader', 'pagefooter', 'caption', 'footnote', 'handwriting', 'equation', 'form')"


@REGISTRY.add("label_drop", f"""
WITH k AS (SELECT DISTINCT issue, page, region_order, text FROM layout_regions WHERE text IS NOT NULL AND text <> '' AND regexp_replace(lower(label), '[^a-z]', '', 'g') NOT IN {DROPPED})
SELECT issue, page, string_agg(text, chr(10) || chr(10) ORDER BY region_order, text) AS text FROM k GROUP BY issue, page
""")
def label_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.reading_text(table(spark, sf_dir, "layout_regions"))


@REGISTRY.add("strip_boilerplate", r"""
SELECT doc_id, regexp_replace(text, '(?i)\[(illustration|transcriber[^\]]*)\]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL
""")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts set between markers, and taken out again."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    framed = F.concat(F.lit("Front matter\n*** START OF THIS BOOK ***"), F.col("text"), F.lit("*** END OF THIS BOOK ***\nLicence"))
    return docs.select("doc_id", X.strip_boilerplate(framed).alias("text"))


@REGISTRY.add("strip_think", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", X.strip_think(F.concat(F.lit("<think>one\ntwo</think>"), F.col("text"), F.lit("\n<think></think>"))).alias("text"))


@REGISTRY.add("norm_scoring", r"""
SELECT issue, stage, page, regexp_replace(regexp_replace(lower(translate(text, '‘’“”—–', '''''""--')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM stage_pages WHERE text IS NOT NULL
""")
def norm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stage_pages").where("text is not null").select("issue", "stage", "page", X.norm_scoring(F.col("text")).alias("text"))


@REGISTRY.add("gold_books", """
SELECT id AS issue, gold.type AS type, unnest(coalesce(gold.pg_ebooks, CASE WHEN gold.pg_ebook IS NOT NULL THEN [gold.pg_ebook] END)) AS book FROM pilot_issues WHERE gold IS NOT NULL
""")
def gold_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.gold_books(table(spark, sf_dir, "pilot_issues"))


@REGISTRY.add("cover_months", r"""
SELECT strftime(strptime(substr(cover_date, 1, 7) || '-01', '%Y-%m-%d'), '%Y-%m') AS cover_month, count(*) AS n_issues FROM pilot_issues WHERE regexp_matches(cover_date, '^\d{4}-\d{2}') GROUP BY ALL
""")
def cover_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.to_date(F.concat(F.substring("cover_date", 1, 7), F.lit("-01"))), "yyyy-MM")
    return table(spark, sf_dir, "pilot_issues").where(F.col("cover_date").rlike(r"^\d{4}-\d{2}")).groupBy(month.alias("cover_month")).agg(F.count("*").alias("n_issues"))


@REGISTRY.add("issue_resume", """
SELECT DISTINCT s.issue, s.page FROM stage_pages s WHERE s.stage = 'rules_routeA' AND NOT EXISTS (SELECT 1 FROM stage_pages d WHERE d.stage = 'routeB' AND d.issue = s.issue AND d.page = s.page)
""")
def issue_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one stage that another has not written yet."""
    pages = table(spark, sf_dir, "stage_pages")
    return files.not_done(pages.where("stage = 'rules_routeA'").select("issue", "page").distinct(), pages.where("stage = 'routeB'"), ["issue", "page"])


@REGISTRY.add("issues_with_layout", "SELECT id FROM pilot_issues p WHERE EXISTS (SELECT 1 FROM layout_regions l WHERE l.issue = p.id)")
def issues_with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pilot_issues").join(table(spark, sf_dir, "layout_regions").select(F.col("issue").alias("id")), "id", "left_semi").select("id")


# ---- measures ----
@REGISTRY.add("chars_per_stage", "SELECT issue, stage, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_pages FROM stage_pages GROUP BY ALL")
def chars_per_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stage_pages").groupBy("issue", "stage").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_pages"))


@REGISTRY.add("dict_word_rate", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM articles),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
r AS (SELECT doc_id, round(sum(CASE WHEN w.word IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS rate FROM t LEFT JOIN w USING (word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(rate, 0.0) AS rate FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r USING (doc_id)
""")
def dict_word_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dictionary_rate(table(spark, sf_dir, "documents"), ["doc_id"], _article_words(spark, sf_dir))


def _article_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@REGISTRY.add("cer_lines", r"""
SELECT change_id, round(levenshtein(h, r) / greatest(1, length(r)), 4) AS cer FROM (SELECT DISTINCT change_id,
  regexp_replace(regexp_replace(lower(translate(text_after, '‘’“”—–', '''''""--')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS h, regexp_replace(regexp_replace(lower(translate(text_before, '‘’“”—–', '''''""--')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS r
  FROM change_log WHERE text_before IS NOT NULL AND text_after IS NOT NULL) WHERE regexp_full_match(h || r, '[\x00-\x7F]*')
""".replace("\\'", "'"))
def cer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors of the changed lines whose scoring form is ASCII, where bytes and characters agree; cer_other_lines has the rest."""
    return _cer(spark, sf_dir).where(F.col("plain")).drop("plain")


@REGISTRY.add("cer_other_lines")
def cer_other_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cer(spark, sf_dir).where(~F.col("plain")).drop("plain")


def _cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "change_log").where("text_before is not null and text_after is not null").select("change_id", X.norm_scoring(F.col("text_after")).alias("h"), X.norm_scoring(F.col("text_before")).alias("r")).distinct()
    return rows.select("change_id", M.character_error_rate("h", "r").alias("cer"), F.concat("h", "r").rlike(r"^[\x00-\x7F]*\z").alias("plain"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stage_pairs(table(spark, sf_dir, "stage_pages").distinct())


@REGISTRY.add("stage_lineage", """
SELECT a.issue, a.page, a.stage, b.stage AS source_stage, a.text <> b.text AS changed FROM (SELECT DISTINCT * FROM stage_pages) a JOIN (SELECT DISTINCT * FROM stage_pages) b
ON a.issue = b.issue AND a.page = b.page AND b.stage = CASE WHEN starts_with(a.stage, 'rules_') THEN substr(a.stage, 7) WHEN regexp_matches(a.stage, '^llm_[^_]*_.+') THEN 'rules_' || regexp_extract(a.stage, '^llm_[^_]*_(.+)$', 1) END
""")
def stage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("issue", "page", "stage", "source_stage", (F.col("text") != F.col("source_text")).alias("changed"))


@REGISTRY.add("wer_pages")
def wer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("issue", "page", "stage", M.word_error_rate(X.norm_scoring(F.col("text")), X.norm_scoring(F.col("source_text"))).alias("wer"))


@REGISTRY.add("sub_share")
def sub_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "change_log").where("text_before is not null and text_after is not null")
    return rows.select("change_id", M.substitution_share(F.col("text_after"), F.col("text_before")).alias("sub_share"))


@REGISTRY.add("guard_similarity")
def guard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("issue", "page", "stage", M.sequence_ratio(F.col("source_text"), F.col("text")).alias("similarity"))


@REGISTRY.add("guard_decision", """
SELECT stage, model, count(*) AS n, sum(CASE WHEN similarity >= 0.85 THEN 1 ELSE 0 END) AS n_above, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS n_accepted
FROM (SELECT DISTINCT issue, stage, page, model, similarity, accepted FROM page_meta WHERE similarity IS NOT NULL) GROUP BY ALL
""")
def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_meta").where("similarity is not null").select("issue", "stage", "page", "model", "similarity", "accepted").distinct()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("stage", "model").agg(F.count("*").alias("n"), one(F.col("similarity") >= 0.85).alias("n_above"), one(F.col("accepted")).alias("n_accepted"))


@REGISTRY.add("word_diff")
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).where("text <> source_text").select("issue", "page", "stage", F.explode(M.word_diff(F.col("source_text"), F.col("text"))).alias("d"))
    return rows.groupBy("stage", "d.tag").agg(F.count("*").alias("n"))


@REGISTRY.add("locate_exact", """
WITH a AS (SELECT article_id, issue, unnest(list_distinct(pages)) AS page, string_split(text, chr(10) || chr(10))[1] AS opening FROM articles WHERE text IS NOT NULL AND text <> ''),
p AS (SELECT DISTINCT issue, page, text FROM stage_pages WHERE stage = 'rules_routeA' AND text IS NOT NULL)
SELECT article_id, page, strpos(p.text, opening) AS start_at FROM a JOIN p USING (issue, page) WHERE strpos(p.text, opening) > 0
""")
def locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which of its pages, and where, counted from 1, an article's opening paragraph stands."""
    pages = table(spark, sf_dir, "stage_pages").where("stage = 'rules_routeA' and text is not null").select("issue", "page", F.col("text").alias("_page_text")).distinct()
    articles = table(spark, sf_dir, "articles").where("text is not null and text <> ''")
    openings = articles.select("article_id", "issue", F.explode(F.array_distinct("pages")).alias("page"), F.split("text", "\n\n")[0].alias("_opening"))
    found = openings.join(pages, ["issue", "page"]).select("article_id", "page", F.expr("instr(_page_text, _opening)").cast("long").alias("start_at"))
    return found.where("start_at > 0")


@REGISTRY.add("locate_fuzzy")
def locate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the long articles lie in their pages' text of the other reading, by probes."""
    articles = table(spark, sf_dir, "articles").where("length(text) >= 900")
    pages = table(spark, sf_dir, "stage_pages").where("stage = 'routeB'").select("issue", "page", "text").distinct()
    held = articles.select("article_id", "issue", "text", F.explode(F.array_distinct("pages")).alias("page")).join(pages.withColumnRenamed("text", "_p"), ["issue", "page"])
    hay = held.groupBy("article_id").agg(F.first("text").alias("ref"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_p"))), lambda p: p["_p"]), "\n").alias("hay"))
    found = hay.select("article_id", F.length("ref").alias("n_ref"), F.length(M.located(F.col("hay"), F.col("ref"))).alias("n_found"))
    return found.where("n_found is not null")


# ---- assembly ----
UNITS_SQL = r"""
u0 AS (SELECT DISTINCT issue, page, region_order, label, text FROM layout_regions WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> ''),
u1 AS (SELECT *, regexp_replace(lower(label), '[^a-z]', '', 'g') AS l, regexp_full_match(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\d{1,4}') AS folio FROM u0),
u2 AS (SELECT *, CASE WHEN l IN ('pageheader', 'pagefooter') OR folio THEN 'furniture' WHEN contains(lower(text), 'advertisement') OR (upper(text) = text AND lower(text) <> text AND contains(text, '$')) THEN 'ad' ELSE 'fragment' END AS kind FROM u1),
u3 AS (SELECT *, kind = 'fragment' AND l IN ('sectionheader', 'title') AS heads FROM u2),
u4 AS (SELECT *, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER (PARTITION BY issue, page ORDER BY region_order, text) AS fragment FROM u3),
u5 AS (SELECT *, CASE WHEN kind = 'fragment' THEN 'f' || CAST(CAST(fragment AS BIGINT) AS VARCHAR) ELSE 'r' || region_order END AS unit FROM u4),
u6 AS (SELECT *, min(region_order) OVER (PARTITION BY issue, page, unit) AS first_at FROM u5),
u7 AS (SELECT *, first_value(CASE WHEN kind = 'fragment' AND NOT heads AND region_order > first_at THEN trim(nullif(regexp_extract(text, '^\s*[Bb]y\s+([A-Z][\w. ]+)', 1), '')) END IGNORE NULLS)
    OVER (PARTITION BY issue, page, unit ORDER BY region_order, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS author FROM u6),
u8 AS (SELECT *, CASE WHEN kind = 'fragment' THEN first_value(CASE WHEN heads THEN substr(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], 1, 120) END IGNORE NULLS)
    OVER (PARTITION BY issue, page, unit ORDER BY region_order, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS title FROM u7),
units AS (SELECT issue, page, region_order, kind, title, author, dense_rank() OVER (PARTITION BY issue, page ORDER BY first_at, unit) - 1 AS unit_no, kind = 'fragment' AND fragment = 0 AS "continues" FROM u8)
"""
WORKS_SQL = UNITS_SQL + r""",
w0 AS (SELECT issue, page, unit_no, any_value(kind) AS kind, any_value("continues") AS cont FROM units WHERE kind <> 'furniture' GROUP BY issue, page, unit_no),
w1 AS (SELECT *, sum(CASE WHEN kind = 'fragment' AND NOT cont THEN 1 ELSE 0 END) OVER (PARTITION BY issue ORDER BY page, unit_no) AS n FROM w0),
works AS (SELECT issue, page, unit_no, kind, CASE WHEN kind = 'fragment' THEN 'w' || CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE 'ad' || page || '.' || unit_no END AS work_no FROM w1)
"""


@REGISTRY.add("pass_a_units", f'WITH {UNITS_SQL} SELECT issue, page, region_order, kind, unit_no, title, author, "continues" FROM units')
def pass_a_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.page_units(table(spark, sf_dir, "layout_regions"))


@REGISTRY.add("pass_b_stitch", f"WITH {WORKS_SQL} SELECT * FROM works")
def pass_b_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.stitched(assembly.page_units(table(spark, sf_dir, "layout_regions")))


@REGISTRY.add("work_records", f"""
WITH {WORKS_SQL},
sizes AS (SELECT issue, page, region_order, sum(length(text)) AS c FROM (SELECT DISTINCT issue, page, region_order, text FROM layout_regions WHERE text IS NOT NULL) GROUP BY ALL)
SELECT u.issue, work_no, CASE WHEN max(u.kind) = 'fragment' THEN 'story' ELSE 'ad' END AS art_type, arg_min_null(title, (u.page, u.unit_no, u.region_order)) AS title, arg_min_null(author, (u.page, u.unit_no, u.region_order)) AS author, list_sort(list_distinct(list(u.page))) AS pages, count(*) AS n_regions, CAST(sum(c) AS BIGINT) AS n_chars
FROM units u JOIN works w ON u.issue = w.issue AND u.page = w.page AND u.unit_no = w.unit_no JOIN sizes s ON s.issue = u.issue AND s.page = u.page AND s.region_order = u.region_order
WHERE u.kind <> 'furniture' GROUP BY u.issue, work_no
""")
def work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "layout_regions")
    units = assembly.page_units(regions)
    return assembly.work_records(regions, units, assembly.stitched(units))


@REGISTRY.add("article_records", f"""
WITH RECURSIVE {WORKS_SQL},
held AS (SELECT u.issue, w.work_no, u.page, u.unit_no, u.region_order, u.kind, u.title, u.author FROM units u JOIN works w ON u.issue = w.issue AND u.page = w.page AND u.unit_no = w.unit_no WHERE u.kind <> 'furniture'),
texts AS (SELECT DISTINCT issue, page, region_order, text FROM layout_regions WHERE text IS NOT NULL),
records AS (SELECT issue, work_no, CASE WHEN max(kind) = 'fragment' THEN 'story' ELSE 'ad' END AS art_type, arg_min_null(title, (page, unit_no, region_order)) AS title, arg_min_null(author, (page, unit_no, region_order)) AS author,
  list_sort(list_distinct(list(page))) AS pages, min((page, unit_no)) AS first_at FROM held GROUP BY ALL),
numbered AS (SELECT *, issue || '_a' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS article_id FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY first_at) AS k FROM records)),
raws AS (SELECT h.issue, n.article_id, string_agg(t.text, chr(10) ORDER BY h.page, h.unit_no, h.region_order, t.text) AS raw FROM held h JOIN texts t ON t.issue = h.issue AND t.page = h.page AND t.region_order = h.region_order JOIN numbered n ON n.issue = h.issue AND n.work_no = h.work_no GROUP BY ALL),
{CLEAN_SQL}
SELECT n.issue, n.article_id, art_type, title, author, pages, text FROM numbered n JOIN cleaned c ON c.issue = n.issue AND c.article_id = n.article_id
""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles built from the layout alone: numbered, with pages and cleaned text."""
    regions = table(spark, sf_dir, "layout_regions")
    units = cut(assembly.page_units(regions))
    return assembly.article_records(regions, units, assembly.stitched(units))


ENTRIES_SQL = r"""
lines AS (SELECT doc_id AS issue, 0 AS page, i AS line_no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_type = 'toc' AND text IS NOT NULL))),
entries AS (SELECT issue, page, line_no, regexp_extract(line, '^\s*(.*?\S)\s*\.{3,}\s*(.*?)\s*(\d{1,4})\s*$', 1) AS title, nullif(regexp_extract(line, '^\s*(.*?\S)\s*\.{3,}\s*(.*?)\s*(\d{1,4})\s*$', 2), '') AS author,
CAST(regexp_extract(line, '^\s*(.*?\S)\s*\.{3,}\s*(.*?)\s*(\d{1,4})\s*$', 3) AS INTEGER) AS start_page FROM lines WHERE regexp_matches(line, '^\s*(.*?\S)\s*\.{3,}\s*(.*?)\s*(\d{1,4})\s*$'))
"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_type = 'toc'")
    return assembly.contents_entries(docs.select(F.col("doc_id").alias("issue"), F.lit(0).alias("page"), "text"))


@REGISTRY.add("contents_entries", f"WITH {ENTRIES_SQL} SELECT issue AS doc_id, line_no, title, author, start_page FROM entries")
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).drop("page").withColumnRenamed("issue", "doc_id")


@REGISTRY.add("contents_ranges", f"""
WITH {ENTRIES_SQL}, s AS (SELECT DISTINCT issue, title, start_page FROM entries), p AS (SELECT DISTINCT issue, start_page FROM s),
e AS (SELECT issue, start_page, lead(start_page) OVER (PARTITION BY issue ORDER BY start_page) - 1 AS end_page FROM p)
SELECT s.issue AS doc_id, title, start_page, end_page FROM s JOIN e USING (issue, start_page)
""")
def contents_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.contents_ranges(_contents(spark, sf_dir)).withColumnRenamed("issue", "doc_id")


@REGISTRY.add("folio_offsets", r"""
WITH f AS (SELECT DISTINCT issue, page, page - CAST(nullif(regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?:^|\s)[\[(-]?\s?(\d{1,4})\s?[\])-]?$', 1), '') AS INTEGER) AS scan_offset FROM layout_regions
WHERE regexp_replace(lower(label), '[^a-z]', '', 'g') IN ('pageheader', 'pagefooter')),
v AS (SELECT issue, scan_offset, count(*) AS n FROM f WHERE scan_offset IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, scan_offset) AS k FROM v)
SELECT issue, scan_offset, n AS n_pages FROM r WHERE k = 1
""")
def folio_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.folio_offsets(table(spark, sf_dir, "layout_regions"))


CLAIMS_SQL = """
fr AS (SELECT article_id, issue, unnest(fragments) AS f FROM articles),
claims AS (SELECT article_id, issue, f.page AS page, unnest(f.region_ids) AS region_order FROM fr)
"""


@REGISTRY.add("unclaimed_unsorted", f"""
WITH {CLAIMS_SQL}
SELECT DISTINCT issue, page, region_order, label FROM layout_regions l WHERE text IS NOT NULL AND text <> '' AND regexp_replace(lower(label), '[^a-z]', '', 'g') NOT IN {DROPPED}
AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.issue = l.issue AND c.page = l.page AND c.region_order = l.region_order)
""")
def unclaimed_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.unclaimed(table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "articles"))


@REGISTRY.add("double_claims", f"WITH {CLAIMS_SQL} SELECT issue, page, region_order, count(DISTINCT article_id) AS n_articles FROM claims GROUP BY ALL HAVING count(DISTINCT article_id) > 1")
def double_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.double_claims(table(spark, sf_dir, "articles"))


@REGISTRY.add("dedupe_regions", """
WITH f AS (SELECT article_id, issue, unnest(range(1, len(fragments) + 1)) - 1 AS fragment_no, unnest(fragments) AS f FROM articles),
c AS (SELECT article_id, issue, fragment_no, f.page AS page, unnest(range(1, len(f.region_ids) + 1)) - 1 AS region_no, unnest(f.region_ids) AS region_order FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id, issue, page, region_order ORDER BY fragment_no, region_no) AS k FROM c)
SELECT article_id, issue, page, region_order, fragment_no, region_no FROM r WHERE k = 1
""")
def dedupe_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.first_claims(table(spark, sf_dir, "articles")).select("article_id", "issue", "page", "region_order", F.col("at.f").alias("fragment_no"), F.col("at.r").alias("region_no"))


@REGISTRY.add("claimed_text_size", f"""
WITH {CLAIMS_SQL}, d AS (SELECT DISTINCT article_id, issue, page, region_order FROM claims),
r AS (SELECT DISTINCT issue, page, region_order, text FROM layout_regions WHERE text IS NOT NULL)
SELECT article_id, count(*) AS n_regions, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM d JOIN r USING (issue, page, region_order) GROUP BY article_id
""")
def claimed_text_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "layout_regions").where("text is not null").select("issue", "page", "region_order", "text").distinct()
    held = assembly.first_claims(table(spark, sf_dir, "articles")).join(regions, ["issue", "page", "region_order"])
    return held.groupBy("article_id").agg(F.count("*").alias("n_regions"), F.sum(F.length("text")).alias("n_chars"))


@REGISTRY.add("article_index", r"""
SELECT article_id, issue, CASE WHEN art_type IN ('story', 'serial_part', 'poem', 'feature', 'letters', 'toc', 'ad', 'other') THEN art_type ELSE 'other' END AS art_type, title, author,
list_min(pages) AS first_page, list_max(pages) AS last_page, len(list_distinct(pages)) AS n_pages, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS words FROM articles
""")
def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.article_index(table(spark, sf_dir, "articles"))


@REGISTRY.add("article_search", "SELECT article_id, title, author, art_type FROM articles WHERE (contains(lower(title), 'the') OR contains(lower(author), 'the')) AND coalesce(art_type, 'other') = 'story'")
def article_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.search(table(spark, sf_dir, "articles"), " THE ", "story").select("article_id", "title", "author", "art_type")


@REGISTRY.add("article_search_status", f"WITH RECURSIVE {REPLAY_SQL} SELECT article_id, title, author, art_type, status FROM replayed WHERE (contains(lower(title), 'the') OR contains(lower(author), 'the')) AND status = 'verified'")
def article_search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over the corrected articles, those alone that are verified."""
    rows = replay.replayed(table(spark, sf_dir, "articles"), table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "annotations"))
    return assembly.search(rows, "the", status="verified").select("article_id", "title", "author", "art_type", "status")


@REGISTRY.add("article_with_issue", "SELECT article_id, coalesce(p.magazine, a.issue) AS magazine, coalesce(p.cover_date, '') AS cover_date FROM articles a LEFT JOIN pilot_issues p ON p.id = a.issue")
def article_with_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "pilot_issues").select(F.col("id").alias("issue"), "magazine", "cover_date")
    return table(spark, sf_dir, "articles").join(issues, "issue", "left").select("article_id", F.coalesce("magazine", "issue").alias("magazine"), F.coalesce("cover_date", F.lit("")).alias("cover_date"))


@REGISTRY.add("opening_words", r"""
WITH w AS (SELECT article_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM articles)
SELECT article_id, array_to_string(w[1:12], ' ') AS first_words, array_to_string(w[greatest(1, len(w) - 11):], ' ') AS last_words FROM w
""")
def opening_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select("article_id", X.words_of(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.select("article_id", X.head_words(F.col("w"), 12).alias("first_words"), X.tail_words(F.col("w"), 12).alias("last_words"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.folded(table(spark, sf_dir, "articles"), table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "annotations"))


PAGES_AFTER = "CASE WHEN len(held_pages) > 0 THEN held_pages ELSE machine_pages END"


FURNITURE_SQL = r"""
t0 AS (SELECT DISTINCT issue, page, region_order, regexp_replace(lower(label), '[^a-z]', '', 'g') IN ('pageheader', 'pagefooter') OR regexp_full_match(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\d{1,4}') AS furniture
  FROM layout_regions WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> ''),
furn AS (SELECT issue, page, region_order FROM t0 WHERE furniture UNION SELECT issue, TRY_CAST(split_part(frag, ':', 1) AS INTEGER), TRY_CAST(split_part(frag, ':', 2) AS INTEGER) FROM annotations WHERE event_action = 'frag_furniture' AND regexp_full_match(frag, '\d+:\d+')),
uns AS (SELECT issue, page, region_order FROM t0 WHERE NOT coalesce(furniture, false) EXCEPT SELECT issue, page, region_order FROM claims)
"""


@REGISTRY.add("box_map", f"""
WITH RECURSIVE {REPLAY_SQL}, {CLAIMS_SQL}, {FURNITURE_SQL},
boxes AS (SELECT issue, page, region_order, row_number() OVER (PARTITION BY issue, page ORDER BY region_order) - 1 AS i FROM (SELECT DISTINCT issue, page, region_order FROM layout_regions)),
own AS (SELECT issue, frag, arg_min(article_id, ord) AS owner FROM (SELECT issue, article_id, ord, unnest(frags) AS frag FROM replayed) GROUP BY ALL)
SELECT b.issue, b.page, b.region_order, b.page || CASE WHEN i < 26 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(i + 1 AS INTEGER), 1) ELSE 'Z' || i END AS box, owner,
CASE WHEN owner IS NOT NULL THEN 'article' WHEN f.issue IS NOT NULL THEN 'furniture' WHEN u.issue IS NOT NULL THEN 'unsorted' ELSE 'unassigned' END AS kind
FROM boxes b LEFT JOIN own o ON o.issue = b.issue AND o.frag = b.page || ':' || b.region_order LEFT JOIN furn f ON f.issue = b.issue AND f.page = b.page AND f.region_order = b.region_order
LEFT JOIN uns u ON u.issue = b.issue AND u.page = b.page AND u.region_order = b.region_order
""")
def box_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, _folded(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str, done: DataFrame) -> DataFrame:
    """Boxes after all corrections: their articles, what machine or people call furniture, and what nothing claimed."""
    regions = table(spark, sf_dir, "layout_regions")
    units = assembly.page_units(regions)
    people = table(spark, sf_dir, "annotations").where(F.col("event_action") == "frag_furniture").where(F.col("frag").rlike(r"^\d+:\d+$"))
    people = people.select("issue", F.split_part("frag", F.lit(":"), F.lit(1)).try_cast("int").alias("page"), F.split_part("frag", F.lit(":"), F.lit(2)).try_cast("int").alias("region_order"))
    keys = ["issue", "page", "region_order"]
    unsorted = units.where("kind <> 'furniture'").select(*keys).join(assembly.claims(table(spark, sf_dir, "articles")), keys, "left_anti")
    return assembly.box_map(regions, replay.owners(done), units.where("kind = 'furniture'").select(*keys).unionByName(people), unsorted)


@REGISTRY.add("coverage_check", f"""
WITH {CLAIMS_SQL}, p AS (SELECT DISTINCT issue, page FROM layout_regions), h AS (SELECT DISTINCT issue, page FROM claims)
SELECT p.issue, count(*) AS n_pages, sum(CASE WHEN h.page IS NOT NULL THEN 1 ELSE 0 END) AS n_covered FROM p LEFT JOIN h ON h.issue = p.issue AND h.page = p.page GROUP BY p.issue
""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.coverage(table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "articles"))


@REGISTRY.add("shared_pages", r"""
WITH s AS (SELECT issue, article_id, list_min(pages) AS f, list_max(pages) AS l FROM articles WHERE art_type = 'story' AND len(pages) > 0)
SELECT DISTINCT a.issue, a.l AS page, a.article_id AS earlier_id, b.article_id AS later_id FROM s a JOIN s b ON b.issue = a.issue AND b.f = a.l AND b.article_id <> a.article_id
WHERE a.f < a.l AND NOT EXISTS (SELECT 1 FROM layout_regions r WHERE r.issue = a.issue AND r.page = a.l AND regexp_matches(r.text, '^\s*[Bb]y\s+([A-Z][\w. ]+)'))
""")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.shared_pages(table(spark, sf_dir, "articles"), table(spark, sf_dir, "layout_regions"))


@REGISTRY.add("lost_in_span", f"""
WITH {CLAIMS_SQL}, s AS (SELECT issue, list_min(pages) AS f, list_max(pages) AS l FROM articles WHERE art_type = 'story' AND len(pages) > 0)
SELECT DISTINCT issue, page, region_order, label FROM layout_regions l WHERE text IS NOT NULL AND text <> '' AND regexp_replace(lower(label), '[^a-z]', '', 'g') NOT IN {DROPPED}
AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.issue = l.issue AND c.page = l.page AND c.region_order = l.region_order) AND EXISTS (SELECT 1 FROM s WHERE s.issue = l.issue AND l.page BETWEEN s.f AND s.l)
""")
def lost_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.lost_in_span(table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "articles"))


@REGISTRY.add("chapter_headings", f"""
WITH {UNITS_SQL}, f AS (SELECT issue, min((page, unit_no)) AS start_at FROM units WHERE kind = 'fragment' GROUP BY issue),
h AS (SELECT issue, page, unit_no, min(region_order) AS region_order, max(title) AS title, max(author) AS author FROM units WHERE kind = 'fragment' AND NOT "continues" GROUP BY ALL)
SELECT h.issue, page, region_order, CASE WHEN regexp_full_match(lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')), '(chapter\\s+)?([ivxlc]+|\\d+)\\.?') THEN 'chapter_number' ELSE 'chapter_title' END AS role
FROM h JOIN f ON f.issue = h.issue WHERE author IS NULL AND (page, unit_no) > start_at
""")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.chapter_headings(assembly.page_units(table(spark, sf_dir, "layout_regions")))


@REGISTRY.add("issue_census", "SELECT issue, count(*) AS n_articles, sum(CASE WHEN art_type = 'ad' THEN 1 ELSE 0 END) AS n_ads, count(DISTINCT art_type) AS n_types, count(title) AS n_titled, count(author) AS n_signed FROM articles GROUP BY issue")
def issue_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").groupBy("issue").agg(F.count("*").alias("n_articles"), F.count_if(F.col("art_type") == "ad").alias("n_ads"), F.count_distinct("art_type").alias("n_types"), F.count("title").alias("n_titled"), F.count("author").alias("n_signed"))


@REGISTRY.add("types_present", "SELECT count(*) AS n_articles, count(DISTINCT issue) AS n_issues, list_sort(list_distinct(list(coalesce(art_type, 'other')))) AS types FROM articles")
def types_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").agg(F.count("*").alias("n_articles"), F.count_distinct("issue").alias("n_issues"), F.sort_array(F.collect_set(F.coalesce("art_type", F.lit("other")))).alias("types"))


@REGISTRY.add("issue_documents", f"""
WITH RECURSIVE {REPLAY_SQL}, {CLAIMS_SQL}, {FURNITURE_SQL},
boxes AS (SELECT issue, page, region_order, row_number() OVER (PARTITION BY issue, page ORDER BY region_order) - 1 AS i FROM (SELECT DISTINCT issue, page, region_order FROM layout_regions)),
own AS (SELECT issue, frag, arg_min(article_id, ord) AS owner FROM (SELECT issue, article_id, ord, unnest(frags) AS frag FROM replayed) GROUP BY ALL),
map AS (SELECT b.issue, b.page, b.region_order, b.page || CASE WHEN i < 26 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(i + 1 AS INTEGER), 1) ELSE 'Z' || i END AS box, owner,
  CASE WHEN owner IS NOT NULL THEN 'article' WHEN f.issue IS NOT NULL THEN 'furniture' WHEN u.issue IS NOT NULL THEN 'unsorted' ELSE 'unassigned' END AS kind
  FROM boxes b LEFT JOIN own o ON o.issue = b.issue AND o.frag = b.page || ':' || b.region_order LEFT JOIN furn f ON f.issue = b.issue AND f.page = b.page AND f.region_order = b.region_order LEFT JOIN uns u ON u.issue = b.issue AND u.page = b.page AND u.region_order = b.region_order),
body AS (SELECT issue, article_id, unnest(range(1, len(frags) + 1)) AS k, unnest(frags) AS frag, edits, roles FROM replayed WHERE override IS NULL),
parts AS (SELECT b.issue, b.article_id, k, coalesce(edits[b.frag], CASE WHEN starts_with(b.frag, 'm:') THEN '' ELSE region_text END, '') AS t FROM body b LEFT JOIN reg r ON r.issue = b.issue AND r.frag = b.frag WHERE coalesce(roles[b.frag], '') NOT IN ('title', 'subtitle', 'author')),
raws AS (SELECT a.issue, a.article_id, coalesce(string_agg(t, chr(10) ORDER BY k), '') AS raw FROM replayed a LEFT JOIN parts p ON p.issue = a.issue AND p.article_id = a.article_id WHERE a.override IS NULL GROUP BY ALL),
{CLEAN_SQL},
texts AS (SELECT issue, article_id, text FROM cleaned UNION ALL SELECT issue, article_id, override FROM replayed WHERE override IS NOT NULL)
SELECT r.issue, 'article' AS part, r.article_id AS key, CAST(to_json({{'article_id': r.article_id, 'art_type': art_type, 'title': title, 'subtitle': subtitle, 'author': author, 'pages': {PAGES_AFTER}, 'fragments': array_to_string(frags, ','), 'status': status, 'users': array_to_string(users, ','), 'text': text}}) AS VARCHAR) AS doc
FROM replayed r JOIN texts t ON t.issue = r.issue AND t.article_id = r.article_id
UNION ALL SELECT issue, 'page', CAST(page AS VARCHAR), CAST(to_json(list({{'region_order': region_order, 'box': box, 'kind': kind, 'owner': owner}} ORDER BY region_order)) AS VARCHAR) FROM map GROUP BY issue, page
""")
def issue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue, part, key, doc: an issue's state as JSON documents, one an article (with its text) and one a page (its boxes)."""
    articles, regions, events = (table(spark, sf_dir, t) for t in ("articles", "layout_regions", "annotations"))
    done = _folded(spark, sf_dir)
    keep = {"ignoreNullFields": "false"}
    rows = replay.replayed(articles, regions, events, done).join(replay.final_texts(regions, events, done), ["issue", "article_id"])
    fields = ["article_id", "art_type", "title", "subtitle", "author", "pages", "fragments", "status", "users", "text"]
    texts = rows.select("issue", F.lit("article").alias("part"), F.col("article_id").alias("key"), F.to_json(F.struct(*fields), keep).alias("doc"))
    boxes = F.array_sort(F.collect_list(F.struct("region_order", "box", "kind", "owner")))
    pages = _boxes(spark, sf_dir, done).groupBy("issue", "page").agg(boxes.alias("b")).select("issue", F.lit("page").alias("part"), F.col("page").cast("string").alias("key"), F.to_json("b", keep).alias("doc"))
    return texts.unionByName(pages)


# ---- replay ----
@REGISTRY.add("replay_last_wins", """
SELECT article_id, arg_max(title, event_id) FILTER (title IS NOT NULL) AS title, arg_max(author, event_id) FILTER (author IS NOT NULL) AS author, arg_max(art_type, event_id) FILTER (art_type IS NOT NULL) AS art_type
FROM annotations WHERE event_action = 'set_meta' AND article_id IS NOT NULL GROUP BY article_id
""")
def replay_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.last_values(table(spark, sf_dir, "annotations"))


@REGISTRY.add("replay_texts", "SELECT article_id, coalesce(arg_max(coalesce(text, ''), event_id), '') AS text FROM annotations WHERE event_action = 'set_text' AND article_id IS NOT NULL GROUP BY article_id")
def replay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotations").where("event_action = 'set_text' and article_id is not null")
    return rows.groupBy("article_id").agg(F.max_by(F.coalesce("text", F.lit("")), "event_id").alias("text"))


@REGISTRY.add("replay_full", f"WITH RECURSIVE {REPLAY_SQL} SELECT issue, article_id, art_type, title, subtitle, author, {PAGES_AFTER} AS pages, array_to_string(frags, ',') AS fragments, status, verified_by, array_to_string(users, ',') AS users FROM replayed")
def replay_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(table(spark, sf_dir, "articles"), table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "annotations"))


@REGISTRY.add("replay_status", f"WITH RECURSIVE {REPLAY_SQL} SELECT issue, count(*) AS n_articles, sum(CASE WHEN status = 'verified' THEN 1 ELSE 0 END) AS n_verified, sum(CASE WHEN status = 'modified' THEN 1 ELSE 0 END) AS n_modified FROM replayed GROUP BY issue")
def replay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each issue by status after all events."""
    return reports.status_counts(_folded(spark, sf_dir))


@REGISTRY.add("replay_roles", f"WITH RECURSIVE {REPLAY_SQL} SELECT article_id, title, subtitle, author, art_type FROM replayed WHERE n_changes > 0")
def replay_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, subtitle, author and type of the changed articles, as set or as taken from a region with that role."""
    done = _folded(spark, sf_dir)
    rows = replay.replayed(table(spark, sf_dir, "articles"), table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "annotations"), done)
    changed = done.where("n_changes > 0").select("issue", "article_id")
    return rows.join(changed, ["issue", "article_id"], "left_semi").select("article_id", "title", "subtitle", "author", "art_type")


@REGISTRY.add("final_texts", f"""
WITH RECURSIVE {REPLAY_SQL},
body AS (SELECT issue, article_id, unnest(range(1, len(frags) + 1)) AS k, unnest(frags) AS frag, edits, roles FROM replayed WHERE override IS NULL),
parts AS (SELECT b.issue, b.article_id, k, coalesce(edits[b.frag], CASE WHEN starts_with(b.frag, 'm:') THEN '' ELSE region_text END, '') AS t FROM body b LEFT JOIN reg r ON r.issue = b.issue AND r.frag = b.frag WHERE coalesce(roles[b.frag], '') NOT IN ('title', 'subtitle', 'author')),
raws AS (SELECT a.issue, a.article_id, coalesce(string_agg(t, chr(10) ORDER BY k), '') AS raw FROM replayed a LEFT JOIN parts p ON p.issue = a.issue AND p.article_id = a.article_id WHERE a.override IS NULL GROUP BY ALL),
{CLEAN_SQL}
SELECT issue, article_id, text FROM cleaned UNION ALL SELECT issue, article_id, override FROM replayed WHERE override IS NOT NULL
""")
def final_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.final_texts(table(spark, sf_dir, "layout_regions"), table(spark, sf_dir, "annotations"), _folded(spark, sf_dir))


@REGISTRY.add("modified_by", f"WITH RECURSIVE {REPLAY_SQL} SELECT article_id, array_to_string(users, ',') AS users, n_changes FROM replayed WHERE n_changes > 0")
def modified_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.touched_by(_folded(spark, sf_dir))


@REGISTRY.add("activity_top400", "SELECT event_id, ts, user_name, event_action, article_id, count(*) OVER () AS n_all FROM annotations ORDER BY ts DESC, event_id LIMIT 400")
def activity_top400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.newest(table(spark, sf_dir, "annotations"))


@REGISTRY.add("articles_of_events", r"SELECT event_id, nullif(regexp_extract(article_id, '^(.+)_[au]\d+$', 1), '') AS issue_of_id, issue FROM annotations WHERE article_id IS NOT NULL")
def articles_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotations").where("article_id is not null").select("event_id", X.issue_of_article(F.col("article_id")).alias("issue_of_id"), "issue")


@REGISTRY.add("late_events", "SELECT event_id, date_diff('second', CAST(ts AS TIMESTAMP), date_trunc('second', logged_at)) AS late_s FROM annotations WHERE date_diff('second', CAST(ts AS TIMESTAMP), date_trunc('second', logged_at)) > 3600")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.unix_timestamp(F.date_trunc("second", "logged_at").cast("timestamp")) - F.unix_timestamp(F.to_timestamp("ts"))
    return table(spark, sf_dir, "annotations").select("event_id", late.alias("late_s")).where("late_s > 3600")


# ---- reports ----
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_meta").distinct().groupBy("issue", "stage", "model").agg(F.count("latency_s").alias("pages"), F.sum("latency_s").alias("seconds")).withColumn("seq", F.xxhash64("model"))


RUNS_SQL = "runs AS (SELECT issue, stage, model, count(latency_s) AS pages, sum(latency_s) AS seconds FROM (SELECT DISTINCT * FROM page_meta) GROUP BY ALL)"


@REGISTRY.add("timing_rollup", f"""
WITH {RUNS_SQL}, a AS (SELECT stage, count(*) AS runs, CAST(sum(pages) AS BIGINT) AS pages, round(sum(coalesce(seconds, 0)), 4) AS seconds FROM runs GROUP BY stage)
SELECT *, CASE WHEN pages > 0 THEN round(seconds / pages, 10) END AS sec_per_page, CASE WHEN pages > 0 THEN CAST(round(nullif(seconds / pages, 0) * 1700000 / 3600) AS BIGINT) END AS projected_hours FROM a
""")
def timing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timing_rollup(_runs(spark, sf_dir))


@REGISTRY.add("issue_rates", """
WITH r AS (SELECT issue, stage, max(page) AS seq, model, count(latency_s) AS pages, sum(latency_s) AS seconds FROM (SELECT DISTINCT * FROM page_meta) GROUP BY ALL)
SELECT issue, stage, round(arg_max(seconds / pages, seq), 10) AS sec_per_page FROM r WHERE pages > 0 GROUP BY issue, stage
""")
def issue_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "page_meta").distinct().groupBy("issue", "stage", "model").agg(F.count("latency_s").alias("pages"), F.sum("latency_s").alias("seconds"), F.max("page").alias("seq"))
    return reports.last_rates(runs)


@REGISTRY.add("page_facts", """
WITH m AS (SELECT DISTINCT * FROM page_meta),
r0 AS (SELECT issue, stage, max(page) AS seq, model, count(latency_s) AS pages, sum(latency_s) AS seconds FROM m GROUP BY ALL),
r AS (SELECT issue, stage, round(arg_max(seconds / pages, seq), 10) AS s FROM r0 WHERE pages > 0 GROUP BY issue, stage)
SELECT m.issue, m.stage, m.page, m.model, round(coalesce(nullif(latency_s, 0), nullif(s, 0)), 10) AS seconds FROM m LEFT JOIN r USING (issue, stage)
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's latency, without one the rate of its issue's last run of the stage."""
    return reports.page_facts(table(spark, sf_dir, "page_meta").distinct(), issue_rates(spark, sf_dir))


@REGISTRY.add("failure_streaks", """
WITH m AS (SELECT issue, stage, page, max(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS f FROM page_meta GROUP BY ALL),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY issue, stage ORDER BY page) AS g FROM m)
SELECT issue, stage, min(page) AS first_page, max(page) AS last_page, count(*) AS n_failed FROM i WHERE f = 1 GROUP BY issue, stage, g
""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_streaks(table(spark, sf_dir, "page_meta"))


@REGISTRY.add("call_stats", """
SELECT stage, model, count(*) AS n_calls, count(error) AS n_failed, sum(CASE WHEN error IS NULL AND accepted = false THEN 1 ELSE 0 END) AS n_rejected, CAST(sum(i) AS BIGINT) AS in_tokens, CAST(sum(o) AS BIGINT) AS out_tokens
FROM (SELECT DISTINCT issue, stage, page, model, error, accepted, coalesce(in_tokens, prompt_tokens) AS i, coalesce(out_tokens, completion_tokens) AS o FROM page_meta) GROUP BY stage, model
""")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.call_stats(table(spark, sf_dir, "page_meta"))


@REGISTRY.add("next_open", f"""
WITH RECURSIVE {REPLAY_SQL}, o AS (SELECT issue, article_id, CASE WHEN status <> 'verified' THEN article_id END AS open_id FROM replayed)
SELECT issue, article_id, coalesce(min(open_id) OVER (PARTITION BY issue ORDER BY article_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(open_id) OVER (PARTITION BY issue)) AS next_id FROM o
""")
def next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _folded(spark, sf_dir)
    return reports.next_in_ring(done, done.where("status <> 'verified'"))


@REGISTRY.add("page_export", """
WITH p AS (SELECT issue, stage, page, max(text) AS text FROM stage_pages WHERE text IS NOT NULL GROUP BY ALL)
SELECT issue, stage, page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY issue, stage ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at, text FROM p
""")
def page_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_export(table(spark, sf_dir, "stage_pages"))


@REGISTRY.add("stages_present", """
WITH s AS (SELECT DISTINCT issue, stage FROM stage_pages)
SELECT issue, string_agg(stage, ',' ORDER BY coalesce(list_position(['routeA', 'rules_routeA', 'routeB'], stage), 4), stage) AS stages FROM s GROUP BY issue
""")
def stages_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stages_present(table(spark, sf_dir, "stage_pages"), ["routeA", "rules_routeA", "routeB"])


@REGISTRY.add("event_days", "SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@REGISTRY.add("user_sessions", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session_no, count(*) AS n_events FROM n GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600)
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"))
