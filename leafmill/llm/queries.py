"""Queries of the training-text problems, registered as pN_..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import abuse, confusables, mixing, names, neardup, packing, repetition, scans, sizes, truncation
from leafmill.llm import sql as S
from leafmill.registry import Registry
from leafmill.session import table

REGISTRY = Registry()


# ---- problem 1 ----
@REGISTRY.add("p1_found", S.P1_FOUND)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("record_key"), F.col("text").alias("_t"))
    issues = table(spark, sf_dir, "pilot_issues").select(F.lit("pilot_issues").alias("source_table"), F.col("id").alias("record_key"), F.col("magazine").alias("_t"))
    return docs.unionByName(issues).where(confusables.is_inconsistent(F.col("_t"), confusables.unicode_table(spark))).select("source_table", "record_key").distinct()


@REGISTRY.add("p1_skeleton_groups")
def p1_skeleton_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.skeleton_groups(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_key", "doc_id")


@REGISTRY.add("p1_issue_magazine")
def p1_issue_magazine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's magazine in one consistent form, with the number of issues of that magazine."""
    g = confusables.skeleton_groups(table(spark, sf_dir, "pilot_issues"), "id", "magazine")
    return g.select(F.col("row_key").alias("id"), F.col("consistent_text").alias("magazine"), F.col("class_size").alias("n_issues"))


# ---- problem 2 ----
@REGISTRY.add("p2_found", S.p2_found(neardup.GLYPH_CLASSES, neardup._PAIRS))
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p2_groups")
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p2_links")
def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of different texts, by the first document of each, with both measures; p2_groups has the members."""
    return neardup.near_duplicate_links(table(spark, sf_dir, "documents"), "doc_id", "text", "title")


# ---- problem 6 ----
@REGISTRY.add("p6_found", S.P6_FOUND)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_share(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("repeated_share") >= repetition.REPEATED).select("doc_id").distinct()


@REGISTRY.add("p6_repeated_share", S.P6_REPEATED_SHARE)
def p6_repeated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_share(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p6_line_frequency", S.P6_LINE_FREQUENCY)
def p6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.line_frequency(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


# ---- problem 9 ----
@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents")).where(F.col("score") >= abuse.CASE).select("doc_id").distinct()


@REGISTRY.add("p9_scores")
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"))


@REGISTRY.add("p9_rates")
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.rates(abuse.scores(docs), docs)


@REGISTRY.add("p9_review_agreement")
def p9_review_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.agreement(abuse.scores(table(spark, sf_dir, "documents")), table(spark, sf_dir, "review_labels"))


# ---- problem 4 ----
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.fields(table(spark, sf_dir, "articles"), "articles", "article_id").unionByName(names.fields(table(spark, sf_dir, "annotations"), "annotations", "event_id"))


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = names.links_of_records(_records(spark, sf_dir), table(spark, sf_dir, "name_authority"))
    return links.where("not exact").select("source_table", "record_key", "field", "entity_id").distinct()


@REGISTRY.add("p4_links")
def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.links_of_records(_records(spark, sf_dir), table(spark, sf_dir, "name_authority"))


# ---- problem 3 ----
def _cut_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_replies(table(spark, sf_dir, "page_meta"), table(spark, sf_dir, "stage_pages"))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_replies(spark, sf_dir).select("issue", "stage", "page").distinct()


@REGISTRY.add("p3_rates")
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf_dir, "page_meta"), _cut_replies(spark, sf_dir))


# ---- problem 5 ----
def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    null = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("record_key"), F.col("title"), "text")
    regions = table(spark, sf_dir, "layout_regions").where("label = 'Text'").select(F.lit("layout_regions").alias("source_table"), F.concat_ws("/", "issue", "page", "region_order").alias("record_key"), null.alias("title"), "text")
    joins = table(spark, sf_dir, "change_log").where("joined is not null").select(F.lit("change_log").alias("source_table"), F.col("change_id").cast("string").alias("record_key"), null.alias("title"), F.col("joined").alias("text"))
    return docs, regions, joins


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, regions, joins = _scanned(spark, sf_dir)
    forms, rare = scans.forms_of(docs.select("text").unionByName(regions.select("text")))
    heads, names = scans.heads_of(table(spark, sf_dir, "pilot_issues"))
    return scans.find_defects(docs.unionByName(regions).unionByName(joins), heads, forms, rare, names).distinct()


@REGISTRY.add("p5_paragraphs")
def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, record_key, text: documents and Text regions as continuous readable paragraphs, joined words put right."""
    docs, regions, joins = _scanned(spark, sf_dir)
    forms, rare = scans.forms_of(docs.select("text").unionByName(regions.select("text")))
    records = docs.unionByName(regions).distinct().withColumn("record_key", F.concat_ws("/", "source_table", "record_key"))  # one key over both tables
    heads, names = scans.heads_of(table(spark, sf_dir, "pilot_issues"))
    text = scans.reflow(scans.repaired_lines(records, heads, forms, rare, names))
    source = F.substring_index("record_key", "/", 1)
    paragraphs = text.select(source.alias("source_table"), F.expr("substr(record_key, instr(record_key, '/') + 1)").alias("record_key"), "text")
    return paragraphs.unionByName(scans.right_joins(joins.distinct(), forms, rare))


# ---- problem 7 ----
@REGISTRY.add("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sizes.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_specs"))


@REGISTRY.add("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pack_specs")
    return packing.fill_rates(packing.pack(sizes.sized(table(spark, sf_dir, "documents")), specs), specs)


@REGISTRY.add("p7_class_fill")
def p7_class_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill rates where every class fills containers of its own."""
    specs = table(spark, sf_dir, "pack_specs")
    return packing.fill_rates(packing.pack(sizes.sized(table(spark, sf_dir, "documents")), specs, by_class=True), specs)


# ---- problem 8 ----
@REGISTRY.add("p8_mixture")
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(sizes.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


@REGISTRY.add("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = sizes.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixture(sized, targets), sized, targets)
