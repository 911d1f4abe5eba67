"""Texts of stages measured against proofread ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import similarity as M
from leafmill.functions import text as X


def gold_scores(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """issue, stage, book, cer, wer, sub_share, hyp_chars, ref_chars, note for every stage of an issue and every gold text.

    ``texts`` has issue, stage, text; ``gold`` has issue, book, type, text. A gold text of type 'stories' is
    located in the stage's text first; where it isn't found, the note says so and the scores are null.
    Boilerplate of the gold text is removed. Texts and gold meet by issue, which has few of either.
    """
    ref = gold.select("issue", "book", "type", X.strip_boilerplate(F.col("text")).alias("_ref"))
    both = texts.select("issue", "stage", F.col("text").alias("_hay")).join(ref, "issue")
    both = both.withColumn("_hyp", F.when(F.col("type") == "stories", M.located(F.col("_hay"), F.col("_ref"))).otherwise(F.col("_hay")))
    h, r = X.norm_scoring(F.col("_hyp")), X.norm_scoring(F.col("_ref"))
    return both.withColumn("_h", h).withColumn("_r", r).select(
        "issue", "stage", "book",
        M.character_error_rate("_h", "_r").alias("cer"), M.word_error_rate("_h", "_r").alias("wer"), M.substitution_share("_h", "_r").alias("sub_share"),
        F.length("_h").alias("hyp_chars"), F.length("_r").alias("ref_chars"), F.when(F.col("_hyp").isNull(), "story not located").alias("note"),
    )
