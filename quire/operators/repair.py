"""Gates for proposed repairs of metadata and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.findings import PAGE_NUMBER, PROTECTED_TYPES

# Fixed values.
FIELDS = ("title", "creators", "year", "language", "doi")
HIGH_IMPACT = ("title", "creators", "year", "doi")
ACCEPTED = ("medium", "high")


def metadata_verdicts(changes: DataFrame, current: DataFrame, key: str = "paper_id") -> DataFrame:
    """Changes (key, field, new, confidence, evidence) with their verdict.

    The current records are (key, field, value, source, confidence).  Creators are a
    string of names; a valid year is a whole number from 1000 to 3000.
    """
    own = current.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("value").alias("old"), F.col("source").alias("_source"), F.col("confidence").alias("_confidence"))
    rows = changes.join(own, (F.col(key) == F.col("_k")) & (F.col("field") == F.col("_f")), "left")
    year = F.col("new").try_cast("int")
    valid = (F.coalesce("new", F.lit("")) != "") & ((F.col("field") != "year") | F.coalesce(year.between(1000, 3000), F.lit(False)))
    verdict = (
        F.when(~F.col("field").isin(*FIELDS), "unsupported")
        .when(~F.coalesce(F.col("confidence").isin(*ACCEPTED), F.lit(False)), "low-confidence")
        .when(F.col("field").isin(*HIGH_IMPACT) & (F.coalesce("evidence", F.lit("")) == ""), "no-evidence")
        .when((F.col("_source") == "user") & (F.col("_confidence") == "high"), "user-kept")
        .when(~valid, "invalid")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("accepted")
    )
    return rows.select(key, "field", "old", "new", "confidence", verdict.alias("verdict"))


def allows_empty(old: Column, reason: Column) -> Column:
    return F.lower(reason).rlike("header|footer|page") | T.strip(old).rlike(PAGE_NUMBER)


def patch_verdicts(patches: DataFrame, blocks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Patches (key, pos, block_id, old_text, new_text, confidence, reason) with their verdict."""
    own = blocks.select(F.col(key).alias("_k"), F.col("block_id").alias("_b"), "type", "text")
    rows = patches.join(own, (F.col(key) == F.col("_k")) & (F.col("block_id") == F.col("_b")), "left")
    old, new = F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))
    verdict = (
        F.when(F.col("_b").isNull(), "unknown_block_id")
        .when(~F.coalesce(F.col("confidence").isin(*ACCEPTED), F.lit(False)), "low_confidence")
        .when(old != F.col("text"), "old_text_mismatch")
        .when((new == "") & ~allows_empty(old, F.coalesce("reason", F.lit(""))), "empty_patch")
        .when(F.col("type").isin(*PROTECTED_TYPES) & (new != old), "protected_block")
        .otherwise("accepted")
    )
    return rows.select(key, "pos", "block_id", "new_text", verdict.alias("verdict"))


def patched(blocks: DataFrame, verdicts: DataFrame, key: str = "paper_id") -> DataFrame:
    """Blocks with the texts of accepted patches; of several for one block the first counts."""
    new = verdicts.where("verdict = 'accepted'").groupBy(key, "block_id").agg(F.min_by(F.coalesce("new_text", F.lit("")), "pos").alias("_new"))
    return blocks.join(new, [key, "block_id"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def upserted(current: DataFrame, verdicts: DataFrame, key: str = "paper_id") -> DataFrame:
    """Metadata fields with the accepted changes in, marked as coming from repair."""
    new = verdicts.where("verdict = 'accepted'").select(key, "field", F.col("new").alias("_v"), F.col("confidence").alias("_c"))
    rows = current.join(new, [key, "field"], "full_outer")
    changed = F.col("_v").isNotNull()
    return rows.select(key, "field", F.coalesce("_v", "value").alias("value"), F.when(changed, "repair").otherwise(F.col("source")).alias("source"), F.when(changed, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"))
