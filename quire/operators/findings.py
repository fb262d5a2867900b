"""Suspicious blocks: reasons, policies, warning summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values.
PROTECTED_TYPES = ("formula", "table", "reference")
FRONT_MATTER = ("article", "open", "open access", "check for updates", "research article", "original article")
OCR_WORDS = ("Te", "Tere", "fssion", "diferent", "scientifc", "efciency", "frst", "simplifed")
PAGE_NUMBER = r"(?iU)\A(\d+|page\s+\d+)\z"
SPACED_LETTERS = r"(?U)(?<![A-Za-z])(?:[A-Za-z]\s+){3,}[A-Za-z](?![A-Za-z])"
SPACED_DIGITS = r"(?U)(?<!\d)(?:\d\s+){2,}\d(?!\d)"
SPACED_MATH = r"(?U)\$[^$]*(?:[A-Za-z0-9]\s+){2,}[A-Za-z0-9][^$]*\$"


def has_spaced_letters(t: Column) -> Column:
    return t.rlike(SPACED_LETTERS)


def has_spaced_digits(t: Column) -> Column:
    """Only texts with a digit are searched for them."""
    return t.rlike(r"\p{Nd}") & t.rlike(SPACED_DIGITS)


def is_math_heavy(kind: Column, t: Column) -> Column:
    marks = F.length(t) - F.length(F.translate(t, "$\\_^{}", ""))
    inline = t.rlike(SPACED_MATH)
    return kind.isin(*PROTECTED_TYPES) | (t.rlike(r"[$\\_^]") & ((marks >= 8) | inline))


def has_ocr_word(t: Column) -> Column:
    """Only texts that contain one of the words anywhere are searched for it as a word."""
    some = reduce(Column.__or__, [t.contains(w) for w in OCR_WORDS])
    return some & t.rlike(r"(?U)(^|[^\p{L}\p{N}_])(" + "|".join(OCR_WORDS) + r")($|[^\p{L}\p{N}_])")


def has_repeated_phrase(words: Column) -> Column:
    """Whether some run of four to eight words stands twice, one after the other.

    For each length n, words are compared with those n places on; n agreements in a
    row are a repeat.  Linear in the words.
    """

    def agreements(n: int) -> Column:
        later = F.slice(words, n + 1, 1 << 30)
        return F.array_join(F.zip_with(words, later, lambda x, y: F.when(x == y, "1").otherwise("0")), "")

    return F.array_contains(F.array(*(agreements(n).contains("1" * n) for n in range(4, 9))), True)


def image_target(t: Column) -> Column:
    return T.blank_to_null(F.regexp_extract(t, r"\]\(([^)]+)\)", 1))


def classified(blocks: DataFrame, key: str = "paper_id", artifacts: DataFrame | None = None) -> DataFrame:
    """Adds reasons (in the order of the rules) and policy; rows without a reason go.

    ``artifacts`` (key, path) are the files there are: an image whose target is not
    among them is broken.  Without artifacts all targets are missing.
    """
    blocks = blocks.withColumn("_target", F.when(F.col("type") == "image", image_target(T.strip(F.col("text")))))
    if artifacts is not None:
        files = artifacts.select(F.col(key).alias("_key"), F.col("path").alias("_path")).distinct()
        blocks = blocks.join(files, (F.col(key) == F.col("_key")) & (F.col("_target") == F.col("_path")), "left")
    else:
        blocks = blocks.withColumn("_path", F.lit(None).cast("string"))
    blocks = blocks.withColumn("_words", F.when(F.col("type") == "paragraph", F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z-]*"), 0)))
    blocks = blocks.withColumn("_t", T.strip(F.col("text")))
    t, kind = F.col("_t"), F.col("type")
    spaced, digits = has_spaced_letters(t), has_spaced_digits(t)
    paragraph = kind == "paragraph"
    rules = [
        ("page_number", t.rlike(PAGE_NUMBER)),
        ("replacement_character", t.contains("�")),
        ("spaced_letters", spaced),
        ("spaced_digits", digits),
        ("math_heavy", (spaced | digits) & is_math_heavy(kind, F.col("text"))),
        ("common_ocr_word", paragraph & has_ocr_word(t)),
        ("repeated_phrase", paragraph & has_repeated_phrase(F.col("_words"))),
        ("front_matter_noise", F.lower(t).isin(*FRONT_MATTER)),
        ("broken_image", F.col("_target").isNotNull() & F.col("_path").isNull()),
        ("short_text_noise", paragraph & (F.length(t) < 8) & t.rlike("[A-Za-z]")),
    ]
    reasons = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    # Exploding a list of none or one keeps the rules from being evaluated once more by the filter.
    found = F.when((t != "") & (F.size("_r") > 0), F.array("_r"))
    rows = blocks.withColumn("_r", reasons).select(*(F.col(c) for c in blocks.columns if c not in ("_target", "_path", "_words", "_t")), F.explode(found).alias("reasons"))
    return rows.withColumn("policy", policy(kind, F.col("text"), F.col("reasons")))


def policy(kind: Column, text: Column, reasons: Column) -> Column:
    return (
        F.when(F.array_contains(reasons, "broken_image"), "structural_warning")
        .when(kind.isin(*PROTECTED_TYPES) | F.array_contains(reasons, "math_heavy"), "review_only")
        .when(F.array_contains(reasons, "common_ocr_word") & (F.length(text) > 320), "review_only")
        .otherwise("auto_repair")
    )


def repairable(found: DataFrame) -> DataFrame:
    return found.where("policy = 'auto_repair'")


def warning_summary(found: DataFrame, *by: str) -> DataFrame:
    """by, reason, count (with repeats), block_ids (sorted, distinct) of findings that are not repaired."""
    rows = found.where("policy <> 'auto_repair'").select(*by, "block_id", F.explode(F.concat("reasons", F.array(F.lit("all")))).alias("r"), "policy")
    named = rows.select(*by, "block_id", F.concat_ws(":", "policy", "r").alias("reason"))
    return named.groupBy(*by, "reason").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("block_id")).alias("block_ids"))
