"""Site-relative line frequency: drops a host's boilerplate lines.  DataFrame functions only.

A line (without spaces at its ends) is boilerplate of a host if the share of the
host's pages that contain it is above ``ratio``, and at least ``least`` pages do.
Byte-identical pages of a host are one page, so that a page is never boilerplate
because it was fetched often.  A line counts once for each page.

A host has fewer than (lines per page) / ratio boilerplate lines, so they travel
as one array of hashes per host.

Defined results: a null text stays null and has no lines; a null host is a host
of its own; blank lines are kept; repeated rows are cleaned alike; an empty
table gives an empty result; other columns are carried by ``clean`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import stored

RATIO = 0.05
LEAST = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, lines: array of hashes) of the hosts that have boilerplate lines."""
    text = F.col(text_col)
    pages = docs.where(text.isNotNull()).select(F.col(host_col).alias("host"), F.xxhash64(text).alias("page"), text.alias("body"))
    total = pages.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(_lines(F.col("body")), lambda x: F.xxhash64(F.trim(x))))).alias("line"))
    often = lines.where(F.col("line") != F.xxhash64(F.lit(""))).groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least)
    shared = often.withColumnRenamed("host", "_h").join(total, F.col("_h").eqNullSafe(F.col("host"))).where(F.col("n") > ratio * F.col("pages"))
    return shared.groupBy("host").agg(F.collect_list("line").alias("lines"))


def _cleaned(docs: DataFrame, ratio: float, least: int, text_col: str, host_col: str) -> DataFrame:
    """(document: struct of all columns, kept: the lines that stay)."""
    # Written first, so that its size is known: a small table is broadcast, and texts are not shuffled.
    hosts = stored(boilerplate(docs, ratio, least, text_col, host_col))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    rows = rows.join(hosts, F.col(f"document.`{host_col}`").eqNullSafe(F.col("host")), "left")
    dropped = lambda x: F.array_contains("lines", F.xxhash64(F.trim(x)))
    lines = _lines(F.col(f"document.`{text_col}`"))
    return rows.select("document", F.when(F.col("lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~dropped(x))).alias("kept"))


def clean(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The table with the boilerplate lines gone from its texts; n_chars, where there is such a column, follows."""
    rows = _cleaned(docs, ratio, least, text_col, host_col)
    text = F.array_join("kept", "\n")
    made = {text_col: text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*((made[c] if c in made else F.col(f"document.`{c}`")).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every document."""
    rows = _cleaned(docs.select("doc_id", "text", "source"), ratio, least, "text", "source")
    n = F.coalesce(F.size(_lines(F.col("document.text"))), F.lit(0))
    n = F.when(F.col("document.text").isNull(), 0).otherwise(n).cast("long")
    left = F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).cast("long")
    return rows.select("document.doc_id", F.array_join("kept", "\n").alias("text"), n.alias("n_lines"), (n - left).alias("n_dropped"))


ORACLE = f"""
WITH pages AS (SELECT source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(DISTINCT text) AS pages FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, trim(l) AS line FROM (SELECT source, text, unnest(ls) AS l FROM pages)),
often AS (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line HAVING count(*) >= {LEAST}),
boiler AS (SELECT o.source, list(o.line) AS bl FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source WHERE o.n > {RATIO} * t.pages GROUP BY o.source),
kept AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls, list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.bl, CAST([] AS VARCHAR[])), trim(x))) AS ks
  FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(ks) END AS BIGINT) AS n_dropped
FROM kept
"""
