"""Summaries: normalising provider responses, sections, the concept graph, traceability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values.
NODE_TYPES = ("concept", "method", "dataset_or_sample", "instrument", "measurement", "result", "limitation", "claim")
EDGE_TYPES = ("uses", "measures", "produces", "supports", "compares_with", "limits", "depends_on", "explains")
ROOT_SECTION, ROOT_HEADING = "sec_0000", "Document"


def _or(c: str, default: str):
    return F.coalesce(T.blank_to_null(F.col(c)), F.lit(default))


def normalised_blocks(response: DataFrame, allowed: DataFrame, key: str = "paper_id") -> DataFrame:
    """Response rows with verdict: kept, unknown (of no allowed block) or empty; blanks get their defaults.

    One pass gives rows and warnings: a left join to the allowed blocks, then a case.
    """
    known = allowed.select(F.col(key).alias("_k"), F.col("block_id").alias("_b")).distinct()
    rows = response.join(known, (F.col(key) == F.col("_k")) & (F.col("block_id") == F.col("_b")), "left")
    text = T.strip(F.coalesce("summary_text", F.lit("")))
    verdict = F.when(F.col("_b").isNull(), "unknown").when(text == "", "empty").otherwise("kept")
    return rows.select(key, "block_id", text.alias("summary_text"), _or("role", "other").alias("role"), _or("importance", "medium").alias("importance"), "concepts", verdict.alias("verdict"))


def missing_blocks(asked: DataFrame, answered: DataFrame, key: str = "paper_id") -> DataFrame:
    """Blocks to ask for again: an anti-join."""
    return asked.join(answered.select(key, "block_id"), [key, "block_id"], "left_anti")


def joined_blocks(summaries: DataFrame, source: DataFrame, key: str = "paper_id") -> DataFrame:
    """Summaries with the place, hash and excerpt of their block."""
    own = source.select(key, "block_id", "order", "start_line", "end_line", "text_hash", T.excerpt(F.col("text")).alias("excerpt"), "section_id", "section_path")
    return summaries.join(own, [key, "block_id"])


def sections(blocks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Sections of summarised blocks: pos by first block, heading, ids and texts in block order."""
    section = F.coalesce(T.blank_to_null(F.col("section_id")), F.lit(ROOT_SECTION))
    items = F.array_sort(F.collect_list(F.struct("order", "block_id", "summary_text")))
    grouped = blocks.groupBy(key, section.alias("section_id")).agg(F.min("order").alias("pos"), F.first("section_path").alias("section_path"), items.alias("items"))
    heading = F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).otherwise(ROOT_HEADING)
    return grouped.select(key, "section_id", "pos", heading.alias("heading"), "section_path", F.transform("items", lambda x: x["block_id"]).alias("block_ids"), F.transform("items", lambda x: x["summary_text"]).alias("texts"))


def filled_sections(inputs: DataFrame, response: DataFrame, key: str = "paper_id") -> DataFrame:
    """Sections as answered; one without an answer gets its first three block summaries and the role 'other'.

    An answered summary stays even if it is empty.
    """
    given = response.select(F.col(key), "section_id", F.coalesce("summary", F.lit("")).alias("_s"), _or("role", "other").alias("_r"))
    rows = inputs.join(given, [key, "section_id"], "left")
    return rows.select(key, "section_id", "pos", "heading", "block_ids", F.coalesce("_s", F.array_join(F.slice("texts", 1, 3), " ")).alias("summary"), F.coalesce("_r", F.lit("other")).alias("role"), F.col("_s").isNotNull().alias("answered"))


def untraced(rows: DataFrame, known: DataFrame, key: str, pos: list[str], ids: str = "source_block_ids") -> DataFrame:
    """key and pos of the rows that name a block which is not known.

    An explode and an anti-join: no list of all blocks has to fit one row.
    """
    named = rows.select(key, *pos, F.explode(F.array_distinct(ids)).alias("block_id"))
    return named.join(known.select(key, "block_id").distinct(), [key, "block_id"], "left_anti").select(key, *pos).distinct()


def checked_nodes(nodes: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    """Node rows with warning: null for those with an id, a known type and known blocks only."""
    bad = untraced(nodes, known, key, ["pos"]).withColumn("_bad", F.lit(True))
    good = (F.coalesce("id", F.lit("")) != "") & F.col("type").isin(*NODE_TYPES) & F.col("_bad").isNull()
    text = F.concat(F.lit("Graph node skipped: "), F.coalesce("id", F.lit("")))
    return nodes.join(bad, [key, "pos"], "left").withColumn("warning", F.when(~F.coalesce(good, F.lit(False)), text)).drop("_bad")


def valid_nodes(nodes: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    return checked_nodes(nodes, known, key).where("warning is null").drop("warning")


def checked_edges(edges: DataFrame, nodes: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    """Edge rows with warning: null for those of a known type and known blocks, between nodes that are valid themselves.

    Rows that are equal in all of these have the same verdict, so their place isn't needed.
    """
    pos = ["source", "target", "type", "source_block_ids"]
    ends = nodes.select(key, F.col("id")).distinct()
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(ends.select(key, F.col("id").alias(end), F.lit(True).alias(f"_{end}")), [key, end], "left")
    bad = untraced(edges, known, key, pos).withColumn("_bad", F.lit(True))
    rows = rows.join(bad, [key, *pos], "left")
    good = F.col("_source").isNotNull() & F.col("_target").isNotNull() & F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)) & F.col("_bad").isNull()
    text = F.concat(F.lit("Graph edge skipped: "), F.coalesce("source", F.lit("")), F.lit("->"), F.coalesce("target", F.lit("")))
    return rows.withColumn("warning", F.when(~good, text)).select(*edges.columns, "warning")


def valid_edges(edges: DataFrame, nodes: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    """Edges of known types and blocks, between nodes that are valid themselves."""
    return checked_edges(edges, nodes, known, key).where("warning is null").drop("warning")


def unknown_sections(inputs: DataFrame, response: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, warning: of each answered section that was not asked for."""
    rows = response.join(inputs.select(key, "section_id"), [key, "section_id"], "left_anti")
    return rows.select(key, F.concat(F.lit("Unknown section skipped: "), F.coalesce("section_id", F.lit(""))).alias("warning"))


def known_block_ids(summary: DataFrame, source: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, block_id: of the summary's and the source map's blocks, each once, without blank ones."""
    return summary.select(key, "block_id").union(source.select(key, "block_id")).where("block_id <> ''").distinct()


def traceability(papers: DataFrame, blocks: DataFrame, sections: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, key: str = "paper_id") -> DataFrame:
    """Each paper's verdict: missing-summary, invalid-summary, invalid-source-map, missing-traceability, or ok.

    ``papers`` have has_summary and, where files can be broken, summary_ok and source_map_ok.
    """
    lost = [untraced(sections, blocks, key, ["section_id"], "block_ids"), untraced(nodes, blocks, key, ["pos"])]
    if edges is not None:
        lost.append(untraced(edges, blocks, key, ["pos"]))
    bad = reduce(DataFrame.unionByName, [x.select(key) for x in lost]).distinct().withColumn("_bad", F.lit(True))
    some = blocks.select(key).distinct().withColumn("_some", F.lit(True))
    rows = papers.join(some, key, "left").join(bad, key, "left")
    broken = lambda c: ~F.coalesce(F.col(c), F.lit(True)) if c in papers.columns else F.lit(False)
    verdict = (
        F.when(~F.col("has_summary"), "missing-summary")
        .when(broken("summary_ok"), "invalid-summary")
        .when(broken("source_map_ok"), "invalid-source-map")
        .when(F.col("_some").isNull() | F.col("_bad").isNotNull(), "missing-traceability")
        .otherwise("ok")
    )
    return rows.select(key, verdict.alias("verdict"))


def run_report(rows: DataFrame) -> DataFrame:
    """Counts by status, and whether nothing failed."""
    of = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s)
    return rows.agg(of("planned"), of("extracted"), of("skipped"), of("failed"), (F.count_if(F.coalesce(F.col("status") == "failed", F.lit(False))) == 0).alias("ok"))
