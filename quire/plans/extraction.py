"""Summary extraction from end to end: blocks, requests, answers, sections, graph; and all requests to providers.

A request is one row with its messages as JSON.  Answers are kept before they are
used, as a provider may answer otherwise when asked again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import summary as S
from quire.operators.repair import FIELDS
from quire.session import kept
from quire.sources.providers import EchoProvider, Provider, answered
from quire.sources.sinks import block_index, section_index

_LIST = "array<string>"
_BLOCKS = f"struct<blocks:array<struct<block_id:string,summary_text:string,role:string,importance:string,concepts:{_LIST}>>>"
_SECTIONS = f"struct<sections:array<struct<section_id:string,summary:string,key_points:{_LIST},role:string>>>"
_GRAPH = f"struct<nodes:array<struct<id:string,type:string,label:string,source_block_ids:{_LIST}>>,edges:array<struct<source:string,target:string,type:string,source_block_ids:{_LIST}>>>"


def prompt(task: str, *fields: Column | str) -> Column:
    """A request: the task and what it is about, as JSON, nulls included."""
    return F.to_json(F.struct(F.lit(task).alias("task"), *fields), {"ignoreNullFields": "false"})


def _ordered(*fields: str) -> Column:
    """The rows of a group as one list in the order of their first field, without that field."""
    inner = F.array_sort(F.collect_list(F.struct(F.col(fields[0]).alias("_order"), *fields[1:])))
    return F.transform(inner, lambda x: F.struct(*(x[f].alias(f) for f in fields[1:])))


def brief(papers: DataFrame, source: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, brief: a paper's bibliographic fields and first headings, as one value."""
    heads = B.headings_brief(source, key)
    own = [c for c in ("title", "creators", "year", "doi", "language") if c in papers.columns]
    rows = papers.select(key, *own).join(heads, key, "left")
    return rows.select(key, F.struct(*own, F.coalesce("headings", F.array().cast(_LIST)).alias("headings")).alias("brief"))


def block_requests(source: DataFrame, key: str = "paper_id", briefs: DataFrame | None = None) -> DataFrame:
    """request_id, key, messages: one request for each batch of blocks."""
    own = B.packed(source, key).join(source.select(key, "block_id", "order", "text"), [key, "block_id"])
    rows = own.groupBy(key, "batch").agg(_ordered("order", "block_id", "text").alias("blocks"))
    about = ["blocks"]
    if briefs is not None:
        rows, about = rows.join(briefs, key, "left"), ["brief", "blocks"]
    return rows.select(F.concat_ws("/", F.col(key).cast("string"), "batch").alias("request_id"), key, prompt("block-summary", *about).alias("messages"))


def single_requests(missing: DataFrame, source: DataFrame, key: str = "paper_id") -> DataFrame:
    """request_id, key, messages: one request for each block that was not answered."""
    own = missing.select(key, "block_id").join(source.select(key, "block_id", "text"), [key, "block_id"])
    one = F.array(F.struct("block_id", "text")).alias("blocks")
    return own.select(F.concat_ws("/", F.col(key).cast("string"), "block_id").alias("request_id"), key, prompt("block-summary", one).alias("messages"))


def section_requests(inputs: DataFrame, key: str = "paper_id") -> DataFrame:
    """request_id, key, messages: one request for the sections of each paper."""
    rows = inputs.groupBy(key).agg(_ordered("pos", "section_id", "heading", "texts").alias("sections"))
    return rows.select(F.concat_ws("/", F.col(key).cast("string"), F.lit("sections")).alias("request_id"), key, prompt("section-summary", "sections").alias("messages"))


def graph_requests(blocks: DataFrame, sections: DataFrame, key: str = "paper_id") -> DataFrame:
    """request_id, key, messages: one request for the concept graph of each paper."""
    b = blocks.groupBy(key).agg(_ordered("order", "block_id", "summary_text", "concepts").alias("blocks"))
    s = sections.groupBy(key).agg(_ordered("pos", "section_id", "summary").alias("sections"))
    kinds = [F.array(*map(F.lit, values)).alias(name) for name, values in (("node_types", S.NODE_TYPES), ("edge_types", S.EDGE_TYPES))]
    return b.join(s, key, "left").select(F.concat_ws("/", F.col(key).cast("string"), F.lit("graph")).alias("request_id"), key, prompt("concept-graph", "blocks", "sections", *kinds).alias("messages"))


def evidence(papers: DataFrame, heads: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, evidence: what is known of a paper where its metadata are repaired: its record, the name of its bundle and file, its head and the identifiers there."""
    rows = papers.join(heads, key)
    own = [c for c in ("title", "creators", "year", "language", "doi", "metadata_sources", "metadata_confidence") if c in papers.columns]
    extra = []
    if "bundle_path" in papers.columns:
        extra.append(F.element_at(F.split("bundle_path", "/"), -1).alias("bundle_name"))
    if "imported_from" in papers.columns:
        extra.append(F.element_at(F.split("imported_from", "/"), -1).alias("source_file"))
    if "conversion" in papers.columns:
        extra.append(F.col("conversion"))
    return rows.select(key, F.struct(*own, *extra, F.col("head").alias("markdown_head"), M.identifiers(F.col("head")).alias("identifier_candidates")).alias("evidence"), T.sha256(F.col("head")).alias("head_hash"))


def metadata_requests(found: DataFrame, key: str = "paper_id") -> DataFrame:
    fields = F.array(*map(F.lit, sorted(FIELDS))).alias("supported_fields")
    return found.select(F.concat_ws("/", F.col(key).cast("string"), F.lit("metadata")).alias("request_id"), key, prompt("metadata-repair", fields, "evidence").alias("messages"))


def markdown_requests(found: DataFrame, key: str = "paper_id") -> DataFrame:
    """One request for the repairable blocks of each paper, with why each was found."""
    rows = found.where("policy = 'auto_repair'").groupBy(key).agg(_ordered("order", "block_id", "type", "reasons", "text").alias("blocks"))
    return rows.select(F.concat_ws("/", F.col(key).cast("string"), F.lit("markdown")).alias("request_id"), key, prompt("markdown-repair", "blocks").alias("messages"))


def collection_requests(memories: DataFrame, by: str = "collection_key", most: int = 200) -> DataFrame:
    """request_id, by, messages: requests for a collection's overview, of at most ``most`` papers each, in the order of their ids."""
    from quire.operators.ingest import chunks

    rows = chunks(memories, most, F.col("paper_id"), by=by)
    own = rows.groupBy(by, "chunk").agg(_ordered("paper_id", "paper_id", "title", "research_problem", "method", "key_results", "important_block_ids").alias("papers"))
    return own.select(F.concat_ws("/", by, "chunk").alias("request_id"), by, prompt("collection-memory", F.col(by).alias("collection_path"), "papers").alias("messages"))


def library_requests(collections: DataFrame, most: int = 200) -> DataFrame:
    """request_id, messages: requests for the library's overview, of at most ``most`` collections each."""
    from quire.operators.ingest import chunks

    rows = chunks(collections, most, F.col("collection_key"))
    own = rows.groupBy("chunk").agg(_ordered("collection_key", "collection_key", "overview", "themes").alias("collections"))
    return own.select(F.concat_ws("/", F.lit("library"), "chunk").alias("request_id"), prompt("library-memory", "collections").alias("messages"))


@dataclass(frozen=True)
class Extracted:
    """blocks: summaries with their places; sections, nodes, edges; warnings (key, warning); status (key, status, reason)."""

    blocks: DataFrame
    sections: DataFrame
    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame
    status: DataFrame
    by_block: DataFrame
    by_section: DataFrame


def _answers(requests: DataFrame, provider: Provider, schema: str, key: str) -> DataFrame:
    """key, answer, error of each request; kept, as each is asked once."""
    return kept(answered(requests, provider, schema).join(requests.select("request_id", key), "request_id"))


def _rows_of(answers: DataFrame, schema: str, field: str, key: str) -> DataFrame:
    return answers.select(key, F.posexplode(F.from_json("answer", schema)[field]).alias("pos", "x")).where("x is not null").select(key, "pos", "x.*")


def extract(docs: DataFrame, provider: Provider | None = None, key: str = "paper_id", markdown: str = "markdown", done: DataFrame | None = None, force: bool = False) -> Extracted:
    """Summaries, sections and graphs of documents; those that are done are skipped unless forced.

    Blocks that no answer has are asked for once more, each alone; a paper of which some are then
    still missing, or a request fails, is failed and has no rows.
    """
    provider = provider or EchoProvider()
    todo = docs if done is None or force else docs.join(done.select(key).distinct(), key, "left_anti")
    source = kept(B.source_map(todo, key, markdown))
    asked = source.where("summary_policy = 'summarize'")
    first = _answers(block_requests(source, key), provider, "block-summary", key)
    told = S.normalised_blocks(_rows_of(first, _BLOCKS, "blocks", key), asked, key)
    missing = S.missing_blocks(asked.select(key, "block_id"), told.where("verdict = 'kept'"), key)
    second = _answers(single_requests(missing, source, key), provider, "block-summary", key)
    again = S.normalised_blocks(_rows_of(second, _BLOCKS, "blocks", key), asked, key)
    rows = told.unionByName(again)
    good = rows.where("verdict = 'kept'").dropDuplicates([key, "block_id"])
    lost = S.missing_blocks(asked.select(key, "block_id"), good, key).select(key).unionByName(first.where("error is not null").select(key)).distinct()
    lost = kept(lost)
    blocks = S.joined_blocks(good.join(lost, key, "left_anti").drop("verdict"), source, key)

    inputs = S.sections(blocks, key)
    said = _rows_of(_answers(section_requests(inputs, key), provider, "sections", key), _SECTIONS, "sections", key)
    sections = S.filled_sections(inputs, said, key)
    graph = _answers(graph_requests(blocks, sections, key), provider, "graph", key)
    nodes = S.checked_nodes(_rows_of(graph, _GRAPH, "nodes", key), blocks, key)
    some = nodes.where("warning is null").drop("warning")
    edges = S.checked_edges(_rows_of(graph, _GRAPH, "edges", key), some, blocks, key)

    odd = rows.where("verdict <> 'kept'").select(key, F.concat(F.when(F.col("verdict") == "unknown", "Unknown").otherwise("Empty"), F.lit(" block summary skipped: "), F.coalesce("block_id", F.lit(""))).alias("warning"))
    warnings = odd.unionByName(S.unknown_sections(inputs, said, key))
    for checked in (nodes, edges):
        warnings = warnings.unionByName(checked.where("warning is not null").select(key, "warning"))
    failed = lost.select(key, F.lit("failed").alias("status"), F.lit("blocks without a summary").alias("reason"))
    none = F.lit(None).cast("string").alias("reason")
    status = todo.select(key).distinct().join(lost, key, "left_anti").select(key, F.lit("extracted").alias("status"), none).unionByName(failed)
    if todo is not docs:
        status = status.unionByName(docs.select(key).join(done.select(key).distinct(), key, "left_semi").distinct().select(key, F.lit("skipped").alias("status"), F.lit("summary exists").alias("reason")))
    return Extracted(blocks, sections, some, edges.where("warning is null").drop("warning"), warnings, status, block_index(sections, key), section_index(sections, key))


def planned(docs: DataFrame, key: str = "paper_id", markdown: str = "markdown") -> DataFrame:
    """key, blocks, batches: what extraction would ask for, without asking."""
    own = B.packed(B.source_map(docs, key, markdown), key)
    counted = own.groupBy(key).agg(F.count("*").alias("blocks"), F.count_distinct("batch").alias("batches"))
    return docs.select(key).join(counted, key, "left").select(key, F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("batches", F.lit(0)).alias("batches"))
