"""One function per command of a library: DataFrames in, DataFrames out.

What changes a library gives the rows to write; ``quire.sources.sinks`` writes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import convert as C
from quire.operators import doctor as D
from quire.operators import findings as Q
from quire.operators import ingest as I
from quire.operators import library as L
from quire.operators import memory as Y
from quire.operators import repair as P
from quire.plans.extraction import Extracted, collection_requests, extract, library_requests
from quire.session import kept
from quire.sources import sinks as K
from quire.sources.config import batch_size, local_jobs
from quire.sources.providers import Converter, EchoProvider, LocalFolder, Provider, SourceAdapter, answered, converted, provider_health

#: What runs tell of themselves: (event, details).
EventSink = Callable[[str, dict], None]


class Reporter:
    """Tells a sink of one run's events, each with the run's id, command and seconds so far."""

    def __init__(self, command: str, sink: EventSink):
        self.command, self.sink, self.run_id, self.began = command, sink, f"run:{uuid.uuid4()}", time.monotonic()

    def emit(self, event: str, **details) -> None:
        at = datetime.now(UTC).isoformat()
        self.sink(event, {"event": event, "at": at, "run_id": self.run_id, "command": self.command, "elapsed_seconds": round(time.monotonic() - self.began, 3), **details})


def log_sink(spark: SparkSession, folder: str) -> EventSink:
    """Adds each event to a log folder as a file of one line, which ``streaming.jobs`` reads as a stream."""
    return lambda event, details: K.write_text(spark, f"{folder}/{uuid.uuid4().hex}.json", json.dumps(details) + "\n")


def list_papers(papers: DataFrame) -> DataFrame:
    return L.in_path_order(L.listing(papers))


def resolve(papers: DataFrame, query: str) -> DataFrame:
    return L.resolve(papers, query)


def get(papers: DataFrame, query: str) -> DataFrame:
    """The one paper that matches, with all that its record holds; no row where none or several do."""
    found = L.resolve(papers, query)
    one = L.resolved_one(found).where("verdict = 'found'").select("id")
    return L.detail_rows(found.join(one, "id", "left_semi"))


def inspect(papers: DataFrame, query: str, files: DataFrame, texts: DataFrame) -> DataFrame:
    """The one paper that matches, with its artifacts and the content of its sidecar files."""
    return L.inspected(get(papers, query), files, texts)


def status(papers: DataFrame) -> DataFrame:
    return L.status(papers)


def doctor(papers: DataFrame, jobs: DataFrame | None = None, conversions: DataFrame | None = None, now: Column | None = None, strict: bool = False, records: DataFrame | None = None, conversion_files: DataFrame | None = None, converters: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    rules = [D.duplicate_ids(papers), D.missing_files(papers)]
    if records is not None:
        rules.append(D.invalid_records(records))
    if "creators" in papers.columns:
        rules.append(D.invalid_creators(papers))
    if strict:
        rules.append(D.unfinished(papers))
        if jobs is not None:
            rules.append(D.dangling_issues(jobs, "indexes/jobs.jsonl"))
        if lines is not None:
            rules.append(D.corrupt_lines(lines, "indexes/jobs.jsonl"))
        if conversions is not None and now is not None:
            rules.append(D.running_issues(conversions, now))
        if conversion_files is not None:
            rules.append(D.invalid_conversions(conversion_files))
        if converters is not None:
            rules.append(D.local_converter_issues(converters))
    return D.audit(*rules)


def provider_doctor(spark: SparkSession, provider: Provider) -> DataFrame:
    return provider_health(spark, provider)


def import_files(spark: SparkSession, path: str, papers: DataFrame, at: Column, collection: str | None = None, config: Mapping | None = None, adapter: SourceAdapter | None = None) -> DataFrame:
    """The records of the new documents that an adapter finds."""
    from quire.sources.files import pdf_info

    found = (adapter or LocalFolder()).discover(spark, path)
    info = pdf_info(found, "path").select("path", F.col("title").alias("pdf_title"), F.col("author").alias("pdf_author"))
    return C.imported(found.select("id", "path").join(info, "path"), papers, at, collection, dict(config or {}))


def convert_plan(papers: DataFrame, size: int = 20, converter: str = "batch-api", config: Mapping | None = None, jobs: int | None = None) -> DataFrame:
    """The pending papers in chunks, in path order, with how they would be converted."""
    pending = L.pending(papers)
    if converter == "local-command":
        jobs = local_jobs(config or {}, jobs, pending.count())
    rows = I.chunks(pending, batch_size(size), F.split("bundle_path", "/"))
    return rows.withColumns({"converter": F.lit(converter), "jobs": F.lit(jobs or 4)})


@dataclass(frozen=True)
class Converted:
    papers: DataFrame
    conversions: DataFrame
    jobs: DataFrame
    markdown: DataFrame


def convert(papers: DataFrame, files: DataFrame, converter: Converter, at: Column, previous: DataFrame, config: Mapping | None = None) -> Converted:
    """Converts pending papers (files: bundle_path, content) and gives what to write: records, conversions, job events, texts.

    Renamed papers have their new path everywhere but in ``old_path``; events of both ends of a
    conversion have the same attempt, one more than the last.
    """
    pending = L.pending(papers)
    results = kept(converted(files.join(pending.select("bundle_path"), "bundle_path", "left_semi"), converter))
    tried = I.attempts(previous, results).join(papers.select("bundle_path", F.col("id").alias("paper_id")), "bundle_path")
    tried = tried.withColumns({"converter": F.lit(converter.name), "submitted_at": at.cast("string"), "state": F.when(F.col("ok"), "done").otherwise("failed")})
    after = C.renamed(C.finished(papers, results), at, ~F.col("bad_title") & F.col("conversion").eqNullSafe("done"), dict(config or {}))
    after = kept(after)
    path = after.select(F.coalesce("old_path", "bundle_path").alias("_old"), F.col("bundle_path").alias("_now"))
    moved = tried.join(path, F.col("bundle_path") == F.col("_old")).withColumn("bundle_path", F.col("_now")).drop("_old", "_now")
    none = F.lit(None)
    started = tried.withColumns({"state": F.lit("running"), "ok": none.cast("boolean"), "error": none.cast("string")})
    events = K.job_events(started, "conversion-started", at).unionByName(K.job_events(moved, "conversion-finished", at))
    return Converted(after, K.conversion_rows(moved, at), events, moved.where("ok").select("bundle_path", "markdown"))


def extract_summary(docs: DataFrame, provider: Provider | None = None, done: DataFrame | None = None, force: bool = False) -> Extracted:
    return extract(docs, provider, done=done, force=force)


@dataclass(frozen=True)
class Memory:
    papers: DataFrame
    collections: DataFrame
    library: DataFrame
    skipped: DataFrame
    warnings: DataFrame


_COLLECTION = "struct<overview_summary:string,collection_themes:array<struct<name:string,summary:string,paper_ids:array<string>,source_block_ids:array<string>>>,representative_paper_ids:array<string>>"
_LIBRARY = "struct<collections:array<struct<collection_path:string,summary:string,main_themes:array<string>,representative_paper_ids:array<string>>>>"


def build_memory(papers: DataFrame, sections: DataFrame, blocks: DataFrame, nodes: DataFrame, verdicts: DataFrame, provider: Provider | None = None) -> Memory:
    """Memory of papers, collections and the library.

    ``papers`` are (paper_id, collection_key, title), ``verdicts`` their traceability; papers that aren't
    ok are skipped.  Collections take of an answer what names their own papers and important blocks.
    """
    provider = provider or EchoProvider()
    ok = papers.join(verdicts.where("verdict = 'ok'").select("paper_id"), "paper_id", "left_semi")
    own = kept(Y.paper_memory(sections, blocks, nodes).join(ok, "paper_id"))
    asked = collection_requests(own)
    said = kept(answered(asked, provider, "collection").join(asked.select("request_id", "collection_key"), "request_id"))
    rows = said.select("collection_key", "request_id", F.from_json("answer", _COLLECTION).alias("a"))
    ids, known = own.select("collection_key", F.col("paper_id").cast("string").alias("id")), Y.pooled_ids(own, "important_block_ids")
    themes = rows.select("collection_key", "request_id", F.posexplode("a.collection_themes").alias("i", "t")).select("collection_key", F.struct("request_id", "i").alias("pos"), "t.*")
    themes = Y.checked_themes(themes, ids, known)
    good = themes.where("warning is null").groupBy("collection_key").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_t"))  # a few for each request
    told = rows.groupBy("collection_key").agg(F.array_join(F.array_sort(F.collect_list(_said("a.overview_summary"))), " ").alias("overview"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("a.representative_paper_ids", F.array().cast("array<string>"))))).alias("ids"))
    kept_ids = Y.representatives(told, ids).withColumnRenamed("ids", "representatives")
    plan = Y.collection_plan(papers.join(verdicts, "paper_id"))
    names = F.coalesce(F.transform("_t", lambda x: x["name"]), F.array().cast("array<string>"))
    collections = plan.join(told.select("collection_key", "overview"), "collection_key", "left").join(good, "collection_key", "left").join(kept_ids, "collection_key", "left").select("collection_key", "overview", names.alias("themes"), F.coalesce("representatives", F.array().cast("array<string>")).alias("representatives"), F.col("valid").alias("papers"), "skipped")
    collections = kept(collections)
    answers = kept(answered(library_requests(collections), provider, "library"))
    listed = answers.select("request_id", F.posexplode(F.from_json("answer", _LIBRARY)["collections"]).alias("i", "c")).select(F.struct("request_id", "i").alias("pos"), "c.*")
    checked = Y.checked_collections(listed, collections, ids.select("id"))
    skipped = papers.join(verdicts.where("verdict <> 'ok'"), "paper_id").select("collection_key", "paper_id", F.col("verdict").alias("reason"))
    warnings = themes.where("warning is not null").select("warning").union(checked.where("warning is not null").select("warning"))
    return Memory(own, collections, Y.library_collections(collections, checked), skipped, warnings)


def _said(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def memory_changes(papers: DataFrame, changed: DataFrame, state: DataFrame) -> DataFrame:
    """Memory state after papers changed: they, their collections and the library are stale."""
    return Y.upsert_state(state, Y.affected(papers, changed))


@dataclass(frozen=True)
class Repaired:
    metadata: DataFrame
    markdown: DataFrame
    report: DataFrame


def repair(changes: DataFrame, current: DataFrame, patches: DataFrame | None = None, blocks: DataFrame | None = None, at: Column | None = None, targets: tuple[str, ...] = ("metadata", "markdown")) -> Repaired:
    """Metadata and texts with the accepted changes in, and one report row a paper."""
    verdicts = P.metadata_verdicts(changes if "metadata" in targets else changes.limit(0), current)
    none = changes.limit(0).select("paper_id", F.lit("").alias("block_id"), F.lit("").alias("verdict"))
    checked = P.patch_verdicts(patches, blocks) if patches is not None and "markdown" in targets else none
    texts = P.patched(blocks, checked) if patches is not None and "markdown" in targets else blocks
    papers = current.select("paper_id").union(checked.select("paper_id")).distinct()
    return Repaired(P.upserted(current, verdicts), texts, K.repair_rows(verdicts, checked, papers, F.current_timestamp() if at is None else at))


def repair_warnings(blocks: DataFrame) -> DataFrame:
    """What stays unrepaired in texts, by paper and reason."""
    return Q.warning_summary(Q.classified(blocks), "paper_id")


def validate(sample: DataFrame, papers: DataFrame, converts: bool, before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """(pos, section, name, value) of a validation run: its verdict, the library's status, and what it holds."""
    verdict = K.validation_report(before, after, converts)
    size = sample.agg(F.count("*").alias("sampled"))
    facts = lambda df, section: df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)))).alias("x")).select(F.lit(section).alias("section"), "x.*")
    counted = L.census(files).groupBy("name").agg(F.sum("n").alias("n")).select(F.lit("Artifact counts").alias("section"), F.lit(0).alias("i"), "name", F.col("n").cast("string").alias("value"))
    rows = facts(verdict, "").unionByName(facts(size, "")).unionByName(facts(L.status(papers), "Final status")).unionByName(counted)
    return rows.select(F.struct(F.when(F.col("section") == "", 0).when(F.col("section") == "Final status", 1).otherwise(2).alias("a"), "i", "name").alias("pos"), "section", "name", "value")


def emit(rows: DataFrame, ok: bool = True) -> DataFrame:
    """One JSON line for each row, as a program's output."""
    return rows.select(K.emitted(F.struct(F.lit(ok).alias("ok"), *rows.columns)).alias("json"))
