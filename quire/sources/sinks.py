"""Sinks of a library: versioned tables, records and other files, look-ups, Markdown, reports.

A table that is replaced is a folder of versions, of which the last finished one
counts, so its next version can be made from the last, and a write that is run again
makes the same version again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.files import RECORD

TABLES = {
    "papers": f"bundle_path STRING, {RECORD}",
    "conversions": "bundle_path STRING, converter STRING, ok BOOLEAN, state STRING, attempt INT, submitted_at STRING, converted_at STRING, error STRING, batch_id STRING, data_id STRING",
    "memory_state": "scope STRING, key STRING, stale BOOLEAN, reason STRING, updated_at TIMESTAMP",
}


def init_library(spark: SparkSession, root: str) -> None:
    """Makes the empty tables of a library; tables that are there stay."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the finished versions in a folder."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    numbers = [int(x.getPath().getName()[2:]) for x in fs.listStatus(path) if x.getPath().getName().startswith("v=")]
    return sorted(n for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={n:09d}/_SUCCESS")))


def latest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The last version of a table, or the last before a number."""
    done = [n for n in versions(spark, folder) if below is None or n < below]
    return spark.read.parquet(f"{folder}/v={done[-1]:09d}") if done else None


def write_version(rows: DataFrame, folder: str, number: int | None = None) -> int:
    """Writes a table's next version, or that of a number; the one before stays."""
    number = max(versions(rows.sparkSession, folder), default=-1) + 1 if number is None else number
    rows.write.mode("overwrite").parquet(f"{folder}/v={number:09d}")
    return number


def replace_with_history(new: DataFrame, changed: DataFrame, target: str, history: str, at: Column) -> int:
    """Writes a table's next version after its changed rows, as they were, were written to its history.

    Both may be made from the table's last version.  Each step of the history has the
    number of the version it leads to, so that one written again replaces itself.
    """
    number = max(versions(new.sparkSession, target), default=-1) + 1
    changed.withColumn("replaced_at", at).write.mode("overwrite").parquet(f"{history}/step={number:09d}")
    return write_version(new, target, number)


def upserted(current: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """A keyed table with new rows in place of those of the same key."""
    return current.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> int:
    """Writes several tables as one version: all are there, or none, as they become visible by one rename."""
    number, draft = max(versions(spark, folder), default=-1) + 1, f"{folder}/.draft-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{draft}/{name}")
    fs, path = _files(spark, f"{draft}/_SUCCESS")
    fs.create(path).close()
    if not fs.rename(path.getParent(), _files(spark, f"{folder}/v={number:09d}")[1]):
        raise OSError(f"could not publish version {number} of {folder}")
    return number


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, replaced as a whole."""
    fs, target = _files(spark, path)
    draft = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"could not write {path}")


def write_files(rows: DataFrame, root: str, path: str = "path", text: str = "text") -> None:
    """Writes each row's text to its path below a root, from the tasks that hold them; each file is replaced as a whole."""

    def work(part: Iterator[Row]) -> None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for r in part:
            target = f"{base}/{r[path]}"
            files.create_dir(target.rpartition("/")[0], recursive=True)
            draft = f"{target}.{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(draft) as f:
                f.write((r[text] or "").encode())
            files.move(draft, target)

    rows.select(path, text).foreachPartition(work)


def append_events(rows: DataFrame, folder: str, number: int) -> None:
    """Events of one step as a part of a log folder; a step that is run again writes the same part again."""
    rows.write.mode("overwrite").json(f"{folder}/step={number:09d}")


def emitted(payload: Column) -> Column:
    """A payload as one line of JSON, nulls included."""
    return F.to_json(payload, {"ignoreNullFields": "false"})


def conversion_rows(results: DataFrame, at: Column) -> DataFrame:
    """The conversion records of results (bundle_path, converter, attempt, submitted_at, ok, error, batch_id, data_id, remote_state); blank ids are null."""
    blank = lambda c: T.blank_to_null(F.col(c)) if c in results.columns else F.lit(None).cast("string")
    raw = F.when(F.col("ok") & (F.col("converter") != "local-fixture"), "raw/converter")
    return results.select(
        "bundle_path", F.lit(1).alias("schema_version"), "converter", "ok", F.when(F.col("ok"), "done").otherwise("failed").alias("state"), F.col("attempt").cast("int").alias("attempt"), F.col("submitted_at").cast("string").alias("submitted_at"), at.cast("string").alias("converted_at"),
        F.when(~F.col("ok"), F.col("error")).alias("error"), raw.alias("raw_output_dir"), F.lit("paper.md").alias("markdown"), F.lit("images").alias("images"), blank("batch_id").alias("batch_id"), blank("data_id").alias("data_id"), blank("remote_state").alias("remote_state"),
    )


def running_rows(items: DataFrame, batch_id: Column) -> DataFrame:
    """The conversion records of items that are about to be handed in as a batch."""
    none = F.lit(None).cast("string")
    return items.select("bundle_path", F.lit(1).alias("schema_version"), "converter", F.lit(False).alias("ok"), F.lit("running").alias("state"), F.col("attempt").cast("int").alias("attempt"), F.col("submitted_at").cast("string").alias("submitted_at"), none.alias("converted_at"), none.alias("error"), batch_id.alias("batch_id"), F.col("data_id"))


def job_events(rows: DataFrame, event: str, at: Column) -> DataFrame:
    """Job log rows of conversions (bundle_path, paper_id, converter, attempt, state, ok, error)."""
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c)
    return rows.select(F.lit(event).alias("event"), at.alias("at"), "paper_id", "bundle_path", "converter", F.col("attempt").cast("int").alias("attempt"), "state", has("ok", "boolean"), has("error", "string"), has("batch_id", "string"), has("data_id", "string"), has("remote_state", "string"))


def repair_rows(metadata: DataFrame, patches: DataFrame, targets: DataFrame, at: Column, dry_run: bool = False, key: str = "paper_id") -> DataFrame:
    """One row a paper (key): what a repair checked, changed and left, out of its verdicts."""
    changes = F.array_sort(F.collect_list(F.when(F.col("verdict") == "accepted", F.struct("field", "old", "new", "confidence"))))
    left = F.array_sort(F.collect_list(F.when(~F.col("verdict").isin("accepted", "unchanged"), F.concat_ws(":", "field", "verdict"))))
    m = metadata.groupBy(key).agg(changes.alias("changes"), left.alias("metadata_warnings"))
    named = F.array_sort(F.collect_list(F.when(F.col("verdict") != "accepted", F.concat_ws(":", "block_id", "verdict"))))
    p = patches.groupBy(key).agg(F.count("*").alias("blocks_checked"), F.count_if(F.col("verdict") == "accepted").alias("blocks_changed"), named.alias("markdown_warnings"))
    none = F.array().cast("array<string>")
    rows = targets.select(key).distinct().join(m, key, "left").join(p, key, "left")
    counted = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    changes = F.coalesce("changes", F.array().cast(m.schema["changes"].dataType))
    return rows.select(key, F.lit(1).alias("schema_version"), at.alias("repaired_at"), F.lit(dry_run).alias("dry_run"), (F.size(changes) > 0).alias("metadata_changed"), changes.alias("changes"), F.coalesce("metadata_warnings", none).alias("metadata_warnings"), (F.coalesce("blocks_changed", F.lit(0)) > 0).alias("markdown_changed"), counted("blocks_checked"), counted("blocks_changed"), F.coalesce("markdown_warnings", none).alias("markdown_warnings"))


def collection_root(collection: Column) -> Column:
    """The folder of a collection, without empty, '.' and '..' parts."""
    return F.array_join(F.filter(F.split(collection, "/"), lambda x: ~x.isin("", ".", "..")), "/")


def memory_folder(key: Column) -> Column:
    return F.when(key == "__root__", "_memory/collections/__root__").otherwise(F.concat(F.lit("collections/"), key, F.lit("/_memory")))


#: Where things are in a bundle and a library.
SUMMARY, SOURCE_MAP = "extracts/summary/summary.json", "extracts/summary/source-map.json"
LIBRARY_MEMORY = "_memory/library-memory.json"


def output_paths(bundle: Column, key: Column) -> Column:
    """(summary, source_map, raw, collection_memory, paper_index, library_memory) of a bundle and its collection's key."""
    below = lambda at, name: F.concat_ws("/", at, F.lit(name))
    return F.struct(
        below(bundle, SUMMARY).alias("summary"), below(bundle, SOURCE_MAP).alias("source_map"), below(bundle, "raw/converter").alias("raw"), below(memory_folder(key), "collection-memory.json").alias("collection_memory"),
        below(memory_folder(key), "paper-index.json").alias("paper_index"), F.lit(LIBRARY_MEMORY).alias("library_memory"),
    )


def relative_to(path: Column, root: Column) -> Column:
    """A path below a root without it; any other path as it is."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def block_index(sections: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, sections: a map from each block to its section."""
    rows = sections.select(key, "section_id", F.explode("block_ids").alias("block_id"))
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("block_id", "section_id")))).alias("sections"))


def section_index(sections: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, blocks: a map from each section to its blocks."""
    return sections.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_id", "block_ids")))).alias("blocks"))


def paper_index(papers: DataFrame, by: str = "collection_key") -> DataFrame:
    """by, paper_id, where its bundle, summary and source map are, and its important sections and blocks: a look-up by key, a row a paper."""
    paths = output_paths(F.col("bundle_path"), F.col(by))
    return papers.select(by, "paper_id", "bundle_path", paths["summary"].alias("summary_path"), paths["source_map"].alias("source_map_path"), "important_section_ids", "important_block_ids")


def collection_index(collections: DataFrame, by: str = "collection_key") -> DataFrame:
    """by, memory_path, paper_count, representative_paper_ids: a row a collection."""
    return collections.select(by, F.concat(memory_folder(F.col(by)), F.lit("/collection-memory.json")).alias("memory_path"), F.col("paper_count").cast("long").alias("paper_count"), "representative_paper_ids")


def _text(*parts: Column) -> Column:
    """Lines and groups of lines as one text; null ones are left out."""
    return F.concat(F.regexp_replace(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n"), r"\s+\z", ""), F.lit("\n"))


def _listed(items: Column, line) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))


def summary_markdown(sections: DataFrame, key: str = "paper_id") -> DataFrame:
    """Each paper's section summaries as Markdown, in order; sections without one are left out."""
    part = F.concat(F.lit("## "), "heading", F.lit("\n\n"), "summary")
    rows = sections.where("summary <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("ps"))
    return rows.select(key, F.concat(F.array_join(F.transform("ps", lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("markdown"))


def summary_report(sections: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, markdown: a paper's sections with key points and source blocks, and its concept graph."""
    bullets = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("- Key points:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    said = F.when(F.col("summary") != "", F.concat(F.lit("- Section summary: "), "summary"))
    part = _text(F.concat(F.lit("## "), F.col("heading"), F.lit("\n")), said, bullets(F.col("key_points")), F.concat(F.lit("- Source blocks: "), F.array_join("block_ids", ", ")))
    s = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("_s"))
    of = F.concat(F.lit(" ["), F.array_join("source_block_ids", ", "), F.lit("]"))
    node = F.concat(F.lit("- "), "id", F.lit(" ("), "type", F.lit("): "), F.coalesce("label", F.lit("")), of)
    edge = F.concat(F.lit("- "), "source", F.lit(" --"), "type", F.lit("--> "), "target", of)
    n = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", node.alias("line")))).alias("_n"))
    e = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", edge.alias("line")))).alias("_e"))
    rows = s.join(n, key, "left").join(e, key, "left")
    graph = F.when(F.col("_n").isNotNull() | F.col("_e").isNotNull(), F.lit("## Knowledge Graph\n"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    return rows.select(key, _text(F.lit("# AI Summary\n"), F.array_join(F.transform("_s", lambda x: x["part"]), "\n"), graph, lines(F.col("_n")), lines(F.col("_e"))).alias("markdown"))


def collection_report(memories: DataFrame) -> DataFrame:
    """collection_key, markdown of collections (overview, papers: array of rows, themes, skipped)."""
    if_some = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), c))
    code = lambda name, c: F.concat(F.lit(f"- {name}: `"), c, F.lit("`"))
    paper = lambda x: _text(F.concat(F.lit("### "), F.coalesce(T.blank_to_null(x["title"]), x["paper_id"]), F.lit("\n")), code("Paper ID", x["paper_id"]), code("Bundle", x["bundle_path"]), if_some(x["research_problem"], "Main problem"), if_some(x["method"], "Main method"), if_some(F.array_join(x["key_results"], "; "), "Key results"), if_some(F.array_join(x["important_block_ids"], ", "), "Source blocks"))
    themes = _listed(F.col("themes"), lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["summary"]))
    skipped = _listed(F.col("skipped"), lambda x: F.concat(F.lit("- `"), x["paper_id"], F.lit("`: "), x["reason"]))
    titled = lambda name, body: F.when(body.isNotNull(), F.concat(F.lit(f"## {name}\n\n"), body, F.lit("\n")))
    markdown = _text(F.concat(F.lit("# Collection Memory: "), "collection_key", F.lit("\n")), titled("Overview", T.blank_to_null(F.col("overview"))), F.lit("## Paper Memories\n"), F.array_join(F.transform("papers", paper), "\n"), titled("Shared Themes", themes), titled("Skipped Papers", skipped))
    return memories.select("collection_key", markdown.alias("markdown"))


def library_report(library: DataFrame, collections: DataFrame) -> DataFrame:
    """markdown: one row of a library (overview, themes) with its collections (collection_key, memory_path, paper_count, summary, main_themes)."""
    some = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), c))
    part = _text(F.concat(F.lit("### "), F.col("collection_key"), F.lit("\n")), F.concat(F.lit("- Memory: `"), "memory_path", F.lit("`")), F.concat(F.lit("- Papers summarized: "), F.col("paper_count").cast("string")), some(F.col("summary"), "Summary"), some(F.array_join("main_themes", ", "), "Main themes"))
    own = collections.agg(F.array_sort(F.collect_list(F.struct("collection_key", part.alias("part")))).alias("_c"))  # a row a collection of one library
    themes = _listed(F.col("themes"), lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["summary"]))
    titled = lambda name, body: F.when(body.isNotNull(), F.concat(F.lit(f"## {name}\n\n"), body, F.lit("\n")))
    rows = library.withColumn("_k", F.lit(1)).join(own.withColumn("_k", F.lit(1)), "_k")  # one row to one row
    return rows.select(_text(F.lit("# Library Memory\n"), titled("Overview", T.blank_to_null(F.col("overview"))), F.lit("## Collections\n"), F.array_join(F.transform("_c", lambda x: x["part"]), "\n"), titled("Global Themes", themes)).alias("markdown"))


def validation_markdown(facts: DataFrame) -> DataFrame:
    """markdown of a validation's facts (pos, section, name, value): the first section's as a list, the others' as tables of their own."""
    line = F.when(F.col("section") == "", F.concat(F.lit("- "), "name", F.lit(": "), "value")).otherwise(F.concat(F.lit("| "), "name", F.lit(" | "), "value", F.lit(" |")))
    parts = facts.groupBy("section").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    part = F.when(F.col("section") == "", body).otherwise(F.concat(F.lit("## "), "section", F.lit("\n\n"), body))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("ps"))
    return whole.select(F.concat(F.lit("# Validation report\n\n"), F.array_join(F.transform("ps", lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("markdown"))


def validation_report(before: DataFrame, after: DataFrame, converts: bool = True) -> DataFrame:
    """Issues by stage, and the verdict: none before, and none after unless nothing was converted."""
    both = before.select(F.lit("before").alias("stage")).unionByName(after.select(F.lit("after").alias("stage")))
    of = lambda s: F.count_if(F.col("stage") == s)
    return both.agg(of("before").alias("before"), of("after").alias("after"), ((of("before") == 0) & ((of("after") == 0) | F.lit(not converts))).alias("ok"))


def run_report(runs: DataFrame) -> DataFrame:
    """Of each run: its first and last time, events, and whether it finished."""
    return runs.groupBy("run_id").agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count("*").alias("events"), F.bool_or(F.col("event") == "run-finished").alias("finished"))
