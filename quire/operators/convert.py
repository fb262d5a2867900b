"""Import and conversion of documents into records: new bundles, results taken into records, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import ingest as I
from quire.sources.sinks import collection_root

#: What a record has besides its metadata.
STATUS = "import_status", "conversion", "metadata_status", "naming_status"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def rendered_name(metadata: Column, otherwise: Column, most: int = 180, ascii_only: bool = False) -> Column:
    """A bundle's name out of metadata, or else of what it is called so far, as file systems accept it."""
    who = F.get(metadata["creators"], F.lit(0))["name"]
    shown = F.coalesce(T.blank_to_null(M.display_name(who, metadata["year"], metadata["title"], metadata["language"])), otherwise)
    return T.ascii_slug(shown, most) if ascii_only else T.file_name(shown, most)


def imported(files: DataFrame, papers: DataFrame, at: Column, collection: str | None = None, config: dict | None = None) -> DataFrame:
    """The records of new documents out of files (id, path, pdf_title, pdf_author): the first path of each id that no paper has.

    Names are made unique within the folder they go to; without a collection that is the inbox.
    """
    clean = ((config or {}).get("naming") or {}).get("sanitize") or {}
    new = I.import_plan(files.select("id", "path"), papers).where("action = 'import'").join(files.dropDuplicates(["id", "path"]), ["id", "path"])
    root = F.coalesce(T.blank_to_null(F.concat(F.lit("collections/"), collection_root(F.lit(collection)))), F.lit("inbox"))
    details = M.fast_metadata(M.file_name_details(file_stem(F.col("path"))), M.pdf_details(F.col("pdf_title"), F.col("pdf_author")))
    rows = new.select("id", "path", details.alias("d"), root.alias("root")).withColumn("own", rendered_name(F.col("d.metadata"), file_stem(F.col("path")), clean.get("max_length", 180), clean.get("ascii_slug", False)))
    taken = papers.select(I.parent(F.col("bundle_path")).alias("root"), F.element_at(F.split("bundle_path", "/"), -1).alias("own"))
    named = I.unique_names(rows, "root", "own", "path", taken).select(F.col("path").alias("_p"), "unique_name")
    rows = rows.join(named, F.col("path") == F.col("_p"))
    return rows.select(
        "id", F.col("unique_name").alias("name"), F.lit(collection).cast("string").alias("collection"), F.concat_ws("/", "root", "unique_name").alias("bundle_path"), "d.metadata", F.col("d.sources").alias("metadata_sources"), F.col("d.confidence").alias("metadata_confidence"),
        F.lit(1).alias("schema_version"), F.lit(False).alias("name_locked"), F.array().cast("array<string>").alias("previous_names"), F.lit("done").alias("import_status"), F.lit("pending").alias("conversion"), F.lit("partial").alias("metadata_status"), F.lit("fast").alias("naming_status"),
        F.struct(F.lit("local-folder").alias("type"), F.col("path").alias("imported_from"), F.lit("original.pdf").alias("copied_pdf"), at.alias("imported_at")).alias("source"),
    )


def merged_details(old: Column, new: Column) -> Column:
    """(metadata, sources, confidence): field by field a value that isn't blank replaces one of no higher confidence.

    A title that looks like a bad conversion is not taken; if the old title ends with the new one,
    what stands before it is the creator, where the document states none.
    """

    def known(o: Column, n: Column) -> Column:
        said = F.when(F.size(n["metadata"]["creators"]) > 0, n["metadata"]["creators"])
        before = M.creator_before_title(F.coalesce(o["metadata"]["title"], F.lit("")), F.coalesce(n["metadata"]["title"], F.lit("")))
        bad = M.bad_converted_title(o["metadata"]["title"], n["metadata"]["title"])
        return T.let(merged, o, n, said, before, bad)

    def merged(o: Column, n: Column, said: Column, before: Column, bad: Column) -> Column:
        guessed = said.isNull() & before.isNotNull()
        who = F.coalesce(said, F.when(before.isNotNull(), F.array(F.struct(before.alias("name"), F.lit("author").alias("role")))))
        values = {k: n["metadata"][k] for k in ("year", "language", "doi")} | {"title": F.when(~bad, T.blank_to_null(n["metadata"]["title"])), "creators": who}
        label = lambda side, k, guess: F.when(guessed, guess).otherwise(n[side][k]) if k == "creators" else n[side][k]
        record, sources, confidence = [], [], []
        for k in ("title", "creators", "year", "language", "doi"):
            take = values[k].isNotNull() & (M.rank(label("confidence", k, "medium")) >= M.rank(o["confidence"][k]))
            record.append(F.when(take, values[k]).otherwise(o["metadata"][k]).alias(k))
            for out, side, guess in ((sources, "sources", "filename-title-prefix"), (confidence, "confidence", "medium")):
                value = F.when(take, F.coalesce(label(side, k, guess), o[side][k])).otherwise(o[side][k])
                out.append(T.let(lambda v, k=k: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))), value))
        listed = lambda entries: F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))
        return F.struct(F.struct(*record).alias("metadata"), listed(sources).alias("sources"), listed(confidence).alias("confidence"))

    return T.let(known, old, new)


def finished(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Records after results (bundle_path, ok, markdown, split) of conversions, with bad_title; papers without a result stay as they are.

    Documents that were converted in parts keep their metadata.
    """
    texts = results.select(F.col("bundle_path").alias("_b"), F.col("ok").alias("_ok"), F.col("markdown").alias("_md"), (F.coalesce("split", F.lit(False)) if "split" in results.columns else F.lit(False)).alias("_split"))
    rows = papers.join(texts, F.col("bundle_path") == F.col("_b"), "left")
    clean = lambda x: T.strip(T.without_controls(x))
    title = F.coalesce(F.col("metadata.title"), F.lit(""))
    rows = rows.withColumn("_lines", F.transform(T.lines(F.coalesce("_md", F.lit(""))), clean))
    rows = rows.withColumn("_f", M.leading_fields(F.col("_lines"))).withColumn("_top", F.slice("_lines", 1, 60)).drop("_lines")
    rows = rows.withColumn("_page", I.title_page_authors(F.col("_top"), F.col("_f.heading").isNotNull()))
    rows = rows.withColumn("_new", M.extracted(F.coalesce("_md", F.lit("")), F.col("_f"), F.col("_page"), title))
    bad = M.bad_converted_title(title, F.coalesce("_f.heading", F.lit("")))
    use = F.coalesce(F.col("_ok") & ~F.col("_split"), F.lit(False))
    old = F.struct("metadata", F.col("metadata_sources").alias("sources"), F.col("metadata_confidence").alias("confidence"))
    rows = rows.withColumn("_d", F.when(use, merged_details(old, F.col("_new")))).withColumn("bad_title", use & bad)
    kept = lambda c, side: F.when(use, F.col(f"_d.{side}")).otherwise(F.col(c)).alias(c)
    record = F.when(use, F.col("_d.metadata")).otherwise(F.col("metadata"))
    rows = rows.withColumn("_title", record["title"])
    status = {
        "conversion": F.when(F.col("_ok"), "done").when(~F.col("_ok"), "failed").otherwise(F.col("conversion")),
        "metadata_status": F.when(F.col("_ok"), F.when(F.coalesce("_title", F.lit("")) != "", "complete").otherwise("partial")).otherwise(F.col("metadata_status")),
        "naming_status": F.when(F.col("_ok"), F.when(F.col("bad_title"), "review").otherwise("metadata")).otherwise(F.col("naming_status")),
    }
    made = {"metadata": record.alias("metadata"), "metadata_sources": kept("metadata_sources", "sources"), "metadata_confidence": kept("metadata_confidence", "confidence")} | {k: v.alias(k) for k, v in status.items()}
    return rows.select(*(made.get(c, F.col(c)) for c in papers.columns), "bad_title")


def renamed(papers: DataFrame, at: Column, wanted: Column | None = None, config: dict | None = None) -> DataFrame:
    """Records under the names that their metadata give, unique in their folder, with old_path; their former names are kept.

    Locked names and names that are to be reviewed stay, as do those for which ``wanted`` is false, and all where settings say so.
    """
    naming = (config or {}).get("naming") or {}
    clean = naming.get("sanitize") or {}
    free = ~F.coalesce("name_locked", F.lit(False)) & ~F.col("naming_status").eqNullSafe("review") & (F.lit(True) if wanted is None else wanted) & F.lit(naming.get("rename_on_convert", True))
    last = F.element_at(F.split("bundle_path", "/"), -1)
    rows = papers.withColumn("_root", I.parent(F.col("bundle_path"))).withColumn("_own", F.when(free, rendered_name(F.col("metadata"), F.col("name"), clean.get("max_length", 180), clean.get("ascii_slug", False))).otherwise(last))
    stay = rows.where(F.col("_own") == last).select(F.col("_root"), F.col("_own"))
    moved = rows.where(F.col("_own") != last)
    named = I.unique_names(moved, "_root", "_own", "bundle_path", stay).select(F.col("bundle_path").alias("_b"), F.col("unique_name").alias("_new"))
    rows = rows.join(named, F.col("bundle_path") == F.col("_b"), "left")
    changed = F.col("_new").isNotNull()
    name = F.when(changed, F.col("_new")).when(free, F.col("_own")).otherwise(F.col("name"))
    before = F.when(changed & (F.coalesce("name", F.lit("")) != ""), F.array_distinct(F.array_append("previous_names", F.col("name")))).otherwise(F.col("previous_names"))
    made = {"name": name.alias("name"), "previous_names": before.alias("previous_names"), "bundle_path": F.when(changed, F.concat_ws("/", F.when(F.col("_root") != "", F.col("_root")), "_new")).otherwise(F.col("bundle_path")).alias("bundle_path")}
    return rows.select(*(made.get(c, F.col(c)) for c in papers.columns), F.when(changed, F.col("bundle_path")).alias("old_path"), F.when(changed, at).alias("renamed_at"))
