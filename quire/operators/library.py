"""Reading a library: listings, look-ups with their three predicates, status, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

ROOT = "__root__"


def in_path_order(df: DataFrame, path: str = "bundle_path") -> DataFrame:
    """Paths compare by components, so 'a/x' comes before 'a b/x'."""
    return df.orderBy(F.split(path, "/"))


def pending(papers: DataFrame) -> DataFrame:
    return papers.where(~F.col("conversion").eqNullSafe("done"))


def status(papers: DataFrame) -> DataFrame:
    """One row of counts."""
    c = F.col("conversion")
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return papers.agg(
        F.count("*").alias("total"),
        count(c == "done").alias("converted"),
        count(c == "failed").alias("failed"),
        F.count_if(~F.coalesce(c.isin("done", "failed"), F.lit(False))).alias("pending"),
        F.count_if(~F.coalesce(F.col("metadata_status") == "complete", F.lit(False))).alias("incomplete_metadata"),
        count(F.col("n_previous_names") > 0).alias("renamed"),
    )


def match_reasons(query: str, path: str | None = None) -> Column:
    """Why a paper matches a look-up: equality and prefixes by case, substrings without."""
    low = F.lit(query.lower())
    within = lambda c: F.lower(c).contains(low)
    rules = [
        F.when(F.col("bundle_path") == F.lit(path), "path") if path else None,
        F.when(F.col("id") == query, "id").when(F.col("id").startswith(query), "id-prefix"),
        F.when(F.col("name") == query, "name").when(within(F.col("name")), "name-substring"),
        F.when(F.col("bundle_path") == query, "relative-path").when(within(F.col("bundle_path")), "relative-path-substring"),
        F.when(within(F.col("title")), "title-substring"),
    ]
    return F.filter(F.array(*(r for r in rules if r is not None)), lambda x: x.isNotNull())


def resolve(papers: DataFrame, query: str, path: str | None = None) -> DataFrame:
    """The papers that match, with their reasons; a blank query matches none."""
    query = query.strip()
    found = papers.withColumn("reasons", match_reasons(query, path)).where(F.size("reasons") > 0)
    return found if query else found.limit(0)


def resolved_one(matches: DataFrame) -> DataFrame:
    """One row: found, not found, or ambiguous."""
    n = F.count("*")
    return matches.agg(n.alias("matches"), F.when(n == 1, "found").when(n == 0, "not found").otherwise("ambiguous").alias("verdict"), F.when(n == 1, F.min("id")).alias("id"))


def bundle_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extract_match(query: str) -> Column:
    """The predicate of summary extraction: a prefix, by case."""
    if not query:
        return F.lit(True)
    return F.col("id").startswith(query) | bundle_name(F.col("bundle_path")).startswith(query) | F.col("name").startswith(query)


def repair_match(query: str) -> Column:
    """The predicate of repair: a substring, without case; titles don't count."""
    if not query:
        return F.lit(True)
    return F.lower("id").contains(query.lower()) | F.lower("name").contains(query.lower()) | F.lower("bundle_path").contains(query.lower())


def collection_name(c: Column) -> Column:
    """A collection reference without its leading folder and slashes."""
    flat = T.strip(F.replace(c, F.lit("\\"), F.lit("/")))
    return T.strip_chars(F.regexp_replace(flat, r"\Acollections/", ""), "/")


def memory_collection(c: Column) -> Column:
    """A collection out of the path of anything in it or of its memory."""
    parts = F.filter(F.split(T.strip_chars(T.strip(c), "/"), "/"), lambda x: (x != "") & (x != "."))
    parts = F.when(F.get(parts, F.lit(0)) == "collections", F.slice(parts, 2, 1 << 20)).otherwise(parts)
    at = F.array_position(parts, "_memory").cast("int")
    parts = F.when(at > 0, F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(parts)
    last = F.get(parts, F.size(parts) - 1)
    parts = F.when(last.rlike(r"\.(json|md)\z"), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(T.strip_chars(T.strip(c), "/") == "", "").when(F.size(parts) == 0, ROOT).otherwise(F.array_join(parts, "/"))


def repair_collection(query: str) -> Column:
    if not query:
        return F.lit(True)
    name = query.replace("\\", "/").strip().removeprefix("collections/").strip("/")
    if name == "inbox":
        return F.col("collection").isNull()
    return collection_name(F.coalesce("collection", F.lit(""))) == name


def collection_key(collection: Column, path: Column) -> Column:
    """A paper's collection, else that of its path, else the root."""
    parts = F.split(path, "/")
    inner = F.when((F.get(parts, F.lit(0)) == "collections") & (F.size(parts) >= 3), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/"))
    return F.coalesce(T.blank_to_null(collection), inner, F.lit(ROOT))


def candidates(papers: DataFrame, where: Column, limit: int | None = None) -> DataFrame:
    """Converted papers that have their Markdown and match, in path order; a limit of 0 still gives one."""
    found = papers.where("has_markdown and conversion = 'done'").where(where)
    return found if limit is None else in_path_order(found).limit(max(limit, 1))


def matches_collection(selected: str | set[str] | None, collection: Column | None = None) -> Column:
    """Whether a collection is the one asked for, or one of several; asked for none, all are."""
    own = F.col("collection") if collection is None else collection
    if not selected:
        return F.lit(True)
    return own.isin(*sorted(selected)) if isinstance(selected, set) else own == selected


def listing(papers: DataFrame) -> DataFrame:
    return papers.select("id", "name", "collection", "conversion", "metadata_status", "bundle_path")


#: The columns of the paper index, where a record has them.
INDEXED = ("id", "name", "collection", "bundle_path", "title", "creators", "year", "language", "metadata_sources", "metadata_confidence", "conversion", "metadata_status", "naming_status", "import_status")


def index_rows(papers: DataFrame) -> DataFrame:
    """The rows of the paper index, a table derived from the records."""
    return papers.select(*(c for c in INDEXED if c in papers.columns))


def detail_rows(papers: DataFrame) -> DataFrame:
    """What is told of one paper: its listing and all else that its record holds."""
    first = listing(papers).columns
    return papers.select(*first, *(c for c in papers.columns if c not in first))


def nearest_bundle(queries: DataFrame, papers: DataFrame, path: str = "path") -> DataFrame:
    """Each path's nearest bundle above it, by the path's own ancestors: an equi-join on folders."""
    parts = F.split(path, "/")
    above = queries.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))).alias("a"))
    hit = above.join(papers.select(F.col("bundle_path").alias("folder")), F.col("a.folder") == F.col("folder"))
    return hit.groupBy(path).agg(F.max_by("folder", "a.depth").alias("bundle_path"))


def artifacts(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Of each expected (bundle_path, artifact, path): whether it exists, its kind and bytes."""
    there = files.select(F.col("path").alias("_path"), "kind", "bytes")
    return expected.join(there, F.col("path") == F.col("_path"), "left").select("bundle_path", "artifact", "path", F.col("_path").isNotNull().alias("exists"), "kind", F.when(F.col("kind") == "file", F.col("bytes")).alias("bytes"))


def census(files: DataFrame) -> DataFrame:
    """Files and folders by name."""
    return files.groupBy(bundle_name(F.col("path")).alias("name"), "kind").agg(F.count("*").alias("n"))


def seeded_sample(files: DataFrame, n: int, seed: int, path: str = "path", whole: bool = False) -> DataFrame:
    """n rows in the order of a hash of seed and path: the same on each run.  With ``whole``, fewer rows than that are an error."""
    if whole and (there := files.limit(n).count()) < n:
        raise ValueError(f"a sample of {n} was asked for, but there are only {there}")
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(path)), 256)
    return files.withColumn("turn", turn).orderBy("turn", path).limit(n).drop("turn")


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key.  Ranked with a limit, so each task keeps one row a key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


# What a bundle may hold, and where.
ARTIFACTS = {
    "paper_yaml": "paper.yaml", "original_pdf": "original.pdf", "paper_md": "paper.md", "images_dir": "images", "raw_dir": "raw/converter", "conversion_json": "conversion.json", "repair_json": "repair.json",
    "summary_json": "extracts/summary/summary.json", "summary_md": "extracts/summary/summary.md", "source_map_json": "extracts/summary/source-map.json",
}
#: Those of which the content is told too, by the name it has there.
SIDECARS = {"conversion_file": "conversion_json", "repair_file": "repair_json", "summary_file": "summary_json", "source_map_file": "source_map_json"}


def expected_artifacts(papers: DataFrame) -> DataFrame:
    """bundle_path, artifact, path: a row for each artifact that a bundle may hold."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("artifact"), F.lit(at).alias("at")) for name, at in ARTIFACTS.items()))).alias("a")
    return papers.select("bundle_path", each).select("bundle_path", "a.artifact", F.concat_ws("/", "bundle_path", "a.at").alias("path"))


def inspected(papers: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers with artifacts (a map by name of path, exists, kind, bytes) and the content of their sidecars as JSON.

    ``files`` are (path, kind, bytes), ``texts`` (path, text) of sidecar files.  A bundle has a fixed
    number of artifacts, so each side is brought to a row a bundle by one grouped aggregate.
    """
    from quire.sources.files import json_value

    found = artifacts(expected_artifacts(papers), files)
    one = found.groupBy("bundle_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact", F.struct("path", "exists", "kind", "bytes").alias("state"))))).alias("artifacts"))
    content = expected_artifacts(papers).join(texts.select(F.col("path"), json_value(F.col("text")).alias("json")), "path")
    two = content.groupBy("bundle_path").agg(*(F.max(F.when(F.col("artifact") == artifact, F.col("json"))).alias(name) for name, artifact in SIDECARS.items()))
    return papers.join(one, "bundle_path", "left").join(two, "bundle_path", "left")
