"""Import and conversion: de-duplication, naming, page splits, merges by confidence, batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.session import kept


def import_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds action to files (id, path): 'import' for the first path of a new id, else 'skip'.

    The first path is a minimum, so a hot id shrinks before the shuffle.
    """
    first = files.groupBy("id").agg(F.min(F.struct(F.split("path", "/").alias("k"), "path"))["path"].alias("_first"))
    known = existing.select(F.col("id")).distinct().withColumn("_known", F.lit(True))
    decided = first.join(known, "id", "left").select(F.col("id").alias("_id"), "_first", F.coalesce("_known", F.lit(False)).alias("_known"))
    rows = files.join(decided, F.col("id") == F.col("_id"))
    return rows.select("id", "path", F.when((F.col("path") == F.col("_first")) & ~F.col("_known"), "import").otherwise("skip").alias("action"))


def parent(path: Column) -> Column:
    """The folder of a path."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def ranked(items: DataFrame, *order: Column, by: str | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank from 0 of each row in order, within each value of ``by``.

    Without ``by`` rows are sorted by ranges, and each partition's ranks start after
    the rows before it: no task holds the table.  The sorted rows are checkpointed, as
    partitions are numbered in one pass and counted in another.
    """
    if by:
        return items.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    placed = items.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1))
    placed = kept(placed)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rows = placed.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return rows.withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_p", "_before")


def chunks(items: DataFrame, size: int, *order: Column, by: str | None = None) -> DataFrame:
    """Adds chunk: runs of ``size`` items in order, within each value of ``by``."""
    return ranked(items, *order, by=by, name="_rank").withColumn("chunk", F.floor(F.col("_rank") / size).cast("int")).drop("_rank")


def page_parts(docs: DataFrame, most: int, key: str = "paper_id", pages: str = "pages") -> DataFrame:
    """Ranges of at most ``most`` pages, from 1, both ends included; unknown counts and most <= 0 are not split."""
    if most <= 0:
        return docs.select(key, F.lit(1).alias("part"), F.lit(1).alias("page_start"), F.col(pages).cast("int").alias("page_end"))
    starts = F.when(F.col(pages) > 0, F.sequence(F.lit(1), F.col(pages).cast("int"), F.lit(most))).otherwise(F.array(F.lit(1)))
    return docs.select(key, pages, F.posexplode(starts).alias("i", "page_start")).select(key, (F.col("i") + 1).alias("part"), "page_start", F.least(F.col("page_start") + most - 1, F.col(pages)).cast("int").alias("page_end"))


def merge_parts(parts: DataFrame, key: str = "paper_id") -> DataFrame:
    """All or nothing by paper: ok, parts, the first failed part's error, and the joined Markdown.

    Each part begins with a comment that states its pages, where page_start and page_end
    are columns, and has its images under its own folder, however they are named there.
    """
    place = F.format_string("part-%03d", "part")
    pages = F.format_string(" pages %d-%d", "page_start", "page_end") if "page_start" in parts.columns else F.lit("")
    moved = F.regexp_replace(F.col("markdown"), F.lit(r"(\]\(|[\"'])(?:\./|\.|/)?images/"), F.concat(F.lit("$1images/"), place, F.lit("/")))
    body = F.concat(F.format_string("<!-- part %d", "part"), pages, F.lit(" -->\n"), T.strip(moved), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", body.alias("body")))), lambda x: x["body"]), "\n")
    merged = parts.groupBy(key).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("parts"), F.min_by("error", F.when(~F.col("ok"), F.col("part"))).alias("error"), joined.alias("markdown"))
    return merged.withColumn("markdown", F.when(F.col("ok"), F.col("markdown")))


def split_provenance(parts: DataFrame, most: int, key: str = "paper_id") -> DataFrame:
    """key, raw: how a document was split, and what became of each part, as one value."""
    fields = ("part", "page_start", "page_end", "data_id", "batch_id", "remote_state", "ok", "error", "zip_url")
    own = F.struct(*(F.col(c) for c in fields))
    rows = parts.groupBy(key).agg(F.max("page_end").alias("_pages"), F.array_sort(F.collect_list(own)).alias("_parts"))  # parts of one document
    return rows.select(key, F.struct(F.lit(True).alias("split"), F.lit(most).alias("max_pages_per_part"), F.col("_pages").alias("page_count"), F.col("_parts").alias("split_parts")).alias("raw"))


def merge_by_confidence(existing: DataFrame, update: DataFrame, key: str = "paper_id") -> DataFrame:
    """Field by field: a value that isn't blank replaces one of no higher confidence.

    Both sides are (key, field, value, source, confidence).  Titles that look like
    bad conversions are not taken.
    """
    e = existing.select(F.col(key), "field", F.col("value").alias("ev"), F.col("source").alias("es"), F.col("confidence").alias("ec"))
    u = update.where("value is not null and value <> ''").select(F.col(key), "field", F.col("value").alias("uv"), F.col("source").alias("us"), F.col("confidence").alias("uc"))
    both = e.join(u, [key, "field"], "full_outer")
    bad = (F.col("field") == "title") & M.bad_converted_title(F.col("ev"), F.col("uv"))
    take = F.col("uv").isNotNull() & ~bad & (M.rank(F.col("uc")) >= M.rank(F.col("ec")))
    pick = lambda new, old: F.when(take, F.coalesce(new, old)).otherwise(old)
    return both.select(key, "field", F.when(take, F.col("uv")).otherwise(F.col("ev")).alias("value"), pick(F.col("us"), F.col("es")).alias("source"), pick(F.col("uc"), F.col("ec")).alias("confidence")).where("value is not null")


def attempts(previous: DataFrame, items: DataFrame, key: str = "bundle_path") -> DataFrame:
    """Adds attempt: one more than the previous, of which a missing one is 0."""
    before = previous.select(F.col(key).alias("_key"), F.col("attempt").alias("_before"))
    return items.join(before, F.col(key) == F.col("_key"), "left").withColumn("attempt", (F.coalesce("_before", F.lit(0)) + 1).cast("int")).drop("_key", "_before")


# States in which polling stops.
TERMINAL = ("done", "failed", "error", "cancelled")


def remote_results(statuses: DataFrame, items: DataFrame, turn: str = "turn") -> DataFrame:
    """The last status of each known item, and whether it is final."""
    last = statuses.groupBy("data_id").agg(F.max_by(F.struct("state", "error"), turn).alias("x"))
    return items.join(last, "data_id").select(*items.columns, "x.state", "x.error", F.col("x.state").isin(*TERMINAL).alias("final"))


def resumable(items: DataFrame, by: str = "chunk", converter: str | None = None) -> DataFrame:
    """For each chunk: the one batch id that all its items run under with this converter, if there is one."""
    own = F.lit(True) if converter is None else F.col("converter").eqNullSafe(converter)
    usable = F.when((F.col("state") == "running") & own & (F.col("data_id") != "") & (F.col("batch_id") != ""), F.col("batch_id"))
    n = F.count("*")
    return items.groupBy(by).agg(F.when((n == F.count(usable)) & (F.min(usable) == F.max(usable)), F.min(usable)).alias("batch_id"))


def batch_rows(results: DataFrame, items: DataFrame, key: str = "bundle_path") -> DataFrame:
    """Results with the record, attempt and time of the item they are for; results of no item are left out."""
    own = items.select(F.col(key).alias("_k"), *(F.col(c).alias(f"item_{c}") for c in items.columns if c != key))
    return results.join(own, F.col(key) == F.col("_k")).drop("_k")


def unique_names(items: DataFrame, root: str = "root", name: str = "name", order: str = "path", existing: DataFrame | None = None) -> DataFrame:
    """Adds unique_name: the name, or name-2, name-3, ... where it is taken, one after the other.

    Greedy: a suffixed name can itself be taken by another item's own name.  What
    depends on each other shares the name without suffixes, so those groups are
    worked on, not whole roots.  A group streams through its task in order; kept are its
    names and each one's next number, so that equal names cost no more than others.
    """
    stem = F.regexp_replace(F.col(name), r"(-\d+)+\z", "")
    rows = items.select(root, stem.alias("_stem"), F.col(name).alias("_name"), F.col(order).alias("_order"), F.lit(False).alias("_taken"))
    if existing is not None:
        taken = existing.select(root, F.regexp_replace(F.col(name), r"(-\d+)+\z", "").alias("_stem"), F.col(name).alias("_name"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"), F.lit(True).alias("_taken"))
        rows = rows.unionByName(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted: groups one after the other, taken names first.
        group, used, free = None, set(), {}
        for batch in batches:
            out = []
            for at, key, own, taken in zip(*(batch.column(c).to_pylist() for c in (root, "_stem", "_name", "_taken")), strict=True):
                if (at, key) != group:
                    group, used, free = (at, key), set(), {}
                if not taken:
                    found = own
                    if found in used:
                        k = free.get(own, 2)
                        while (found := f"{own}-{k}") in used:
                            k += 1
                        free[own] = k + 1
                    out.append(found)
                    used.add(found)
                else:
                    used.add(own)
                    out.append(None)
            kept = batch.append_column("unique_name", pa.array(out, pa.string())).filter(pc.invert(batch.column("_taken")))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in (root, "_name", "_order", "unique_name")], [root, name, order, "unique_name"])

    kinds = {c: items.schema[c].dataType.simpleString() for c in (root, name, order)}
    dealt = rows.repartition(root, "_stem").sortWithinPartitions(root, "_stem", F.col("_taken").desc(), "_order")
    return dealt.mapInArrow(run, f"`{root}` {kinds[root]}, `{name}` {kinds[name]}, `{order}` {kinds[order]}, unique_name string")


# Words of lines on a title page that are no authors.
NOT_AUTHORS = ("@", "abstract", "institute", "university", "laboratory", "department", "copyright", "doi", "arxiv", "received", "accepted", "published", "http", "www.", "correspond")
NOT_AUTHORS_CJK = ("大学", "学院", "研究所", "研究院", "实验室", "重点实验室", "中心", "系", "中国科学院")


#: Longest line, and longest one that goes on with another; least length of a line of names, and with Han characters; most digits and names.
LONGEST, LONGEST_PART, SHORTEST, SHORTEST_CJK, MOST_DIGITS, MOST_NAMES = 240, 120, 5, 2, 2, 20


def names_nobody(line: Column) -> Column:
    """Whether a line has a word that lines of authors don't have."""
    low = F.lower(line)
    return reduce(Column.__or__, [low.contains(m) for m in NOT_AUTHORS] + [line.contains(m) for m in NOT_AUTHORS_CJK])


def lists_names(line: Column) -> Column:
    """Whether something stands between names."""
    return line.contains(",") | line.contains(";") | F.lower(line).contains(" and ")


def may_be_authors(line: Column) -> Column:
    """Whether a line, by its form, is one of authors."""
    long = F.when(line.rlike(T.CJK), SHORTEST_CJK).otherwise(SHORTEST)
    names = F.size(F.filter(F.split(line, r" and |[,;]"), lambda x: T.strip(x) != ""))
    few = (F.regexp_count(line, F.lit(r"\p{N}")) <= MOST_DIGITS) & names.between(1, MOST_NAMES)
    return (F.length(line) <= LONGEST) & (F.length(line) >= long) & lists_names(line) & few & ~names_nobody(line)


def title_page_authors(lines: Column, has_title: Column) -> Column:
    """The author line under the title: lines that go on with each other, or else the first line of authors' form.

    ``lines`` are those of a title page, stripped; array functions over them, no Python.
    """
    heading = lambda x: x.rlike(r"\A#{1,6}\s")
    usable = lambda x: (x != "") & ~heading(x) & (F.length(x) <= LONGEST_PART) & ~names_nobody(x)
    seen = lambda x: F.struct(x.alias("line"), (heading(x) & x.startswith("# ")).alias("title"), usable(x).alias("usable"), lists_names(x).alias("lists"), (~heading(x) & may_be_authors(x)).alias("whole"))
    at = lambda rows, i: F.get(rows, i)

    def start(rows: Column, titled: Column) -> Column:
        number = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: i < F.size(rows))
        title = F.get(F.filter(number, lambda i: at(rows, i)["title"]), F.lit(0))
        return T.let(below, rows, number, F.when(titled, F.coalesce(title + 1, F.lit(1 << 20))).otherwise(0))

    def below(rows: Column, number: Column, begins: Column) -> Column:
        first = F.get(F.filter(number, lambda i: (i >= begins) & at(rows, i)["usable"]), F.lit(0))
        single = F.get(F.filter(number, lambda i: (i >= begins) & (i < 30) & at(rows, i)["whole"]), F.lit(0))
        return T.let(fragment, rows, number, first, single)

    def fragment(rows: Column, number: Column, first: Column, single: Column) -> Column:
        # It ends at the first line below that can't go on with the one before it.
        goes_on = lambda i: at(rows, i)["usable"] & (at(rows, i - 1)["line"].rlike(r"[,;]\z") | at(rows, i)["lists"])
        end = F.coalesce(F.get(F.filter(number, lambda i: (i > first) & ~goes_on(i)), F.lit(0)), F.size(rows))
        group = F.array_join(F.transform(F.slice(rows, first + 1, F.greatest(end - first, F.lit(0))), lambda x: x["line"]), " ")
        return T.let(lambda g, s: F.coalesce(F.when(may_be_authors(g), g), s), group, at(rows, single)["line"])

    return T.let(start, F.transform(lines, seen), has_title)


def with_title_page_authors(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Adds authors_line, out of the first 60 lines."""
    clean = lambda x: T.strip(T.without_controls(x))
    whole = T.lines(F.coalesce(F.col(markdown), F.lit("")))
    rows = docs.withColumn("_top", F.transform(F.slice(whole, 1, 60), clean)).withColumn("_titled", F.exists(whole, lambda x: clean(x).startswith("# ")))
    return rows.withColumn("authors_line", title_page_authors(F.col("_top"), F.col("_titled"))).drop("_top", "_titled")
