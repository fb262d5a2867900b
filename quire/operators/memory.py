"""Paper, collection and library memory: ordered roll-ups, staleness by hashes, keyed state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.library import first_by, memory_collection

# Fixed values.
IMPORTANCE = {"high": 3, "medium": 2, "low": 1}
MATERIAL_TYPES = ("dataset_or_sample", "instrument")
#: Column to Column: how texts are stripped, and what makes two of them equal.
Form = Callable[[Column], Column]


def importance_rank(c: Column) -> Column:
    value = F.coalesce(T.blank_to_null(c), F.lit("medium"))
    return F.coalesce(*(F.when(value == k, v) for k, v in IMPORTANCE.items()), F.lit(0))


def important_blocks(blocks: DataFrame, key: str = "paper_id", n: int = 5) -> DataFrame:
    """key, rank, block_id, section_id: the n most important blocks, then by order.  Ranks are limited, so tasks keep n rows a paper."""
    w = Window.partitionBy(key).orderBy(importance_rank(F.col("importance")).desc(), "order")
    return blocks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, F.col("rank").cast("int").alias("rank"), "block_id", "section_id")


def ordered_distinct(values: DataFrame, key: str, value: str = "value", pos: str = "pos", most: int | None = None, strip: Form = T.strip, lower: Form = F.lower) -> DataFrame:
    """key, values: distinct without regard to case, in order of first appearance, in their first spelling; blanks go."""
    rows = values.withColumn("_v", strip(F.col(value))).where("_v <> ''")
    first = rows.groupBy(key, lower(F.col("_v")).alias("_low")).agg(F.min_by("_v", pos).alias("_v"), F.min(pos).alias("_p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"])
    return first.groupBy(key).agg((listed if most is None else F.slice(listed, 1, most)).alias("values"))


def first_distinct(values: Column, most: int, strip: Form = T.strip, lower: Form = F.lower) -> Column:
    """The first distinct of an array's values, as in ``ordered_distinct``.

    Of several arrays in order these hold all that can be among the first ``most`` of all.
    """
    pick = lambda v, low: F.transform(F.slice(F.array_distinct(low), 1, most), lambda x: F.get(v, (F.array_position(low, x) - 1).cast("int")))
    return T.let(lambda v: T.let(pick, v, F.transform(v, lower)), F.filter(F.transform(values, strip), lambda x: x != ""))


def first_by_role(sections: DataFrame, blocks: DataFrame, role: str, key: str = "paper_id") -> DataFrame:
    """key, text: the first section summary of a role, else the first block summary of it."""
    s = sections.where((F.col("role") == role) & (F.coalesce("summary", F.lit("")) != "")).groupBy(key).agg(F.min_by("summary", "pos").alias("_s"))
    b = blocks.where((F.col("role") == role) & (F.coalesce("summary_text", F.lit("")) != "")).groupBy(key).agg(F.min_by("summary_text", "order").alias("_b"))
    return s.join(b, key, "full_outer").select(key, F.coalesce("_s", "_b").alias("text"))


def material(nodes: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, label: of the first node that names a sample or an instrument."""
    return nodes.where(F.col("type").isin(*MATERIAL_TYPES) & (F.coalesce("label", F.lit("")) != "")).groupBy(key).agg(F.min_by("label", "pos").alias("label"))


def overview(sections: DataFrame, blocks: DataFrame, key: str = "paper_id", strip: Form = T.strip, lower: Form = F.lower, blank: str | None = "") -> DataFrame:
    """key, overview: the distinct summaries of the first two sections; without sections that of the first block, or nothing.

    Of a paper whose only section is blank it is ``blank``.  Both sources meet in one aggregate, where rows without a key are a paper too.
    """
    w = Window.partitionBy(key).orderBy("pos")
    two = sections.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce(strip(F.col("summary")), F.lit("")).alias("v")))).alias("two"))

    def text(values: Column) -> Column:
        a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
        alone = F.when(a == "", F.lit(blank)).otherwise(a)
        return F.when(b.isNull(), alone).when(a == "", b).when((b == "") | (lower(a) == lower(b)), a).otherwise(F.concat(a, F.lit(" "), b))

    heads = two.select(key, F.lit(0).alias("_n"), T.let(text, F.transform("two", lambda x: x["v"])).alias("overview"))
    first = blocks.groupBy(key).agg(F.min_by("summary_text", "order").alias("_b")).select(key, F.lit(1).alias("_n"), F.coalesce(strip(F.col("_b")), F.lit("")).alias("overview"))
    return heads.unionByName(first).groupBy(key).agg(F.min_by(F.struct("overview"), "_n")["overview"].alias("overview"))


def paper_memory(sections: DataFrame, blocks: DataFrame, nodes: DataFrame, key: str = "paper_id", strip: Form = T.strip, lower: Form = F.lower, blank: str | None = "") -> DataFrame:
    """One row a paper: overview, problem, method, material and the lists, all joined on the paper's key."""
    role = lambda r: blocks.where(F.col("role") == r).select(key, F.col("summary_text").alias("value"), F.struct(F.lit(0).alias("a"), F.col("order").cast("long").alias("b"), F.lit(0).alias("c")).alias("pos"))
    of = lambda t: nodes.where(F.col("type") == t).select(key, F.col("label").alias("value"), F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).alias("c")).alias("pos"))
    concepts = blocks.select(key, "order", F.posexplode(first_distinct(F.col("concepts"), 12, strip, lower)).alias("i", "value")).select(key, "value", F.struct(F.lit(0).alias("a"), F.col("order").cast("long").alias("b"), F.col("i").alias("c")).alias("pos"))
    listed = lambda values, most: ordered_distinct(values, key, most=most, strip=strip, lower=lower)
    lists = {
        "key_results": listed(role("result"), 5),
        "limitations": listed(role("limitation").unionByName(of("limitation")), 5),
        "concepts": listed(concepts.unionByName(of("concept")), 12),
        "methods": listed(of("method"), 12),
        "measurements": listed(of("measurement"), 12),
    }
    top = important_blocks(blocks, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_id"))), lambda x: x["block_id"]).alias("important_block_ids"))
    out = overview(sections, blocks, key, strip, lower, blank)
    out = out.join(first_by_role(sections, blocks, "background", key).withColumnRenamed("text", "research_problem"), key, "left")
    out = out.join(first_by_role(sections, blocks, "method", key).withColumnRenamed("text", "method"), key, "left")
    out = out.join(material(nodes, key).withColumnRenamed("label", "system_or_material"), key, "left").join(top, key, "left")
    for name, values in lists.items():
        out = out.join(values.withColumnRenamed("values", name), key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, "overview", *(F.coalesce(c, F.lit("")).alias(c) for c in ("research_problem", "method", "system_or_material")), *(F.coalesce(c, empty).alias(c) for c in ("important_block_ids", *lists)))


def collection_plan(papers: DataFrame) -> DataFrame:
    """Papers by collection: how many, and how many of them are valid or skipped."""
    ok = F.col("verdict") == "ok"
    return papers.groupBy("collection_key").agg(F.count("*").alias("papers"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))


def source_hashes(papers: DataFrame, by: str = "collection_key") -> DataFrame:
    """by, paper_id, hash: what a memory was made from, the last of each paper.

    A row a paper rather than a map a collection: the root has papers without bound, and rows compare by a join.
    """
    return papers.groupBy(by, "paper_id").agg(F.max("hash").alias("hash"))


def stale_by_hash(current: DataFrame, stored: DataFrame, by: str = "collection_key") -> DataFrame:
    """by, stale: whether any paper's hash differs, is new or is gone.  Without stored hashes nothing is stale.

    Hashes are compared row by row after one full join, so a large collection is no large value.
    """
    c = current.select(by, "paper_id", F.col("hash").alias("_c"))
    s = stored.select(by, "paper_id", F.col("hash").alias("_s"))
    rows = c.join(s, [by, "paper_id"], "full_outer")
    return rows.groupBy(by).agg((F.bool_or(~F.col("_c").eqNullSafe(F.col("_s"))) & (F.count("_s") > 0)).alias("stale"))


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State keyed by (scope, key), each key's change in place of its old row."""
    new = first_by(changes.withColumn("_k", F.struct("scope", "key")), "_k", F.col("updated_at").desc(), F.col("reason")).drop("_k")
    old = state.join(new.select("scope", "key"), ["scope", "key"], "left_anti")
    return old.unionByName(new)


def affected(papers: DataFrame, changed: DataFrame) -> DataFrame:
    """Changes that mark changed papers, their collections and the library as stale."""
    rows = papers.join(changed.select("paper_id", "reason", "updated_at"), "paper_id")
    mark = lambda scope, key: rows.groupBy(F.lit(scope).alias("scope"), key.alias("key")).agg(F.lit(True).alias("stale"), F.min("reason").alias("reason"), F.max("updated_at").alias("updated_at"))
    return mark("paper", F.col("paper_id").cast("string")).unionByName(mark("collection", F.col("collection_key"))).unionByName(mark("library", F.lit("library")))


def library_stale(state: DataFrame, rebuilt: list[str]) -> DataFrame:
    """Whether the library stays stale once some collections are rebuilt: if any other collection is."""
    others = (F.col("scope") == "collection") & ~F.col("key").isin(*rebuilt)
    return state.agg(F.coalesce(F.bool_or(others & F.col("stale")), F.lit(False)).alias("stale"))


def library_rollup(memories: DataFrame, response: DataFrame) -> DataFrame:
    """Collections with what the response says of them, by name, and else their own text or a blank; later rows win."""
    said = response.groupBy("collection_key").agg(F.max_by(F.struct("overview"), "pos")["overview"].alias("_o"))
    rows = memories.join(said, "collection_key", "left")
    return rows.select("collection_key", F.coalesce(T.blank_to_null(F.col("_o")), T.blank_to_null(F.col("overview")), F.lit("")).alias("overview"), F.slice("themes", 1, 5).alias("themes"))


def library_counts(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count("*").alias("collections"), F.coalesce(F.sum("papers"), F.lit(0)).alias("papers"), F.coalesce(F.sum(F.size("themes")), F.lit(0)).alias("themes"))


def representatives(memories: DataFrame, valid: DataFrame, by: str = "collection_key") -> DataFrame:
    """Named ids that are valid, in their order."""
    rows = memories.select(by, F.posexplode("ids").alias("i", "id")).join(valid.select(by, "id").distinct(), [by, "id"], "left_semi")
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))


def render_memory(memories: DataFrame, by: str = "collection_key") -> DataFrame:
    """A collection's memory as Markdown: a heading and one item a paper, in order."""
    items = F.array_sort(F.collect_list(F.struct("paper_id", F.concat(F.lit("- "), "title").alias("line"))))
    rows = memories.groupBy(by).agg(items.alias("items"))
    return rows.select(by, F.concat(F.lit("# "), F.col(by), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def not_contained(rows: DataFrame, pos: list[str], ids: str, valid: DataFrame) -> DataFrame:
    """pos of the rows of which ``ids`` names something that is not valid (key columns of ``pos`` it shares, id); nothing named is contained."""
    on = [c for c in valid.columns if c != "id"]
    return rows.select(*pos, F.explode(F.array_distinct(ids)).alias("id")).join(valid, [*on, "id"], "left_anti").select(*pos).distinct()


def _verdicts(rows: DataFrame, pos: list[str], checks: list[tuple[list[str], DataFrame, Column]]) -> DataFrame:
    """Rows with warning: that of the first check (columns of ids, valid ones, text) that fails, else null."""
    reasons = []
    for k, (columns, valid, text) in enumerate(checks):
        for c in columns:
            bad = not_contained(rows.select(*pos, c), pos, c, valid).withColumn(f"_bad{k}_{c}", F.lit(True))
            rows = rows.join(bad, pos, "left")
        failed = F.greatest(*(F.coalesce(f"_bad{k}_{c}", F.lit(False)) for c in columns)) if len(columns) > 1 else F.coalesce(f"_bad{k}_{columns[0]}", F.lit(False))
        reasons.append(F.when(failed, text))
    kept = [c for c in rows.columns if not c.startswith("_bad")]
    return rows.select(*kept, F.coalesce(*reasons).alias("warning"))


def pooled_ids(memories: DataFrame, ids: str, by: str = "collection_key") -> DataFrame:
    """by, id: all that any paper of a collection names in ``ids``, each once."""
    return memories.select(by, F.explode(ids).alias("id")).where("id <> ''").distinct()


def checked_themes(themes: DataFrame, papers: DataFrame, blocks: DataFrame, by: str = "collection_key") -> DataFrame:
    """Themes (by, pos, name, summary, paper_ids, source_block_ids) of a collection's answer, with warning.

    Valid are the collection's papers (by, id), and the important blocks (by, id) of any of them.
    """
    name = F.coalesce("name", F.lit("None"))
    return _verdicts(themes, [by, "pos"], [(["paper_ids"], papers, F.concat(F.lit("Skipped collection theme with unknown paper IDs: "), name)), (["source_block_ids"], blocks, F.concat(F.lit("Skipped collection theme with unknown block IDs: "), name))])


def checked_relations(relations: DataFrame, papers: DataFrame, blocks: DataFrame, by: str = "collection_key") -> DataFrame:
    """Relations (by, pos, type, source_paper_id, target_paper_id, summary, source_block_ids, target_block_ids) with warning."""
    ends = relations.withColumn("_ends", F.array(F.coalesce("source_paper_id", F.lit("")), F.coalesce("target_paper_id", F.lit(""))))
    return _verdicts(ends, [by, "pos"], [(["_ends"], papers, F.lit("Skipped collection relation with unknown paper IDs")), (["source_block_ids", "target_block_ids"], blocks, F.lit("Skipped collection relation with unknown block IDs"))]).drop("_ends")


def checked_collections(answer: DataFrame, memories: DataFrame, papers: DataFrame) -> DataFrame:
    """A library answer's collections (pos, collection_path, summary, main_themes, representative_paper_ids) with warning.

    Paths are normalised; of the representatives the valid papers (id) stay, in their order.
    """
    rows = answer.withColumn("collection_key", memory_collection(F.col("collection_path")))
    known = memories.select("collection_key", F.lit(True).alias("_known")).distinct()
    ids = rows.select("pos", F.posexplode("representative_paper_ids").alias("i", "id")).join(papers.select("id").distinct(), "id", "left_semi")
    kept = ids.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("_ids"))
    rows = rows.join(known, "collection_key", "left").join(kept, "pos", "left")
    text = F.concat(F.lit("Skipped unknown collection in library response: "), "collection_key")
    themes = F.filter(F.coalesce("main_themes", F.array().cast("array<string>")), lambda x: x != "")
    return rows.select("pos", "collection_key", F.coalesce("summary", F.lit("")).alias("summary"), themes.alias("main_themes"), F.coalesce("_ids", F.array().cast("array<string>")).alias("representative_paper_ids"), F.when(F.col("_known").isNull(), text).alias("warning"))


def checked_global_themes(themes: DataFrame, memories: DataFrame, papers: DataFrame) -> DataFrame:
    """Themes (pos, name, summary, collection_paths, paper_ids) of a library's answer, with warning; paths are normalised."""
    rows = themes.withColumn("collection_paths", F.transform("collection_paths", memory_collection))
    text = F.concat(F.lit("Skipped invalid global theme: "), F.coalesce("name", F.lit("None")))
    return _verdicts(rows, ["pos"], [(["collection_paths"], memories.select(F.col("collection_key").alias("id")), text), (["paper_ids"], papers.select("id"), text)])


def checked_cross_relations(relations: DataFrame, memories: DataFrame) -> DataFrame:
    """Relations (pos, type, source_collection_path, target_collection_path, summary) between collections, with warning."""
    rows = relations.withColumn("_ends", F.array(*(memory_collection(F.coalesce(c, F.lit(""))) for c in ("source_collection_path", "target_collection_path"))))
    return _verdicts(rows, ["pos"], [(["_ends"], memories.select(F.col("collection_key").alias("id")), F.lit("Skipped invalid cross-collection relation"))]).drop("_ends")


def warnings_of(*checked: DataFrame) -> DataFrame:
    """kind-free list of all warnings of checked rows, with the row's place."""
    return reduce(DataFrame.unionByName, [c.where("warning is not null").select("pos", "warning") for c in checked])


def library_collections(memories: DataFrame, answer: DataFrame) -> DataFrame:
    """Each collection's row in the library's memory: summary, themes and representatives as answered, and else its own.

    ``memories`` are (collection_key, overview, themes: names, representatives, papers), of the answer's
    valid rows the last of a collection counts; an empty value counts as none.
    """
    last = answer.where("warning is null").groupBy("collection_key").agg(F.max_by(F.struct("summary", "main_themes", "representative_paper_ids"), "pos").alias("_a"))
    rows = memories.join(last, "collection_key", "left")
    listed = lambda a, own: F.when(F.size(a) > 0, a).otherwise(F.coalesce(own, F.array().cast("array<string>")))
    return rows.select(
        "collection_key", F.coalesce(T.blank_to_null(F.col("_a.summary")), T.blank_to_null(F.col("overview")), F.lit("")).alias("summary"), listed(F.col("_a.main_themes"), F.slice("themes", 1, 5)).alias("main_themes"),
        listed(F.col("_a.representative_paper_ids"), F.col("representatives")).alias("representative_paper_ids"), F.col("papers").cast("long").alias("paper_count"),
    )


def other_memories(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored collection memories (path, collection_path, ...) of none of the current collections (collection_key): the first by path of each, without regard to how its path is written."""
    rows = stored.withColumn("collection_key", memory_collection(F.coalesce("collection_path", F.lit("")))).where("collection_key <> ''")
    return first_by(rows.join(current.select("collection_key").distinct(), "collection_key", "left_anti"), "collection_key", F.split("path", "/"))


def union_of_keys(*tables: DataFrame, by: str = "collection_key") -> DataFrame:
    """The keys of any of the tables, each once."""
    return reduce(DataFrame.union, [t.select(by) for t in tables]).distinct()


def repaired_state(raw: DataFrame) -> DataFrame:
    """Memory state rows out of state files (text): sections that aren't mappings are empty, a broken file has no rows but the library's.

    The library always has its row, stale only where the file says so.
    """
    parsed = F.try_parse_json(F.col("text"))
    entry = "struct<stale:boolean,reason:string,updated_at:timestamp>"
    mapping = lambda k: F.coalesce(F.try_variant_get(parsed, f"$.{k}", f"map<string,{entry}>"), F.create_map().cast(f"map<string,{entry}>"))
    library = F.try_variant_get(parsed, "$.library", entry)
    row = lambda scope, k, v: F.struct(F.lit(scope).alias("scope"), k.alias("key"), F.coalesce(v["stale"], F.lit(False)).alias("stale"), v["reason"].alias("reason"), v["updated_at"].alias("updated_at"))
    of = lambda scope, k: F.transform(F.map_entries(mapping(k)), lambda e: row(scope, e["key"], e["value"]))
    return raw.select(F.explode(F.concat(of("paper", "papers"), of("collection", "collections"), F.array(row("library", F.lit("library"), library)))).alias("r")).select("r.*")
