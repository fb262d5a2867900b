"""Markdown documents to typed, section-aware blocks.

All of a document is done inside its row with array functions: line flags, the
first and last lines of blocks, types, sections and the heading stack.  Nothing is
shuffled; one explode at the end makes the block rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values.
NON_MAIN_SECTIONS = (
    "acknowledgements", "acknowledgments", "author contribution", "author contributions", "bibliography", "conflict of interest",
    "conflicts of interest", "copyright", "declaration of competing interest", "funding", "open access", "references",
)

_STACK = "array<struct<level:int,id:string,heading:string>>"
_PLACES = "array<struct<section_id:string,section_path:array<string>>>"


def block_type(t: Column) -> Column:
    return type_of_stripped(T.strip(t))


def type_of_stripped(s: Column) -> Column:
    """The type of a block without white space at its ends. Cheap tests come first: inside a lambda nothing is shared."""
    low = F.lower(s)
    piped = F.forall(F.split(s, "\n"), lambda x: F.ltrim(x, F.lit(T.WHITE)).startswith("|"))
    return (
        F.when(s.startswith("#"), "heading")
        .when(s.startswith("!["), "image")
        .when(s.startswith("$$") | s.endswith("$$"), "formula")
        .when(s.contains("<") & (low.contains("<table") | low.contains("</table>")), "table")
        .when(s.startswith("|") & piped, "table")
        .when((F.length(s) <= 12) & low.isin("references", "bibliography"), "reference")
        .otherwise("paragraph")
    )


def _segmented(docs: DataFrame, markdown: str) -> DataFrame:
    """Adds _blocks: array of (start_line, end_line, text, type, refers, level, heading); the last three are of headings only."""
    docs = docs.withColumn("_lines", T.lines(F.coalesce(F.col(markdown), F.lit(""))))
    # 0: blank, 1: text, 2: starts a block of its own.
    docs = docs.withColumn("_kinds", F.transform("_lines", lambda x: F.when(x.startswith("#"), 2).when(F.ltrim(x, F.lit(T.WHITE)) == "", 0).otherwise(1)))
    at = lambda i: F.get(F.col("_kinds"), i)
    number = F.sequence(F.lit(0), F.size("_lines") - 1)
    first = F.filter(number, lambda i: (at(i) == 2) | (at(i) == 1) & F.coalesce(at(i - 1) == 0, F.lit(True)))
    last = F.filter(number, lambda i: (at(i) > 0) & F.coalesce(at(i + 1) != 1, F.lit(True)))
    docs = docs.withColumn("_spans", F.arrays_zip(first.alias("a"), last.alias("z")))
    text = lambda x: F.array_join(F.slice("_lines", x["a"] + 1, x["z"] - x["a"] + 1), "\n")
    docs = docs.withColumn("_texts", F.transform("_spans", lambda x: F.struct(x["a"].alias("a"), x["z"].alias("z"), text(x).alias("text"))))
    docs = docs.withColumn("_bare", F.transform("_texts", lambda b: F.struct(b["a"].alias("a"), b["z"].alias("z"), b["text"].alias("text"), T.strip(b["text"]).alias("s"))))
    docs = docs.withColumn("_typed", F.transform("_bare", lambda b: F.struct(b["a"].alias("a"), b["z"].alias("z"), b["text"].alias("text"), b["s"].alias("s"), type_of_stripped(b["s"]).alias("type"))))
    bare = lambda b: F.ltrim(b["text"], F.lit("#"))
    full = lambda b: F.struct(
        (b["a"] + 1).alias("start_line"),
        (b["z"] + 1).alias("end_line"),
        b["text"].alias("text"),
        b["type"].alias("type"),
        F.when(b["type"] == "heading", b["s"].rlike(r"(?iU)\A#+\s*(references|bibliography)\b")).otherwise(False).alias("refers"),
        F.when(b["type"] == "heading", F.length(b["text"]) - F.length(bare(b))).alias("level"),
        F.when(b["type"] == "heading", T.strip(bare(b))).alias("heading"),
    )
    return docs.withColumn("_blocks", F.transform("_typed", full)).drop("_lines", "_kinds", "_spans", "_texts", "_bare", "_typed")


def _sectioned(docs: DataFrame) -> DataFrame:
    """Adds _sections: array of (a, z: first block and the one past the last, refers, head): one for each heading, and what stands before the first."""
    n = F.size("_blocks")
    heads = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (i == 0) | (F.get(F.col("_blocks"), i)["type"] == "heading"))
    docs = docs.withColumn("_heads", heads)
    spans = F.transform(F.sequence(F.lit(0), F.size("_heads") - 2), lambda k: F.struct(F.get(F.col("_heads"), k).alias("a"), F.get(F.col("_heads"), k + 1).alias("z")))
    docs = docs.withColumn("_sections", F.when(n > 0, spans).otherwise(F.array().cast("array<struct<a:int,z:int>>")))
    return docs.withColumn("_sections", F.transform("_sections", lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), (F.get(F.col("_blocks"), s["a"])["refers"] & (F.get(F.col("_blocks"), s["a"])["type"] == "heading")).alias("refers"), F.get(F.col("_blocks"), s["a"]).alias("head"))))


def _stacks(docs: DataFrame) -> DataFrame:
    """Adds _places: array of (section_id, section_path), one for each section."""
    step = f"""
(s, x) -> named_struct(
  'stack', cast(if(x.head.type = 'heading' and not x.refers,
     if(x.head.heading <> '' and x.head.level > 1,
        concat(filter(s.stack, e -> e.level < x.head.level), array(named_struct('level', x.head.level, 'id', format_string('sec_%04d', s.n + 1), 'heading', x.head.heading))),
        filter(s.stack, e -> e.level < x.head.level)),
     s.stack) as {_STACK}),
  'n', s.n + if(x.head.type = 'heading' and not x.refers and x.head.heading <> '' and x.head.level > 1, 1, 0),
  'trail', concat(s.trail, array(cast(if(x.head.type = 'heading' and not x.refers,
     if(x.head.heading <> '' and x.head.level > 1,
        concat(filter(s.stack, e -> e.level < x.head.level), array(named_struct('level', x.head.level, 'id', format_string('sec_%04d', s.n + 1), 'heading', x.head.heading))),
        filter(s.stack, e -> e.level < x.head.level)),
     s.stack) as {_STACK}))))"""
    start = f"named_struct('stack', cast(array() as {_STACK}), 'n', 0, 'trail', cast(array() as array<{_STACK}>))"
    docs = docs.withColumn("_trail", F.expr(f"aggregate(_sections, {start}, {step}, s -> s.trail)"))
    return docs.withColumn("_places", F.expr(f"cast(transform(_trail, s -> named_struct('section_id', get(s, size(s) - 1).id, 'section_path', transform(s, e -> e.heading))) as {_PLACES})"))


def is_non_main(path: Column) -> Column:
    """Whether any heading of a section path begins like one of the sections that are not main text."""
    pattern = r"(?s)\A(" + "|".join(NON_MAIN_SECTIONS) + ").*"
    return F.exists(path, lambda h: F.lower(T.strip(h)).rlike(pattern))


def is_noise(t: Column) -> Column:
    s = T.strip(t)
    low = F.lower(s)
    starts = low.startswith("page ") | low.startswith("copyright") | low.startswith("open access")
    return (s == "") | s.rlike(r"\A[\p{Nd}\p{No}]+\z") | starts | ((F.length(s) < 8) & s.rlike(r"\p{L}"))


def with_policy(blocks: DataFrame) -> DataFrame:
    """Adds summary_policy and skip_reason to rows of (type, text, section_path)."""
    away = is_non_main(F.col("section_path"))
    reason = (
        F.when(F.col("type") == "reference", "reference_section")
        .when(away, "non_main_section")
        .when(F.col("type") == "heading", "heading")
        .when(F.col("type").isin("formula", "table", "image"), F.col("type"))
        .when(is_noise(F.col("text")), "noise")
    )
    policy = F.when(F.col("skip_reason").isNull(), "summarize").when(F.col("skip_reason").isin("formula", "table", "image"), "context_only").otherwise("skip")
    return blocks.withColumn("skip_reason", reason).withColumn("summary_policy", policy)


def split_blocks(docs: DataFrame, key: str = "paper_id", markdown: str = "markdown") -> DataFrame:
    """key, order, block_id, type, start_line, end_line, text of every block of every document."""
    docs = _sectioned(_segmented(docs.select(key, markdown), markdown))
    typed = F.flatten(F.transform("_sections", lambda s: F.transform(F.slice("_blocks", s["a"] + 1, s["z"] - s["a"]), lambda b: F.struct(b["start_line"].alias("start_line"), b["end_line"].alias("end_line"), b["text"].alias("text"), F.when(s["refers"], "reference").otherwise(b["type"]).alias("type")))))
    rows = docs.select(key, F.posexplode(typed).alias("order", "b"))
    return rows.select(key, "order", F.format_string("b%05d", "order").alias("block_id"), "b.type", "b.start_line", "b.end_line", "b.text")


def source_map(docs: DataFrame, key: str = "paper_id", markdown: str = "markdown") -> DataFrame:
    """The blocks with section, policy and hashes."""
    docs = docs.select(key, markdown, T.sha256(F.col(markdown)).alias("markdown_hash"))
    docs = _stacks(_sectioned(_segmented(docs, markdown)))
    placed = F.flatten(
        F.transform(
            F.arrays_zip("_sections", "_places"),
            lambda x: F.transform(
                F.slice("_blocks", x["_sections"]["a"] + 1, x["_sections"]["z"] - x["_sections"]["a"]),
                lambda b: F.struct(b["start_line"].alias("start_line"), b["end_line"].alias("end_line"), b["text"].alias("text"), F.when(x["_sections"]["refers"], "reference").otherwise(b["type"]).alias("type"), x["_places"]["section_id"].alias("section_id"), x["_places"]["section_path"].alias("section_path")),
            ),
        )
    )
    rows = docs.select(key, "markdown_hash", F.posexplode(placed).alias("order", "b")).select(key, "markdown_hash", "order", F.format_string("blk_%06d", "order").alias("block_id"), "b.*")
    return with_policy(rows).withColumn("text_hash", T.sha256(F.col("text")))


def headings_brief(blocks: DataFrame, key: str = "paper_id", most: int = 30) -> DataFrame:
    """The first headings of each document, in order."""
    heads = blocks.where("type = 'heading'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order", T.strip(F.ltrim("text", F.lit("#"))).alias("h")))).alias("hs"))
    return heads.select(key, F.slice(F.transform("hs", lambda x: x["h"]), 1, most).alias("headings"))


def markdown_head(blocks: DataFrame, key: str = "paper_id", most_chars: int = 8000, most_blocks: int = 40) -> DataFrame:
    """The first blocks of each document as text, cut at a number of characters."""
    first = blocks.where(F.col("order") < most_blocks).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("bs"))
    return first.select(key, F.substring(F.array_join(F.transform("bs", lambda x: x["text"]), "\n\n"), 1, most_chars).alias("head"))


def render(blocks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Blocks back to one text per document: those that are not blank, an empty line between."""
    solid = blocks.where(F.col("text").rlike(r"(?U)\S")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("bs"))
    return solid.select(key, F.concat(F.array_join(F.transform("bs", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))


def packed(blocks: DataFrame, key: str = "paper_id", most_chars: int = 7000, most_blocks: int = 8) -> DataFrame:
    """key, batch, block_id: blocks to summarise, packed greedily into requests in order.

    A batch is closed before a block that would be one too many or one too long, so
    a block of more than ``most_chars`` stands alone.  The fold carries the running
    batch only; batch numbers are the running sum of what it marks as first.
    """
    own = blocks.where("summary_policy = 'summarize'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order", "block_id", F.length("text").alias("size")))).alias("bs"))
    fold = f"""aggregate(bs, named_struct('n', 0, 'chars', 0, 'batch', 0, 'out', cast(array() as array<int>)),
      (s, b) -> if(s.n > 0 and (s.n >= {most_blocks} or s.chars + b.size > {most_chars}),
        named_struct('n', 1, 'chars', b.size, 'batch', s.batch + 1, 'out', array_append(s.out, s.batch + 1)),
        named_struct('n', s.n + 1, 'chars', s.chars + b.size, 'batch', s.batch, 'out', array_append(s.out, s.batch))),
      s -> s.out)"""
    return own.select(key, F.explode(F.arrays_zip(F.col("bs").alias("b"), F.expr(fold).alias("batch"))).alias("x")).select(key, F.col("x.batch").alias("batch"), F.col("x.b.block_id").alias("block_id"))
