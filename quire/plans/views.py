"""A document library out of the test tables, so that every operator has real rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What stands before line i of document d in its Markdown, by (d + i) modulo 14.
PREFIXES = (
    "## Method\n\n", "### Setup\n\n", "## Funding sources\n\n", "$$\nE = mc^2\n$$\n\n", "![](images/missing.png)\n\n", "Te detector efciency is diferent. ", "P a g e 1 2\n\n", "| a | b |\n| 1 | 2 |\n\n",
    "## References\n\n", "page 3\n\n", "", "#### Results\n\n", "see doi 10.1234/abc.5, arXiv: 2101.12345v2 and $x_1 y z w$ ", "we show that the we show that the ",
)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, markdown: every document as structured text."""
    n = len(PREFIXES)
    choices = F.array(*map(F.lit, PREFIXES))
    line = lambda x, i: F.concat(F.get(choices, ((F.col("doc_id") + i) % n).cast("int")), x)
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("# Document "), F.col("doc_id"), F.lit("\n\n"), body).alias("markdown"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    m = F.col("doc_id") % 7
    conversion = F.when(m == 0, "failed").when(m == 1, "pending").when(m == 2, F.lit(None)).otherwise("done")
    return docs.select(
        "doc_id",
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("id"),
        F.concat(F.lit("Paper "), F.translate("text", "\n", " ")).alias("name"),
        F.when(F.col("doc_id") % 5 == 4, F.lit(None)).otherwise(F.col("source")).alias("collection"),
        F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("inbox/p"), F.col("doc_id"))).otherwise(F.concat(F.lit("collections/"), F.col("source"), F.lit("/p"), F.col("doc_id"))).alias("bundle_path"),
        F.col("text").alias("title"),
        conversion.alias("conversion"),
        F.when(F.col("quality") == 1, "complete").when(F.col("quality") == 0, "partial").alias("metadata_status"),
        (F.col("doc_id") % 5).cast("int").alias("n_previous_names"),
        (F.col("doc_id") % 11 != 0).alias("has_markdown"),
        (F.col("doc_id") % 13 != 0).alias("has_pdf"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "conversion-started").when(F.col("event_type").isin("purchase", "error"), "conversion-finished").otherwise("other")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", kind.alias("event"), F.when(F.col("user_id") % 17 != 0, F.concat(F.lit("paper-"), F.col("user_id"))).alias("paper_id"), F.when(k % 5 != 4, k % 4).alias("attempt"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("ok")
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("collections/c"), o % 20, F.lit("/o"), o).alias("bundle_path"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"),
        F.when(o % 3 == 0, "batch-api").otherwise("local").alias("converter"),
        F.when(o % 4 != 0, F.concat(F.lit("batch-"), o % 9)).alias("batch_id"),
        F.when(o % 5 != 0, F.concat(F.lit("data-"), o)).alias("data_id"),
        F.when(o % 23 == 0, "not a time").when(o % 29 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("submitted_at"),
        F.floor(F.col("o_totalprice") % 7).cast("int").alias("attempt"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of split conversions; (paper, part) is made unique."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("quantity"))
    return rows.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("part"), (F.col("flag") != "R").alias("ok"), F.when(F.col("flag") == "R", F.concat(F.lit("failed part "), F.col("l_linenumber"))).alias("error"), F.concat(F.lit("text ![](images/a.png) of "), F.col("quantity").cast("int")).alias("markdown"))


def summary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block summaries as a provider would give them, from the lines of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h = F.col("paper_id") * 7 + F.col("pos")
    at = lambda r, n: F.when(r < 0, r + n + 1).otherwise(r).cast("int")  # noqa: E731  # places below 1 count from the end in the SQL
    pick = lambda values, x: F.get(F.array(*map(F.lit, values)), at(x % len(values), len(values)))
    return docs.select(
        "paper_id",
        F.col("pos").alias("order"),
        F.format_string("blk_%06d", "pos").alias("block_id"),
        F.format_string("sec_%04d", F.floor(F.col("pos") / 3).cast("int")).alias("section_id"),
        F.col("line").alias("summary_text"),
        pick(("background", "method", "result", "limitation", "other"), h).alias("role"),
        pick(("high", "medium", "low", "other"), F.expr("(paper_id * 7 + pos) div 2")).alias("importance"),
        F.split("line", " ").alias("concepts"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    kinds = ("concept", "method", "dataset_or_sample", "instrument", "measurement", "result", "limitation", "claim", "theory")
    ids = F.transform(F.sequence(F.lit(0), (p % 3).cast("int")), lambda i: F.concat(F.lit("b"), p % 40 + i))
    return table(spark, sf_dir, "part").select((p % 200).alias("paper_id"), p.alias("pos"), F.when(p % 31 != 0, F.concat(F.lit("n"), p)).alias("id"), F.get(F.array(*map(F.lit, kinds)), (p % 9).cast("int")).alias("type"), F.col("p_name").alias("label"), F.when(p % 10 != 0, ids).alias("source_block_ids"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("uses", "measures", "produces", "supports", "compares_with", "limits", "depends_on", "explains", "cites")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 200).alias("paper_id"), F.concat(F.lit("n"), F.col("l_partkey")).alias("source"), F.concat(F.lit("n"), F.col("l_partkey") % 200 + 200 * (F.col("l_suppkey") % 10)).alias("target"), F.get(F.array(*map(F.lit, kinds)), (k % 9).cast("int")).alias("type"), F.array(F.concat(F.lit("b"), k % 45)).alias("source_block_ids")
    )


def known_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, block_id: 40 blocks of each of 200 papers."""
    return spark.range(200).select(F.col("id").alias("paper_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("paper_id", F.concat(F.lit("b"), F.col("k")).alias("block_id"))
