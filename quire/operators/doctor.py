"""Audit rules: each gives rows of (code, path, message); an audit is their union."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.sources.config import CONFIG_FILE, local_converter, wants_local_check


def issue(code: str, path: Column, message: Column) -> list[Column]:
    return [F.lit(code).alias("code"), path.alias("path"), message.alias("message")]


def duplicate_ids(papers: DataFrame) -> DataFrame:
    """Every bundle but the first of its id, in path order."""
    w = Window.partitionBy("id").orderBy(F.split("bundle_path", "/"))
    ranked = papers.select("bundle_path", F.row_number().over(w).alias("n"), F.first("bundle_path").over(w).alias("first"))
    return ranked.where("n > 1").select(*issue("duplicate-id", F.col("bundle_path"), F.concat(F.lit("id is also that of "), "first")))


def unfinished(papers: DataFrame) -> DataFrame:
    failed = F.col("conversion").eqNullSafe("failed")
    rows = papers.where(~F.col("conversion").eqNullSafe("done"))
    return rows.select(F.when(failed, "failed-conversion").otherwise("pending-conversion").alias("code"), F.col("bundle_path").alias("path"), F.when(failed, "conversion failed").otherwise("conversion is not done").alias("message"))


def missing_files(papers: DataFrame) -> DataFrame:
    pdf = papers.where("not has_pdf").select(*issue("missing-original-pdf", F.col("bundle_path"), F.lit("no original.pdf")))
    md = papers.where("conversion = 'done' and not has_markdown").select(*issue("missing-paper-md", F.col("bundle_path"), F.lit("converted, but no paper.md")))
    return pdf.unionByName(md)


def invalid_creators(papers: DataFrame) -> DataFrame:
    return papers.where(~M.valid_creators(F.col("creators"))).select(*issue("invalid-creators", F.col("bundle_path"), F.lit("creators must all have names")))


def stale_index(index: DataFrame, papers: DataFrame, path: str) -> DataFrame:
    """One row if index and library have different numbers of rows."""
    sizes = index.agg(F.count("*").alias("n")).select(F.lit("index").alias("side"), "n").unionByName(papers.agg(F.count("*").alias("n")).select(F.lit("actual").alias("side"), "n"))
    both = sizes.agg(F.max(F.when(F.col("side") == "index", F.col("n"))).alias("indexed"), F.max(F.when(F.col("side") == "actual", F.col("n"))).alias("actual"))
    return both.where("indexed <> actual").select(*issue("stale-index", F.lit(path), F.concat(F.lit("index has "), "indexed", F.lit(", library has "), "actual")))


def dangling_jobs(jobs: DataFrame) -> DataFrame:
    """Started conversions without a finish of the same paper and attempt; nulls count as '' and 0.

    Repeats stay.  The anti-join is on the two keys, so each side is dealt out by them once.
    """
    paper, attempt = F.coalesce("paper_id", F.lit("")), F.coalesce("attempt", F.lit(0))
    started = jobs.where("event = 'conversion-started'").withColumns({"_p": paper, "_a": attempt})
    finished = jobs.where("event = 'conversion-finished'").select(paper.alias("_p"), attempt.alias("_a")).distinct()
    return started.join(finished, ["_p", "_a"], "left_anti").drop("_p", "_a")


def dangling_issues(jobs: DataFrame, path: str) -> DataFrame:
    return dangling_jobs(jobs).select(*issue("dangling-conversion-job", F.lit(path), F.concat(F.lit("no finish of "), F.coalesce("paper_id", F.lit("None")), F.lit(" attempt "), F.coalesce(F.col("attempt").cast("string"), F.lit("None")))))


def running_issues(conversions: DataFrame, now: Column, most_seconds: float = 1800, batch_converter: str = "batch-api") -> DataFrame:
    """Running conversions that lack their batch mapping, are too old, or have no valid time.  One pass, one row a finding."""
    running = conversions.where("state = 'running'").withColumn("_at", F.try_to_timestamp("submitted_at"))
    lost = (F.col("converter") == batch_converter) & (F.coalesce("batch_id", F.lit("")).eqNullSafe("") | F.coalesce("data_id", F.lit("")).eqNullSafe(""))
    stated = F.coalesce("submitted_at", F.lit("")) != ""
    age = now.cast("double") - F.col("_at").cast("double")
    codes = F.array(
        F.when(lost, "missing-batch-conversion-mapping"),
        F.when(stated & F.col("_at").isNull(), "invalid-conversion-timestamp"),
        F.when(stated & (age > most_seconds), "stale-running-conversion"),
    )
    rows = running.select("bundle_path", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))
    return rows.select("code", F.concat("bundle_path", F.lit("/conversion.json")).alias("path"), F.lit("running conversion").alias("message"))


def corrupt_lines(lines: DataFrame, path: str, code: str = "invalid-job-json") -> DataFrame:
    """Lines (number, line) that are no JSON; blank lines don't count."""
    bad = lines.where(F.col("line").rlike(r"\S") & F.try_parse_json("line").isNull())
    return bad.select(*issue(code, F.concat(F.lit(f"{path}:"), "number"), F.lit("not valid JSON")))


def missing_config(spark: SparkSession, library: str, there: bool) -> DataFrame:
    """One row if a library has no settings file."""
    rows = spark.range(0 if there else 1)
    return rows.select(*issue("missing-library-config", F.lit(f"{library}/{CONFIG_FILE}"), F.lit("no settings of the library")))


def invalid_records(records: DataFrame) -> DataFrame:
    """Records that can't be read; the other rules don't see them."""
    return records.where("_corrupt").select(*issue("invalid-paper-yaml", F.col("bundle_path"), F.lit("the record can't be read")))


def invalid_conversions(files: DataFrame) -> DataFrame:
    """Conversion files (path, text) that are no JSON."""
    bad = files.where(F.col("text").isNull() | F.try_parse_json("text").isNull())
    return bad.select(*issue("invalid-conversion-json", F.col("path"), F.lit("not valid JSON")))


def local_converter_issues(facts: DataFrame) -> DataFrame:
    """Findings on local converters (executable, wanted, exists, error) whose settings want them checked."""
    code = F.when(~F.col("exists"), "missing-local-executable").when(F.col("error").isNotNull(), "invalid-local-executable")
    return facts.where("wanted").withColumn("code", code).where("code is not null").select("code", F.col("executable").alias("path"), F.coalesce("error", F.lit("no such program")).alias("message"))


def converter_facts(spark: SparkSession, config: Mapping) -> DataFrame:
    """One row of what the settings and the machine say of the local converter."""
    wanted = wants_local_check(config)
    found = local_converter(config, probe=wanted)
    return spark.createDataFrame([(found.executable, wanted, found.exists, found.error)], "executable string, wanted boolean, exists boolean, error string")


def audit(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
