"""Reading the corpus tables, shared storage, and bounded samples of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only on a local master, where that setting may be missing, a folder in the
    warehouse takes its place; elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and returns the reread table: lineage ends there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, held_out: tuple[int, int] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(turn, text, label) of at most ``max_rows`` labelled keys, the same on each run.

    Keys are taken in the order of a hash.  The chosen labels are at most ``max_rows``
    rows of two numbers, so they are broadcast.  ``held_out`` (modulus, remainder)
    names the rows of which labels are not learned.  A key with several labels has
    their mean, one with several texts the one of the least hash: a row for each key.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("label")).where("label is not null and _id is not null")
    if held_out:
        chosen = chosen.where(remainder(F.col("_id"), held_out[0]) != held_out[1])
    chosen = chosen.groupBy("_id").agg(F.round(F.avg("label")).alias("label")).orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_id", "text", "label")
    return rows.groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(F.xxhash64("_id", F.lit(7)).alias("turn"), "text", "label")


def in_one_task(sample: DataFrame) -> DataFrame:
    """A bounded sample in the order of its turns, in one partition; sorting there spills rather than fails."""
    return sample.select("turn", "text", "label").repartition(1).sortWithinPartitions("turn", "label", F.xxhash64("text"))


def until(batches: Iterator, most_bytes: int) -> Iterator:
    """Slices of (turn, text, label) batches until ``most_bytes`` of text have come."""
    left = most_bytes
    for batch in batches:
        for part in tokens.slices(batch, 1):
            if left > 0:
                left -= part.column(1).nbytes
                yield part
