"""Structured Streaming over the append-only event logs.

The same operators as in batch, on streams: pairing of started and finished
conversions with a watermark, stale timers, pending-only increments, and upserts of
memory state per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources.sinks import latest, write_version

JOBS = "event STRING, paper_id STRING, attempt INT, at TIMESTAMP, state STRING, ok BOOLEAN, error STRING, bundle_path STRING, converter STRING"
RUNS = "event STRING, at TIMESTAMP, run_id STRING, command STRING, elapsed_seconds DOUBLE, path STRING, stage STRING, count INT"


def job_log(spark: SparkSession, folder: str, schema: str = JOBS) -> DataFrame:
    """A folder of JSON lines as a stream; lines that don't parse give nulls."""
    return spark.readStream.schema(schema).json(folder)


def pairs(jobs: DataFrame, delay: str = "1 hour", horizon: str = "30 days") -> DataFrame:
    """Each start with its finish, however long after it within ``horizon``.

    A start without one comes out with finished_at null once the watermark, ``delay`` behind
    the latest event, is past its horizon; what finishes later than that, or before its
    start, is not paired.  State is bounded by the starts and finishes of one horizon.
    """
    key = lambda name: F.coalesce("paper_id", F.lit("")).alias(f"{name}_paper")
    number = lambda name: F.coalesce("attempt", F.lit(0)).alias(f"{name}_attempt")
    started = jobs.where("event = 'conversion-started'").select(key("s"), number("s"), F.col("at").alias("started_at")).withWatermark("started_at", delay)
    finished = jobs.where("event = 'conversion-finished'").select(key("f"), number("f"), F.col("at").alias("finished_at"), "ok").withWatermark("finished_at", delay)
    same = (F.col("s_paper") == F.col("f_paper")) & (F.col("s_attempt") == F.col("f_attempt"))
    near = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {horizon}"))
    return started.join(finished, same & near, "leftOuter").select(F.col("s_paper").alias("paper_id"), F.col("s_attempt").alias("attempt"), "started_at", "finished_at", "ok")


def stale(jobs: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """A row for each conversion that has not finished so long after its start, by event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame({"paper_id": [key[0]], "attempt": [key[1]], "since_ms": [since]})
            return
        begun = state.get[0] if state.exists else None
        for pdf in batches:
            for row in pdf.sort_values("at").itertuples(index=False):
                begun = int(row.at.timestamp() * 1000) if row.event == "conversion-started" else None
        if begun is None:
            if state.exists:
                state.remove()
        else:
            state.update((begun,))
            state.setTimeoutTimestamp(max(begun + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = jobs.where("event in ('conversion-started', 'conversion-finished')").select(F.coalesce("paper_id", F.lit("")).alias("paper_id"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "event", "at").withWatermark("at", delay)
    return rows.groupBy("paper_id", "attempt").applyInPandasWithState(step, "paper_id string, attempt int, since_ms long", "since_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(runs: DataFrame, width: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by window and kind, late ones within the watermark."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    rows = runs.withWatermark("at", delay).groupBy(w.alias("w"), "event").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "event", "n")


def sessions(runs: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of events of one run id without a longer gap."""
    rows = runs.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "run_id").agg(F.count("*").alias("n"))
    return rows.select("run_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def each_new(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` once over what is new since the last run, and stops."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_upsert(spark: SparkSession, folder: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps a table as versions, one a micro-batch: the next is merged from the last and the batch.

    A batch that is run again after a failure writes the same version again.
    """

    def work(batch: DataFrame, number: int) -> None:
        write_version(merge(latest(spark, folder, number), batch), folder, number)

    return work


class Progress(StreamingQueryListener):
    """Hands what queries report of themselves to a sink: (event, details) at their start, at each step, and at their end."""

    def __init__(self, sink: Callable[[str, dict], None]):
        self.sink = sink

    def onQueryStarted(self, event) -> None:
        self.sink("run-started", {"run_id": str(event.runId), "stage": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.sink("stage-progress", {"run_id": str(p.runId), "stage": p.name, "count": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.sink("run-finished", {"run_id": str(event.runId), "ok": event.exception is None, "error": event.exception})
