"""Session factory with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, partitions and checkpoint folder come from its own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """A table that is computed once, as what makes it costs much or may differ when run again.

    It is checkpointed where there is a folder for that, which all executors share; only on a local
    master without one it is cached instead.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return df.persist()
