"""Streams: index maintenance by checkpoints, query sessions, event counts (IDX1-IDX6, LOG7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import upsert
from ..sources.sinks import drop_old_versions, latest_version, write_version

INTERVAL = "300 seconds"


def read_feed(spark: SparkSession, path: str, schema: object, files: int = 100) -> DataFrame:
    """The feed folder as a stream; ``files`` a trigger bounds what is taken at once (IDX1)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def maintain(feed: DataFrame, root: str, checkpoint: str, modules: list[Callable[[DataFrame], DataFrame]] = (), once: bool = False, keep: int = 10) -> StreamingQuery:
    """Fold each micro-batch into the latest version under ``root`` and publish the next (IDX3, IDX4).

    A version is named by its batch; a batch that runs again after a failure finds its version and does nothing, so
    every operation counts once.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = latest_version(spark, root)
        if now is not None and int(now.rsplit("/", 1)[1]) >= epoch + 1:
            return
        for m in modules:
            batch = m(batch)
        base = spark.read.parquet(now) if now else spark.createDataFrame([], batch.drop("op", "seq").schema)
        write_version(upsert(base, batch), root, epoch + 1, may_be_empty=True)
        drop_old_versions(spark, root, keep)

    w = feed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=INTERVAL)).start()


def session_counts(queries: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Queries a visitor's session, as sessions close (LOG7 as a stream): ip, start, end, n."""
    s = queries.withWatermark("time", late).groupBy(F.session_window("time", gap), "ip").agg(F.count("*").alias("n"))
    return s.select("ip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def event_counts(events: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window (MET1 as a stream)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def query_log_stream(searches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append queries that found something to the log (SNK7)."""
    return searches.where("total_results > 0").select("query").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
