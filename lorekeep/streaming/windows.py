"""Streams: event-time windows, sessions, and changes applied to a bucketed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.cdc import BucketTable
from lorekeep.scratch import Scratch


def table_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 50) -> DataFrame:
    """A table's Parquet files as a stream; the schema is the table's own."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def windowed(events: DataFrame, at: str, by: list[str], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(by, window_start, n) counts of tumbling or sliding windows behind a watermark."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, n): events closer than ``gap`` form a session."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n"))
    return g.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def once_each(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def apply_stream(stream: DataFrame, target: BucketTable, checkpoint: str):
    """Apply a stream of changes to a bucketed table, one commit a micro-batch; replays change nothing, as merging is idempotent."""
    return stream.writeStream.foreachBatch(lambda df, _: target.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, mode: str = "complete", keep_all: bool = False) -> DataFrame:
    """Run a stream over all that is there and return the last result as a table, or with ``keep_all`` the results of all batches."""
    spark = df.sparkSession
    s = Scratch(spark, "stream")
    kept: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        table = s.save(batch)
        if not keep_all:
            s.drop(*kept)
            kept.clear()
        kept.append(table)

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{s.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], df.schema)


def hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts per event type, as a stream."""
    e = table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(windowed(e, "ts", ["event_type"]))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
