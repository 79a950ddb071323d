"""The memory model's frames over the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.relational import live
from lorekeep.plans.registry import table
from lorekeep.scratch import Scratch


#: Up to so many keys that occur again are broadcast.
FEW = 200_000


def observations(spark: SparkSession, folder: str, live_only: bool = False, wide: bool = False) -> DataFrame:
    """Observations, repeated rows once; with ``live_only`` those that are not soft-deleted.

    A repeated row repeats all of it, so any row of an id will do: only the columns
    that a query uses are read and shuffled, and the filter reaches the scan. With
    ``wide`` (for queries that use texts) nothing but ids is shuffled.
    """
    o = table(spark, folder, "observations")
    o = live(o) if live_only else o
    return once(o, "id") if wide else o.dropDuplicates(["id"])


def once(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key of a scanned table, where repeated rows share a key; rows stay where they are read.

    Keys that occur again are few: they are found on the key column alone, with the
    place of their first row, and the others of their rows are filtered out.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    again = df.select(key, place.alias("at")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("__first")).filter("n > 1").select(key, "__first")
    again = Scratch(df.sparkSession, "once").save(again)
    if again.count() > FEW:
        return df.dropDuplicates([key])
    rows = df.withColumn("__at", place).join(F.broadcast(again), key, "left")
    return rows.filter("__first IS NULL OR __first = __at").select(*df.columns)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").dropDuplicates(["fact_id"])


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, fact_id) once each."""
    return table(spark, folder, "entity_links").select("entity_id", "fact_id").distinct()


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, observation_id): entities of the facts that an observation gives evidence for."""
    f = facts(spark, folder).filter(F.col("evidence_obs_id").isNotNull()).select("fact_id", F.col("evidence_obs_id").alias("observation_id"))
    return links(spark, folder).join(f, "fact_id").select("entity_id", "observation_id").distinct()


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text): the names of the entities, a fixed table."""
    return table(spark, folder, "entities").select(F.col("entity_id").alias("query_id"), F.col("name").alias("text"))
