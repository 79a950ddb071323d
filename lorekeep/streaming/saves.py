"""Saves and embeddings as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.scratch import Scratch

OUTCOMES = "id long, first_id long, revision long, outcome string"


def topic_outcomes(stream: DataFrame) -> DataFrame:
    """(id, first_id, revision, outcome) of rows (id, topic_key, scope, at): the first row of a topic and scope is inserted, later ones update it.

    The state of a topic is its row's id, its number of saves and the largest time and
    id that it has seen, so memory does not grow with saves. Rows of a batch are taken
    in order of time; a row that was delivered again in the same batch counts once.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).drop_duplicates("id").sort_values(["at", "id"])
        first, n = state.get if state.exists else (int(rows["id"].iloc[0]), 0)
        ids = rows["id"].to_numpy()
        revision = n + 1 + pd.RangeIndex(len(ids)).to_numpy()
        state.update((first, n + len(ids)))
        yield pd.DataFrame({"id": ids, "first_id": first, "revision": revision, "outcome": ["inserted" if r == 1 else "topic_update" for r in revision]})

    return stream.groupBy("scope", "topic_key").applyInPandasWithState(step, OUTCOMES, "first long, n long", "append", GroupStateTimeout.NoTimeout)


def cached_first(stream: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, cache_key, from_cache) of all rows that a stream (id, cache_key) has now, batch by batch through ``foreachBatch``."""
    from functools import reduce

    from pyspark.sql import functions as F

    spark = stream.sparkSession
    s = Scratch(spark, "embeddings")
    done: list[DataFrame] = []
    known = s.save(cache.select("cache_key", F.lit(True).alias("known")))

    def batch(df: DataFrame, _: int) -> None:
        done.append(s.save(df.join(known, "cache_key", "left").select("id", "cache_key", F.col("known").isNotNull().alias("from_cache"))))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{s.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "id long, cache_key string, from_cache boolean")
