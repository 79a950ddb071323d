"""Ranked lists fused and rescored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(lanes: DataFrame, k: int = 60, by: tuple[str, ...] = ("query",), item: str = "id") -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold an item; ties by first appearance, scanning list after list.

    ``lanes`` has the ``by`` columns, lane (a number), item and rank (from 1). Adds
    score, rank of the result and the rank in each lane as a map.
    """
    g = lanes.groupBy(*by, item).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("lane", "rank")).alias("seen"), F.count(F.lit(1)).alias("lanes"),
    )
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "seen.lane", "seen.rank", item)
    return g.withColumn("rank", F.row_number().over(w).cast("long")).select(*by, item, "score", "lanes", "rank")


def score_map(lexical: DataFrame, dense: DataFrame, boosts: DataFrame) -> DataFrame:
    """(query, id, lexical, dense, boost): lanes joined, a lane that lacks an id gives 0.

    Dense distances become 1 - min-max over the query's list, 1 for a single hit or
    if all are equal; boosts are kept within 0..1.
    """
    w = Window.partitionBy("query")
    lo, hi = F.min("distance").over(w), F.max("distance").over(w)
    d = dense.select("query", "id", F.when(hi > lo, 1 - (F.col("distance") - lo) / (hi - lo)).otherwise(1.0).alias("dense"))
    b = boosts.select("query", "id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "boost")).alias("boost"))
    out = lexical.select("query", "id", "lexical").join(d, ["query", "id"], "full").join(b, ["query", "id"], "full")
    return out.na.fill(0.0, ["lexical", "dense", "boost"])


def contradictions(rows: DataFrame, by: list[str], subject: str, predicate: str, value: str, weight: str, key: str) -> DataFrame:
    """Adds factor (0.5 where a subject and predicate has several values, else 1) and bonus (0.25 for the member of most weight there)."""
    w = Window.partitionBy(*by, F.lower(F.trim(F.col(subject))), F.lower(F.trim(F.col(predicate))))
    val = F.lower(F.trim(F.col(value)))
    clash = F.min(val).over(w) != F.max(val).over(w)
    first = F.row_number().over(w.orderBy(F.desc(weight), key)) == 1
    rows = rows.withColumn("factor", F.when(clash, 0.5).otherwise(1.0))
    return rows.withColumn("bonus", F.when(clash & first, 0.25).otherwise(0.0))
