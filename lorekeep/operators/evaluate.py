"""Evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.prefix import block_prefix_sum


def retrieval_report(hits: DataFrame, by: list[str]) -> DataFrame:
    """``hits``: query, the ``by`` columns, rank and relevant. Queries, recall at the list's depth and mean reciprocal rank."""
    q = hits.groupBy(*by, "query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return q.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("first").isNull(), 0.0).otherwise(1.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def nearest_rank(df: DataFrame, by: list[str], value: str, key: str, percents: list[int], block: Column) -> DataFrame:
    """(by, percent, value): the value at index round(p / 100 * (n - 1)) of the sorted group, without gathering it."""
    d = df.filter(F.col(value).isNotNull())
    pos = block_prefix_sum(d.select(*by, value, key), by, block, [F.col(value), F.col(key)], F.lit(1), "pos")
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    want = n.select(*by, F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"), "n")
    want = want.select(*by, "percent", F.round(F.col("percent") / 100.0 * (F.col("n") - 1)).cast("long").alias("pos"))
    return pos.join(want, [*by, "pos"]).select(*by, "percent", value)


def stratified(df: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """A sample of ``size`` rows: quotas by largest remainder (ties to the larger stratum, then by name), rows by key."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    rows = n.collect()  # one row a stratum, a category column
    total = sum(r["n"] for r in rows)
    want = {r[stratum]: size * r["n"] // max(total, 1) for r in rows}
    left = min(size, total) - sum(want.values())
    for r in sorted(rows, key=lambda r: (-(size * r["n"] % max(total, 1)), -r["n"], str(r[stratum]))):
        if left > 0 and want[r[stratum]] < r["n"]:
            want[r[stratum]], left = want[r[stratum]] + 1, left - 1
    parts = None
    for name, k in want.items():
        p = df.filter(F.col(stratum).eqNullSafe(F.lit(name))).orderBy(key).limit(k)  # a top-k each, no shuffle of the table
        parts = p if parts is None else parts.unionByName(p)
    return df.limit(0) if parts is None else parts


def failure_class(correct: Column, evidence: Column, n_facts: Column, n_obs: Column, category: Column) -> Column:
    """Why an answer failed; null if it did not."""
    return (
        F.when(correct, F.lit(None).cast("string"))
        .when(~evidence & (n_facts == 0) & (n_obs == 0), "retrieval_miss")
        .when((category == "temporal") & evidence, "wrong_temporal_version")
        .when((category == "multi_hop") & evidence & ((n_facts < 2) | (n_obs < 2)), "incomplete_chain")
        .when(n_facts == 0, "fact_extraction")
        .when(n_obs == 0, "context_packing")
        .otherwise("answer_synthesis")
    )


def stale_served(gold_rank: Column, anti_rank: Column, gold_said: Column, anti_said: Column) -> Column:
    """Whether a stale answer came out: by rank if hits hold it, else by what was answered. Null ranks are misses."""
    return (
        F.when(anti_rank.isNotNull() & gold_rank.isNull(), True)
        .when(anti_rank.isNotNull(), anti_rank < gold_rank)
        .otherwise(anti_said & ~gold_said)
    )
