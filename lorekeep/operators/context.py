"""Context assembly: quotas, token budgets, evidence windows, slots, chunks of turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.prefix import block_prefix_sum


def token_pack(df: DataFrame, by: list[str], block: Column, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes sum to at most ``budget`` (0: no limit), by a distributed prefix sum."""
    out = block_prefix_sum(df.withColumn("__size", size), by, block, order, F.col("__size"), "tokens_before")
    out = out.withColumn("tokens_after", F.col("tokens_before") + F.col("__size")).drop("__size")
    return out.filter(F.col("tokens_after") <= budget) if budget else out


def newest_ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank (from 1), newest first, by distributed counts."""
    day = -F.datediff(F.col("created_at"), F.lit("1970-01-01").cast("date"))
    return block_prefix_sum(df, by, day, [F.desc("created_at"), F.desc("id")], F.lit(1), "rank").withColumn("rank", (F.col("rank") + 1).cast("long"))


def type_round_robin(df: DataFrame, by: list[str], kind: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of a kind, taken in turns: adds turn (from 1)."""
    w = Window.partitionBy(*by, kind).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w).cast("long")).filter(F.col("turn") <= cap)


def evidence_window(seeds: DataFrame, rows: DataFrame, key: str, group: str, width: int) -> DataFrame:
    """(query, key, seed_rank, is_seed): seeds and their neighbours in the group, each once, first by seed rank."""
    want = seeds.select("query", F.col("rank").alias("seed_rank"), F.col(key).alias("seed"), F.col(group).alias("__g"), F.explode(F.sequence(F.col(key) - width, F.col(key) + width)).alias("__k"))
    j = rows.join(want, (rows[key] == F.col("__k")) & (rows[group] == F.col("__g")))
    j = j.groupBy("query", key).agg(F.min(F.struct("seed_rank", (F.col(key) != F.col("seed")).alias("other"))).alias("at"))
    return j.select("query", key, F.col("at.seed_rank").alias("seed_rank"), (~F.col("at.other")).alias("is_seed"))


def slot_pack(df: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Rows of each group packed into three slots (35, 35 and 30 % of the budget), spare room passing on.

    ``df``: the ``by`` columns, key, slot (0 decisions, 1 anchored, 2 rest), rank and
    size. In a slot the longest prefix that fits is taken, and an empty slot may take
    its first row if it fits what is left in all. No slot takes more than the whole
    budget, so each is cut there by a distributed prefix sum before a task sees it.
    """
    d, a = int(budget * 0.35), int(budget * 0.35)
    rows = token_pack(df, [*by, "slot"], F.floor(F.col("rank") / 1000), [F.col("rank"), F.col("key")], F.col("size"), budget)
    cols = [*by, "key", "slot", "rank", "size"]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["slot", "rank"])
        room, used, keep, spare = [d, a, budget - d - a], 0, [], 0
        for s in (0, 1, 2):
            part = g[g["slot"] == s]
            limit = max(1, min(room[s] + spare, budget - used))
            taken = 0
            for i, size in zip(part.index, part["size"]):
                if taken + size <= limit or (taken == 0 and used + size <= budget):
                    keep.append(i)
                    taken += size
                    if taken >= limit:
                        break
                else:
                    break
            spare = max(room[s] + spare - taken, 0)
            used += taken
        return g.loc[keep, cols]

    return rows.select(cols).groupBy(*by).applyInPandas(pack, rows.select(cols).schema)


def turn_windows(df: DataFrame, by: list[str], order: list[Column], size: int = 6, stride: int = 3) -> DataFrame:
    """(by, window, pos and the row): overlapping windows over ordered turns; the last one reaches the end."""
    w = Window.partitionBy(*by)
    d = df.withColumn("pos", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    last = F.ceil(F.greatest(F.col("__n") - size, F.lit(0)) / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / stride))
    upto = F.least(last, F.floor(F.col("pos") / stride))
    return d.filter(first <= upto).withColumn("window", F.explode(F.sequence(first, upto))).drop("__n")


def skip_pack(df: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Rows of each group in rank order, each taken if it still fits.

    ``df``: the ``by`` columns, key, rank and size. The room only shrinks, so the rows
    taken of one size are the first of that size, and sum to the budget at most: what
    goes beyond is cut before a task sees it.
    """
    rows = df.select(*by, "key", "rank", "size")
    cut = token_pack(rows.filter("size > 0"), [*by, "size"], F.floor(F.col("rank") / 1000), [F.col("rank"), F.col("key")], F.col("size"), budget)
    rows = cut.select(rows.columns).unionByName(rows.filter("size <= 0"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        g = g.sort_values(["rank", "key"])
        for i, size in zip(g.index, g["size"]):
            if size <= left:
                keep.append(i)
                left -= size
        return g.loc[keep]

    return rows.groupBy(*by).applyInPandas(pack, rows.schema)
