"""Distributed ranks and prefix sums.

A window over a whole group puts the group into one task. Here each group is cut
into blocks by an order-preserving block number, windows run inside a block, and
the sums of the earlier blocks are added; a hot group spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_prefix_sum(df: DataFrame, group: list[str], block: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    ``block`` must not decrease along ``order`` within a group and should bound
    the rows that share it. The sum is exclusive of the row itself. ``order`` must
    be total within a group; a null value counts as 0.
    """
    b, v, head = "__block", "__value", "__head"
    rows = df.withColumn(b, block).withColumn(v, F.coalesce(value, F.lit(0)))
    inner = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    totals = rows.groupBy(*group, b).agg(F.sum(v).alias(v))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    heads = totals.select(*group, b, F.coalesce(F.sum(v).over(before), F.lit(0)).alias(head))
    keys = [*group, b]
    cond = None
    r, h = rows.alias("r"), heads.alias("h")
    for k in keys:
        c = F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
        cond = c if cond is None else cond & c
    return r.join(h, cond).select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{out}") + F.col(f"h.{head}")).alias(out))
