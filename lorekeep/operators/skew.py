"""Lookups whose left side may have hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the left rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row a key) although keys of ``left`` may be hot.

    Rows of hot keys meet the right side by a broadcast of at most
    ``1 / HOT_SHARE`` = 500 rows; all others by a plain shuffle join. ``how`` is
    ``left`` or ``inner``. Null keys match nothing and count as cold.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = left.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__all"))
    hot = counts.join(F.broadcast(total)).filter(F.col("__n") > HOT_SHARE * F.col("__all")).filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, F.lit(True).alias("__hot"))
    flagged = left.join(F.broadcast(hot), keys, "left")
    few = right.join(F.broadcast(hot.drop("__hot")), keys, "left_semi")
    cold = flagged.filter(F.col("__hot").isNull()).drop("__hot").join(right, keys, how)
    warm = flagged.filter(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(few), keys, how)
    return cold.unionByName(warm)
