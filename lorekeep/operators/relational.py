"""Reads over row tables: live rows, pages, neighbours, latest-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def where_all(df: DataFrame, **equal: str | int | None) -> DataFrame:
    """AND of the given equalities; None means no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def keyset_page(df: DataFrame, at: Column, key: Column, after: tuple | None, size: int) -> DataFrame:
    """Up to ``size`` rows after the position ``after`` = (time, key), newest first. A top-k: no shuffle of the table."""
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        df = df.filter((at < t) | ((at == t) & (key < k)))
    return df.orderBy(at.desc(), key.desc()).limit(size)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank within a group; with ``k`` only the first k (pruned per task before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if k is None else out.filter(F.col(name) <= k)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by map-side aggregation (a hot key costs a row a task)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def near_keys(df: DataFrame, anchors: DataFrame, key: str, group: str, width: int) -> DataFrame:
    """Rows of the anchors' group whose key is within ``width`` of the anchor's: the range becomes an equality on the unrolled keys."""
    wanted = anchors.select(F.col(key).alias("anchor"), F.col(group).alias("__g"), F.explode(F.sequence(F.col(key) - width, F.col(key) + width)).alias("__k"))
    return df.join(wanted, (df[key] == F.col("__k")) & (df[group] == F.col("__g"))).drop("__k", "__g")


def orphan_rows(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent, on, "left_anti")
