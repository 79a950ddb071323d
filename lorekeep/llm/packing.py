"""Items of varying length in containers of fixed capacity.

Bulk-synchronous best fit. Items and gaps are kept in sorted order as runs of equal
size, so one round serves all items of a size at once: the successor sweep finds the
smallest gap that takes them, ranks decide which item takes which gap, and the gaps
are updated before the next, smaller size. There are at most ``capacity`` sizes, so
the order of items and gaps is a table bounded by the capacity, whatever the number
of items; counting, ranking and placing the items is distributed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.prefix import block_prefix_sum
from lorekeep.scratch import Scratch

#: Rows that a rank window may hold on average.
RANK_BLOCK = 50_000


def best_fit_runs(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rounds of best fit over runs of equal size, largest first.

    ``sizes`` has (size, number of items). Returns (size, first rank, items, first
    container, items a container) for each stretch of items, and the number of
    containers. An item of rank r in a stretch goes to container
    ``first + (r - first rank) // items a container``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sizes of the gaps that exist, ascending
    at: dict[int, list[tuple[int, int]]] = {}  # gap -> stretches (first container, number)
    made = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in at:
                at[gap] = []
                insort(gaps, gap)
            at[gap].append((first, n))

    for size, items in sorted(sizes, reverse=True):
        rank = 0
        while rank < items:
            i = bisect_left(gaps, size)
            if i < len(gaps):
                gap = gaps[i]
                first, n = at[gap].pop()
                if not at[gap]:
                    del at[gap], gaps[i]
            else:
                gap, first, n = capacity, made, -(-(items - rank) // (capacity // size))
                made += n
            each = gap // size
            take = min(items - rank, n * each)
            whole, odd = divmod(take, each)
            runs.append((size, rank, take, first, each))
            leave(gap - each * size, first, whole)
            leave(gap - odd * size, first + whole, 1 if odd else 0)
            leave(gap, first + whole + (odd > 0), n - whole - (odd > 0))
            rank += take
    return runs, made


def pieces(docs: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, piece, start_token, size): whole documents, or parts of those above the capacity."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    cut = docs.filter("tokens > 0").select(key, "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select(key, "piece", start.alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).alias("size"))


def pack(docs: DataFrame, capacity: int, key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(key, piece, start_token, size, container_id) of documents with ``key`` and ``tokens``.

    Defined cases: a document with no tokens (null or empty text) takes no room and
    has no row; a document above the capacity is cut into full pieces and a rest; of
    repeated keys the largest size holds; equal sizes are placed by a hash of the
    key, so the result does not depend on row order; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    s = scratch or Scratch(docs.sparkSession, "packing")
    items = pieces(docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("tokens").alias("tokens")), capacity, key)
    # at most `capacity` rows
    sizes = [(r[0], r[1]) for r in items.groupBy("size").agg(F.count(F.lit(1))).collect()]
    runs, _ = best_fit_runs(sizes, capacity)
    blocks = sum(n for _, n in sizes) // RANK_BLOCK + 1
    block = F.pmod(F.xxhash64(key, "piece"), F.lit(blocks))
    ranked = block_prefix_sum(items.withColumn("blk", block), ["size"], F.col("blk"), [F.col(key), F.col("piece")], F.lit(1), "rank").drop("blk")

    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    order = table[:, 0] << 40 | table[:, 1]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = table[np.searchsorted(order, p["size"].to_numpy() << 40 | p["rank"].to_numpy(), side="right") - 1]
            p["container_id"] = at[:, 3] + (p["rank"].to_numpy() - at[:, 1]) // at[:, 4]
            yield p.drop(columns=["rank"])

    out = ranked.withColumn("rank", F.col("rank").cast("long"))
    return out.mapInPandas(place, f"{key} long, piece int, start_token long, size long, container_id long")
