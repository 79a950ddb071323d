"""References to records that do not exist.

Parent keys are sorted and compressed into contiguous runs; a reference is matched
as-of to the run that starts at or before its key and is an orphan if the key lies
beyond the run's end. A run keeps the time of each of its keys, so the same match
tells whether the parent came later than the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.skew import lookup

#: Runs are cut where keys differ above these low bits, so a block holds at most 2^BLOCK_BITS keys.
BLOCK_BITS = 6


def contiguous_runs(parents: DataFrame, key: str = "key", since: str = "since", bits: int = BLOCK_BITS) -> DataFrame:
    """(block, runs): the runs of a block as an array of (start, end, times), sorted by start.

    ``since`` is the parent's time; of repeated keys the earliest holds. Null keys
    are left out.
    """
    k = parents.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.min(since).alias("t"))
    k = k.withColumn("block", F.shiftright("k", bits))
    k = k.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("block").orderBy("k")))
    # a block has at most 2^bits keys, so neither the window nor the arrays can grow
    runs = k.groupBy("block", "run").agg(F.min("k").alias("start"), F.max("k").alias("end"), F.sort_array(F.collect_list(F.struct("k", "t"))).alias("kt"))
    runs = runs.select("block", F.struct("start", "end", F.col("kt.t").alias("times")).alias("r"))
    return runs.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("runs"))


def orphans(refs: DataFrame, parents: dict[str, DataFrame], bits: int = BLOCK_BITS) -> DataFrame:
    """``refs`` rows with no valid parent, with ``reason`` missing or later.

    ``refs`` has parent (a name in ``parents``), target (key) and at (time) besides
    any other columns; each frame of ``parents`` has key and since, only valid
    records. Null targets are no case; a null ``at`` or parent time cannot be later.
    Repeated rows are kept as they are. A hot target meets its block by broadcast.
    """
    runs = None
    for name, p in parents.items():
        r = contiguous_runs(p, bits=bits).select(F.lit(name).alias("parent"), "block", "runs")
        runs = r if runs is None else runs.unionByName(r)
    asked = refs.filter(F.col("target").isNotNull()).withColumn("block", F.shiftright(F.col("target").cast("long"), bits))
    met = lookup(asked, runs, ["parent", "block"], "left")
    # as-of: the last run that starts at or before the key
    before = F.filter("runs", lambda r: r["start"] <= F.col("target"))
    met = met.withColumn("__run", F.when(F.size(before) > 0, F.element_at(before, -1)))
    inside = F.col("__run").isNotNull() & (F.col("__run.end") >= F.col("target"))
    since = F.get("__run.times", (F.col("target") - F.col("__run.start")).cast("int"))
    reason = F.when(~inside, "missing").when(since > F.col("at"), "later")
    return met.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("block", "runs", "__run")
