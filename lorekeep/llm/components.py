"""Pairwise matches consolidated into groups.

The giant component is peeled by a frontier breadth-first search from the vertex of
highest degree and joined away; what remains is labelled by minimum propagation in
alternating large-star and small-star steps, which take a logarithmic number of
rounds on chains of any length: a search that ends before its component does leaves
that to them. Every step reads a written table, so adaptive
execution knows its sizes and splits the partitions of hot vertices; minima are
gathered map-side before they move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.scratch import Scratch



def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges a < b, once each, from columns x and y."""
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _peel(s: Scratch, edges: DataFrame) -> DataFrame:
    """The vertices that the search from the hub reaches, the hub among them.

    The search ends with its frontier, or after about log2 of the edges rounds: a giant
    component is that wide, and what is wider is a chain, which contraction shortens
    in fewer rounds. An edge joins vertices of the same or neighbouring distance, so
    the two newest frontiers are all that a new one can meet again.
    """
    sym = s.save(_both(edges))
    n, hub = sym.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max_by("u", F.struct(F.col("n"), -F.col("u")))).first()
    # the hub's own edges are a filter, so its degree puts no load on one task
    older = s.save(edges.filter((F.col("a") == hub) | (F.col("b") == hub)).limit(1).select(F.lit(hub).cast("long").alias("v")))
    newest = s.save(sym.filter(F.col("u") == hub).select("v").distinct())
    reached = [older, newest]
    around = sym.filter(F.col("v") != hub)
    for _ in range(int(n).bit_length() + 1):
        reach = around.join(newest.select(F.col("v").alias("u")), "u", "left_semi").select("v").distinct()
        nxt = s.save(reach.join(newest.unionByName(older), "v", "left_anti"))
        if nxt.isEmpty():
            break
        older, newest = newest, nxt
        reached.append(nxt)
    s.drop(sym)
    return reduce(DataFrame.unionByName, reached)


def _large_star(edges: DataFrame) -> DataFrame:
    sym = _both(edges)
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _edges(sym.filter("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(low, "b").select(F.col("a").alias("x"), F.col("m").alias("y"))
    return _edges(joined.unionByName(low.select(F.col("b").alias("x"), F.col("m").alias("y"))))


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(record_id, group_id): one row per id on either side; group_id is the smallest id of its group.

    Defined cases: a null on one side or the same id twice links nothing, but the
    id is still a record; repeated and turned pairs count once; other columns are
    ignored; an empty table gives an empty result.
    """
    s = Scratch(pairs.sparkSession, "components")
    p = pairs.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y"))
    ids = p.select(F.explode(F.array("x", "y")).alias("record_id")).filter("record_id IS NOT NULL").distinct()
    edges = s.save(_edges(p))
    if not edges.limit(1).count():
        return ids.select("record_id", F.col("record_id").alias("group_id"))

    # the peeled part shrinks to its smallest vertex; if the search was cut short,
    # edges out of it keep the component together
    visited = _peel(s, edges)
    low = visited.agg(F.min("v")).first()[0]
    mark = visited.withColumn("seen", F.lit(True))
    cut = edges.join(mark.select(F.col("v").alias("a"), F.col("seen").alias("seen_a")), "a", "left")
    cut = cut.join(mark.select(F.col("v").alias("b"), F.col("seen").alias("seen_b")), "b", "left")
    cut = cut.filter("seen_a IS NULL OR seen_b IS NULL")
    cut = cut.select(F.when(F.col("seen_a"), F.lit(low)).otherwise(F.col("a")).alias("x"), F.when(F.col("seen_b"), F.lit(low)).otherwise(F.col("b")).alias("y"))
    rest = s.save(_edges(cut))

    before = None
    while True:
        now = tuple(rest.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        nxt = s.save(_small_star(_large_star(rest)))
        s.drop(rest)
        rest = nxt
    # only stars are left: each edge goes from a root a to a member b
    stars = rest.select(F.col("b").alias("record_id"), F.col("a").alias("group_id"))
    root = stars.filter(F.col("record_id") == low).select("group_id").first()
    giant = visited.select(F.col("v").alias("record_id"), F.lit(root[0] if root else low).cast("long").alias("group_id"))
    labels = stars.filter(F.col("record_id") != low).unionByName(giant)
    return ids.join(labels, "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))
