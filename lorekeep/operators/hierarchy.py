"""Parent-child links to full hierarchies.

Sizes of subtrees are gathered upward, preorder ranges are allotted downward by
prefix sums over siblings, and the nested ranges answer every question on ancestors
and descendants: a node's root is the root range that holds its preorder number, its
depth the number of ranges open there. Both passes double the distance they cover
each round, so a chain of length d takes about log2(d) rounds. Nodes that the upward
pass never finishes lie on a circle or lead into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.prefix import block_prefix_sum
from lorekeep.scratch import Scratch

#: Siblings that a window may hold on average, and preorder numbers of a block of the range sweep.
SIBLINGS, SWEEP_BITS = 50_000, 14


def _links(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node_id, parent_id, pointed): rows once, pointers to missing nodes cut."""
    rows = df.select(F.col(node).cast("long").alias("node_id"), F.col(parent).cast("long").alias("ptr")).filter("node_id IS NOT NULL")
    rows = rows.groupBy("node_id").agg(F.max("ptr").alias("ptr"))
    targets = rows.select(F.col("ptr").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    real = rows.join(targets, "node_id", "left_semi").select(F.col("node_id").alias("parent_id"))
    # targets are unique, so the hot side is only the child side; AQE splits it
    child = rows.filter("ptr IS NOT NULL").join(real, F.col("ptr") == F.col("parent_id"), "left").select("node_id", "parent_id")
    top = real.select(F.col("parent_id").alias("node_id")).join(child.select("node_id"), "node_id", "left_anti")
    return child.unionByName(top.select("node_id", F.lit(None).cast("long").alias("parent_id")))


def hierarchy(df: DataFrame, node: str, parent: str, with_path: bool = False) -> DataFrame:
    """One row per node that has a pointer or is the target of one.

    Columns: node_id, parent_id, root_id, depth, subtree_size, pre, last, is_cycle
    and, on request, path (array from the node to its root). ``pre``..``last`` is
    the node's nested-set range over the whole forest: d is a descendant of a
    exactly if a.pre < d.pre <= a.last.

    Defined cases: null nodes are left out; repeated rows count once, and of
    several pointers of one node the largest id holds; a null pointer or one to a
    missing node ends the path (depth counts from there); a node on a circle or
    leading into one has root_id = smallest id on the circle, depth -1 and null
    size, range and path; a node that points to itself is a circle of one. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    s = Scratch(spark, "hierarchy")
    links = s.save(_links(df, node, parent))

    # upward: cnt = nodes of the subtree within 2^k steps, anc = ancestor 2^k steps up
    state = links.select("node_id", F.col("parent_id").alias("anc"), F.lit(1).cast("long").alias("cnt"), F.col("node_id").alias("low"))
    state = s.save(state)
    active = state.filter("anc IS NOT NULL").count()
    while active:
        gain = state.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("node_id")).agg(F.sum("cnt").alias("gain"))
        far = state.select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        step = state.join(far, "anc", "left").join(gain, "node_id", "left")
        nxt = s.save(step.select("node_id", F.col("anc2").alias("anc"), (F.col("cnt") + F.coalesce("gain", F.lit(0))).alias("cnt"), F.least("low", "low2").alias("low")))
        left = nxt.filter("anc IS NOT NULL").count()
        s.drop(state)
        state, before, active = nxt, active, left
        if left == before:  # no node has a depth in between, so none finishes any more
            break
    rings = state.filter("anc IS NOT NULL")
    if active:
        # the same doubling on what is left, until a stretch covers any circle
        span, ring = 1, rings.select("node_id", "anc", "low")
        # the distance behind anc is at least 1; count rounds afresh to stay on the safe side
        while span < active:
            far = ring.select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
            ring = s.save(ring.join(far, "anc").select("node_id", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low")))
            span *= 2
        at = ring.select(F.col("node_id").alias("anc"), F.col("low").alias("root_id"))
        rings = s.save(ring.join(at, "anc").select("node_id", "root_id"))

    # downward: own offset among the siblings, then sums of offsets along the path
    tree = links.join(state.filter("anc IS NULL").select("node_id", F.col("cnt").alias("subtree_size")), "node_id")
    blocks = state.filter("anc IS NULL").count() // SIBLINGS + 1
    # any order of siblings will do; one by hash spreads a parent of any number of children evenly
    block = F.pmod(F.xxhash64("node_id"), F.lit(blocks))
    placed = block_prefix_sum(tree, ["parent_id"], block, [F.col("node_id")], F.col("subtree_size"), "off")
    offset = F.when(F.col("parent_id").isNull(), F.col("off")).otherwise(F.col("off") + 1)
    own = [F.array("node_id").alias("path")] if with_path else []
    placed = s.save(placed.select("node_id", "parent_id", "subtree_size", F.col("parent_id").alias("anc"), offset.alias("pre"), *own))
    s.drop(state)
    down = placed.select("node_id", "anc", "pre", *(["path"] if with_path else []))
    while down.filter("anc IS NOT NULL").limit(1).count():
        far = down.select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("pre").alias("pre2"), *([F.col("path").alias("path2")] if with_path else []))
        grown = [F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path")] if with_path else []
        nxt = s.save(down.join(far, "anc", "left").select("node_id", F.col("anc2").alias("anc"), (F.col("pre") + F.coalesce("pre2", F.lit(0))).alias("pre"), *grown))
        s.drop(down)
        down = nxt
    nodes = placed.select("node_id", "parent_id", "subtree_size").join(down.drop("anc"), "node_id")
    nodes = s.save(nodes.withColumn("last", F.col("pre") + F.col("subtree_size") - 1))
    s.drop(placed, down)
    good = nodes.join(_sweep(nodes, blocks * SIBLINGS), "node_id").select(
        "node_id", "parent_id", "root_id", "depth", "subtree_size", "pre", "last", F.lit(False).alias("is_cycle"), *(["path"] if with_path else []),
    )
    if active:
        bad = rings.join(links, "node_id").select(
            "node_id", "parent_id", "root_id", F.lit(-1).cast("long").alias("depth"), *[F.lit(None).cast("long").alias(c) for c in ("subtree_size", "pre", "last")],
            F.lit(True).alias("is_cycle"), *([F.lit(None).cast("array<bigint>").alias("path")] if with_path else []),
        )
        good = good.unionByName(bad)
    return good


def _sweep(nodes: DataFrame, most: int) -> DataFrame:
    """(node_id, root_id, depth) from the nested ranges alone.

    A sweep over preorder numbers, which are dense: a range opens at ``pre`` and closes
    behind ``last``. Depth is the number of ranges still open, the root is the last
    root range that opened (root ranges do not overlap). The sweep runs block by block
    of equal numbers of nodes; a row a block carries what the blocks before it left.
    """
    bits = max(SWEEP_BITS, most.bit_length() - SWEEP_BITS)  # so there are at most about 2^15 blocks
    top = F.when(F.col("parent_id").isNull(), F.col("node_id"))
    opens = nodes.select(F.col("pre").alias("pos"), F.lit(1).alias("step"), "node_id", top.alias("top"))
    closes = nodes.select((F.col("last") + 1).alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("top"))
    rows = opens.unionByName(closes).withColumn("blk", F.shiftright("pos", bits))
    totals = rows.groupBy("blk").agg(F.sum("step").alias("open"), F.max_by("top", F.when(F.col("top").isNotNull(), F.col("pos"))).alias("top"))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # a row a block, see ``bits``
    heads = totals.select("blk", F.coalesce(F.sum("open").over(before), F.lit(0)).alias("open0"), F.last("top", ignorenulls=True).over(before).alias("top0"))
    w = Window.partitionBy("blk").orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0)  # at equal places ranges close first
    swept = rows.select("blk", "node_id", F.sum("step").over(w).alias("open1"), F.last("top", ignorenulls=True).over(w).alias("top1")).filter("node_id IS NOT NULL")
    return swept.join(F.broadcast(heads), "blk").select("node_id", F.coalesce("top1", "top0").alias("root_id"), (F.col("open0") + F.col("open1") - 1).alias("depth"))


def descendants(tree: DataFrame, chunk: int = 1024) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from the nested ranges of ``hierarchy``.

    Each range is cut into chunks and unrolled to preorder numbers, which meet the
    nodes by an equality join: the work is as large as the result, and a root with
    a third of all nodes spreads over its chunks. Circles have no descendants here.
    """
    t = tree.filter("NOT is_cycle")
    up = t.filter("last > pre").select(F.col("node_id").alias("ancestor_id"), F.col("depth").alias("d0"), (F.col("pre") + 1).alias("lo"), F.col("last").alias("hi"))
    up = up.select("ancestor_id", "d0", "hi", F.explode(F.sequence("lo", "hi", F.lit(chunk).cast("long"))).alias("lo"))
    up = up.select("ancestor_id", "d0", F.explode(F.sequence("lo", F.least(F.col("hi"), F.col("lo") + chunk - 1))).alias("pre"))
    return up.join(t.select("pre", F.col("node_id").alias("descendant_id"), "depth"), "pre").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("d0")).alias("distance"))
