"""The graph of memories: sessions, observations, facts and entities as nodes, how they belong together as edges.

Nodes are (kind, ref_key, label, norm_key, confidence), edges (src, dst, relation,
weight, confidence, observation_id) between ref_keys. Both are projections of tables,
so a rebuild is the same query again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import entity_key

# What an edge of a relation adds to the rank of its observation.
RELATION_BOOST = {"mentions": 1.0, "about": 1.0, "fixes": 1.5, "contradicts": 1.2, "co_occurs": 0.5}


def ref(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key))


def project_nodes(observations: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """One node for each entity, session, observation and fact."""
    one = F.lit(1.0)
    parts = [
        entities.select(F.lit("entity").alias("kind"), ref("entity", "entity_id").alias("ref_key"), F.col("name").alias("label"), F.col("norm_name").alias("norm_key"), one.alias("confidence")),
        observations.filter("session_id IS NOT NULL").select("session_id").distinct().select(F.lit("session"), ref("session", "session_id"), "session_id", F.lower("session_id"), one),
        observations.select(F.lit("observation"), ref("observation", "id"), "title", F.lower("title"), one),
        facts.select(
            F.lit("fact"), ref("fact", "fact_id"), F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object"), F.lower(F.concat("subject", F.lit("|"), "predicate", F.lit("|"), "object")),
            F.when(F.col("salience").between(0, 1), F.col("salience")).otherwise(0.5),
        ),
    ]
    return reduce(DataFrame.union, parts)


def project_edges(observations: DataFrame, facts: DataFrame, mentions: DataFrame, co_occurs: DataFrame) -> DataFrame:
    """contains (session to observation), derived_from (fact to observation), mentions (entity to observation) and co_occurs (between entities)."""
    one = F.lit(1.0)
    known = observations.select(F.col("id").alias("observation_id"))
    cited = facts.select("fact_id", F.col("evidence_obs_id").alias("observation_id")).join(known, "observation_id")
    parts = [
        observations.filter("session_id IS NOT NULL").select(ref("session", "session_id").alias("src"), ref("observation", "id").alias("dst"), F.lit("contains").alias("relation"), one.alias("weight"), one.alias("confidence"), F.col("id").alias("observation_id")),
        cited.select(ref("fact", "fact_id"), ref("observation", "observation_id"), F.lit("derived_from"), one, one, "observation_id"),
        mentions.join(known, "observation_id").select(ref("entity", "entity_id"), ref("observation", "observation_id"), F.lit("mentions"), one, one, "observation_id"),
        co_occurs.select(ref("entity", "src"), ref("entity", "dst"), F.lit("co_occurs"), F.col("weight").cast("double"), one, F.col("first_obs")),
    ]
    return reduce(DataFrame.union, parts)


def upsert_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One node a kind and ref_key: the highest confidence, and the label that came last."""
    g = nodes.groupBy("kind", "ref_key").agg(F.max("confidence").alias("confidence"), F.max_by("label", order).alias("label"))
    return g.select("kind", "ref_key", "label", entity_key(F.col("label")).alias("norm_key"), "confidence")


def upsert_edges(edges: DataFrame, by: list[str], order: str) -> DataFrame:
    """One edge a key: weights added, the highest confidence, the first known validity in order of arrival."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return edges.groupBy(*by).agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), first("valid_from"), first("valid_to"))


def traversed(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, observation_id, weight, relation, hop): the edges that a search from each seed crosses, by the first hop that does.

    ``edges`` has both directions present; ``seeds`` has node.
    """
    seen = seeds.select(F.col("node").alias("seed"), "node")
    frontier, out = seen, []
    for h in range(1, hops + 1):
        step = frontier.withColumnRenamed("node", "src").join(edges, "src")
        out.append(step.select("seed", "observation_id", "weight", "relation", F.lit(h).cast("long").alias("hop"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")))
        frontier = step.select("seed", F.col("dst").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    hits = reduce(DataFrame.unionByName, out)
    return hits.groupBy("seed", "lo", "hi", "relation", "observation_id").agg(F.min("hop").alias("hop"), F.max("weight").alias("weight")).drop("lo", "hi")


def boosted_rank(hits: DataFrame, boost: float, k: int = 64) -> DataFrame:
    """(seed, observation_id, score, rank): boost * sum of weight * 0.5^hop * the relation's boost, the ``k`` best."""
    kind = reduce(lambda c, kv: c.when(F.col("relation") == kv[0], kv[1]), RELATION_BOOST.items(), F).otherwise(1.0)
    s = hits.groupBy("seed", "observation_id").agg((boost * F.sum(F.col("weight") * F.pow(F.lit(0.5), F.col("hop")) * kind)).alias("score"))
    w = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "observation_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def path_walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, degree_cap: int = 8, beam: int = 96, fade: float = 0.65, prune: float = 0.85) -> DataFrame:
    """(seed, path, score, hops): walks that never come back to a node, the ``beam`` best of each hop and seed.

    Each node gives its ``degree_cap`` edges of highest confidence and weight. A step
    multiplies by fade * confidence * sqrt(weight), each at least 0.01; it must beat
    ``prune`` times the best score that earlier hops reached its node with. All of a
    hop is compared with the hops before it, so the order of edges plays no role.
    """
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("weight"), "dst")
    few = edges.select("src", "dst", "confidence", "weight", F.row_number().over(w).alias("__n")).filter(F.col("__n") <= degree_cap).drop("__n")
    gain = fade * F.greatest("confidence", F.lit(0.01)) * F.sqrt(F.greatest("weight", F.lit(0.01)))
    paths = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("hops"))
    frontier, out = paths, paths
    for h in range(1, hops + 1):
        step = frontier.withColumn("src", F.element_at("path", -1)).join(few, "src").filter(~F.array_contains("path", F.col("dst")))
        step = step.select("seed", F.concat("path", F.array("dst")).alias("path"), (F.col("score") * gain).alias("score"), F.lit(h).cast("long").alias("hops"), F.col("dst").alias("node"))
        known = out.groupBy("seed", F.element_at("path", -1).alias("node")).agg(F.max("score").alias("known"))
        step = step.join(known, ["seed", "node"], "left").filter(F.col("known").isNull() | (F.col("score") > prune * F.col("known"))).drop("known", "node")
        best = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "path")
        frontier = step.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= beam).drop("__n")
        out = out.unionByName(frontier)
    return out
