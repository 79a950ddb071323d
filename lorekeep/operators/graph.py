"""Entity graphs: edges, neighbourhoods, walks and ranks.

Edges are frames (src, dst, weight) with both directions present; walks are joins
hop by hop, and iterations are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import backticked, entity_key, has_file_ending, is_path
from lorekeep.scratch import Scratch


#: Graphs of up to so many nodes have their ranks broadcast.
FEW_NODES = 500_000


def comention_edges(mentions: DataFrame, entity: str = "entity_id", obs: str = "observation_id") -> DataFrame:
    """(src, dst, weight, first_obs), src < dst: in how many observations both occur."""
    m = mentions.select(F.col(entity).alias("e"), F.col(obs).alias("o")).distinct()
    pairs = m.withColumnRenamed("e", "src").join(m.withColumnRenamed("e", "dst"), "o").filter("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("o").alias("first_obs"))


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, degree_cap: int | None = None) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` steps and their least distance.

    A target of more neighbours than ``degree_cap`` is not entered; seeds always are.
    """
    if degree_cap is not None:
        ok = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= degree_cap).select("dst")
        edges = edges.join(ok, "dst", "left_semi")
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("hop"))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.select("seed", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h).cast("long"))
        seen = seen.unionByName(frontier)
    return seen


def graph_rank(reached: DataFrame, mentions: DataFrame, boost: float = 0.15) -> DataFrame:
    """(seed, observation_id, score): boost * sum of 0.5^hop over the reached entities an observation mentions."""
    j = reached.join(mentions, reached["node"] == mentions["entity_id"])
    return j.groupBy("seed", "observation_id").agg((boost * F.sum(F.pow(F.lit(0.5), F.col("hop")))).alias("score"))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 20, every: int = 5) -> DataFrame:
    """(node, score): p = (1 - alpha) e + alpha (what flows in), mass of nodes without an exit returns to the seeds.

    Loops and edges without positive weight are dropped; without valid seeds every
    node is one. A round is one join and one aggregation; lineage is cut every few.
    """
    s = Scratch(edges.sparkSession, "pagerank")
    e = edges.filter("src <> dst AND weight > 0")
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = s.save(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = flow.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    hit = nodes.join(seeds.select("node").distinct().withColumn("is_seed", F.lit(True)), "node", "left")
    n = hit.agg(F.count_if(F.col("is_seed")).alias("k"), F.count(F.lit(1)).alias("n")).first()
    k, n_all = n["k"], n["n"]
    start = F.when(F.col("is_seed"), 1.0 / k).otherwise(0.0) if k else F.lit(1.0 / max(n_all, 1))
    ends = flow.select(F.col("src").alias("node")).distinct().withColumn("goes", F.lit(True))
    base = s.save(hit.select("node", start.alias("e")).join(ends, "node", "left"))
    p = base.select("node", F.col("e").alias("p"))
    # ranks of a counted number of nodes go to the edges, which then stay in place; else both sides are shuffled
    sent = F.broadcast if n_all <= FEW_NODES else (lambda df: df)
    for i in range(rounds):
        inflow = sent(p).join(flow, p["node"] == flow["src"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("share")).alias("inflow"))
        lost = p.join(base.filter("goes IS NULL").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("lost"))
        p = base.join(sent(inflow), base["node"] == inflow["dst"], "left").join(F.broadcast(lost)).select("node", ((1 - alpha) * F.col("e") + alpha * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") * F.col("e"))).alias("p"))
        if (i + 1) % every == 0:
            p = s.save(p)
    return p.select("node", F.col("p").alias("score"))


def beam_walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, beam: int = 96, fade: float = 0.65, prune: float = 0.85) -> DataFrame:
    """(seed, node, score): best path products, pruned hop by hop.

    A step multiplies by fade * max(confidence, 0.01) * sqrt(max(weight, 0.01)); a
    path keeps going if it beats ``prune`` times the best known for its node, and
    each seed keeps its ``beam`` best. All of a hop is compared with what the hops
    before it reached, so the order of edges does not matter.
    """
    best = seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score"))
    frontier = best
    gain = fade * F.greatest("confidence", F.lit(0.01)) * F.sqrt(F.greatest("weight", F.lit(0.01)))
    for _ in range(hops):
        step = frontier.select("seed", F.col("node").alias("src"), "score").join(edges, "src")
        step = step.groupBy("seed", F.col("dst").alias("node")).agg(F.max(F.col("score") * gain).alias("score"))
        known = best.groupBy("seed", "node").agg(F.max("score").alias("known"))
        step = step.join(known, ["seed", "node"], "left").filter(F.col("known").isNull() | (F.col("score") > prune * F.col("known"))).drop("known")
        w = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "node")
        frontier = step.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= beam).drop("r")
        best = best.unionByName(frontier)
    return best.groupBy("seed", "node").agg(F.max("score").alias("score"))


def entity_walk(links: DataFrame, seeds: DataFrame, per_entity: int = 10, gain: float = 0.1, cap: float = 1.0) -> DataFrame:
    """(seed, fact_id, boost): facts two hops away over shared entities; each second entity gives its first facts by id."""
    first = seeds.join(links, seeds["node"] == links["entity_id"]).select("node", "fact_id")
    second = first.join(links, "fact_id").filter("entity_id <> node").select("node", "entity_id").distinct()
    w = Window.partitionBy("entity_id").orderBy("fact_id")
    few = links.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_entity).drop("r")
    paths = second.join(few, "entity_id").groupBy(F.col("node").alias("seed"), "fact_id").agg(F.count(F.lit(1)).alias("n"))
    return paths.select("seed", "fact_id", F.least(F.lit(cap), gain * F.col("n")).alias("boost"))


def mine_entities(df: DataFrame, key: str, title: str, content: str, anchors: str | None = None, most: int = 12) -> DataFrame:
    """(key, norm_name, name, kind, source, pos): entities of anchors, then of backticks, then path-like words of title and content.

    At most ``most`` of the backticked and of the path-like ones are looked at; a
    normalized name counts once, by its first source. An anchor ``path::symbol``
    names a file and a symbol. ``anchors`` is a column of arrays; null means none.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    entity = lambda name, kind, source: F.struct(name.alias("name"), kind.alias("kind"), F.lit(source).alias("source"))
    shape = lambda t: F.when(F.contains(t, F.lit("/")) | has_file_ending(t), "file").otherwise("concept")
    ticks = F.transform(F.slice(backticked(text), 1, most), lambda t: entity(t, shape(t), "backtick"))
    paths = F.transform(F.slice(F.filter(F.split(text, r"\s+"), is_path), 1, most), lambda t: entity(t, F.lit("file"), "token"))
    parts = [ticks, paths]
    if anchors:
        path = lambda a: entity(F.regexp_replace(F.get(F.split(F.trim(a), "::"), F.lit(0)), r"^\./", ""), F.lit("file"), "anchor")
        symbol = lambda a: entity(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(a), "::(.*)$", 1), "^&", ""), r"\(\)$", ""), F.lit("symbol"), "anchor")
        listed = F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
        parts.insert(0, F.flatten(F.transform(listed, lambda a: F.when(F.contains(a, F.lit("::")), F.array(path(a), symbol(a))).otherwise(F.array(path(a))))))
    rows = df.select(F.col(key), F.posexplode(F.concat(*parts)).alias("pos", "e")).select(key, "pos", entity_key(F.col("e.name")).alias("norm_name"), "e")
    g = rows.filter("norm_name <> ''").groupBy(key, "norm_name").agg(F.min_by("e", "pos").alias("e"), F.min("pos").cast("long").alias("pos"))
    return g.select(key, "norm_name", "e.name", "e.kind", "e.source", "pos")
