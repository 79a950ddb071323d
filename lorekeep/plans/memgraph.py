"""Queries over the graph of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import context as cx
from lorekeep.operators import graph as gr
from lorekeep.operators import memory_graph as mg
from lorekeep.operators.relational import ranked
from lorekeep.plans.graphs import MINED
from lorekeep.plans.registry import Registry, table
from lorekeep.scratch import Scratch
from lorekeep.sources.memory import facts, mentions, observations

R = Registry()
_T = """WITH o AS (SELECT DISTINCT * FROM observations), f AS (SELECT DISTINCT * FROM facts), m AS (SELECT DISTINCT l.entity_id, f.evidence_obs_id AS ob FROM entity_links l JOIN f ON f.fact_id = l.fact_id WHERE f.evidence_obs_id IS NOT NULL),
ce AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*)::DOUBLE AS weight, min(a.ob) AS first_obs FROM m a JOIN m b ON a.ob = b.ob AND a.entity_id < b.entity_id GROUP BY 1, 2)"""
_NODES = """, nodes AS (SELECT 'entity' AS kind, 'entity:' || entity_id AS ref_key, name AS label, norm_name AS norm_key, 1.0::DOUBLE AS confidence FROM entities
 UNION ALL SELECT DISTINCT 'session', 'session:' || session_id, session_id, lower(session_id), 1.0 FROM o WHERE session_id IS NOT NULL
 UNION ALL SELECT 'observation', 'observation:' || id, title, lower(title), 1.0 FROM o
 UNION ALL SELECT 'fact', 'fact:' || fact_id, subject || ' ' || predicate || ' ' || object, lower(subject || '|' || predicate || '|' || object), CASE WHEN salience BETWEEN 0 AND 1 THEN salience ELSE 0.5 END FROM f)"""
_EDGES = """, edges AS (SELECT 'session:' || session_id AS src, 'observation:' || id AS dst, 'contains' AS relation, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence, id AS observation_id FROM o WHERE session_id IS NOT NULL
 UNION ALL SELECT 'fact:' || fact_id, 'observation:' || o.id, 'derived_from', 1.0, 1.0, o.id FROM f JOIN o ON o.id = f.evidence_obs_id
 UNION ALL SELECT 'entity:' || entity_id, 'observation:' || o.id, 'mentions', 1.0, 1.0, o.id FROM m JOIN o ON o.id = m.ob
 UNION ALL SELECT 'entity:' || src, 'entity:' || dst, 'co_occurs', weight, 1.0, first_obs FROM ce)"""


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder)
    return mg.project_edges(observations(spark, folder), facts(spark, folder), m, gr.comention_edges(m))


@R.add("graph_nodes", _T + _NODES + " SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return mg.project_nodes(observations(spark, folder), facts(spark, folder), table(spark, folder, "entities"))


@R.add("graph_edges", _T + _EDGES + " SELECT * FROM edges")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@R.add("graph_histogram", _T + _NODES + _EDGES + """, c AS (SELECT 'node' AS part, kind AS label FROM nodes UNION ALL SELECT 'edge', relation FROM edges)
SELECT part, coalesce(label, '*') AS label, count(*) AS n FROM c GROUP BY GROUPING SETS ((part, label), (part))""")
def graph_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by kind and edges by relation, with totals."""
    rows = graph_nodes(spark, folder).select(F.lit("node").alias("part"), F.col("kind").alias("label")).unionByName(_edges(spark, folder).select(F.lit("edge").alias("part"), F.col("relation").alias("label")))
    g = rows.rollup("part", "label").agg(F.count(F.lit(1)).alias("n")).filter("part IS NOT NULL")
    return g.select("part", F.coalesce("label", F.lit("*")).alias("label"), "n")


_BOTH = """, w AS (SELECT src, dst, relation, weight, observation_id FROM edges WHERE relation IN ('mentions', 'co_occurs') UNION ALL SELECT dst, src, relation, weight, observation_id FROM edges WHERE relation IN ('mentions', 'co_occurs')),
seeds AS (SELECT 'entity:' || entity_id AS node FROM entities WHERE kind = 'agent')"""


def _walked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, folder).filter(F.col("relation").isin("mentions", "co_occurs"))
    seeds = table(spark, folder, "entities").filter("kind = 'agent'").select(mg.ref("entity", "entity_id").alias("node"))
    return Scratch(spark, "graph").save(gr.both_ways(e)), seeds


@R.add("bfs_by_relation", _T + _EDGES + _BOTH + """, h1 AS (SELECT DISTINCT s.node AS seed, w.dst AS node FROM seeds s JOIN w ON w.src = s.node), h2 AS (SELECT DISTINCT h.seed, w.dst AS node FROM h1 h JOIN w ON w.src = h.node),
hop AS (SELECT seed, node, min(hop) AS hop FROM (SELECT node AS seed, node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY 1, 2)
SELECT seed, split_part(node, ':', 1) AS kind, hop::BIGINT AS hop, count(*) AS n FROM hop GROUP BY 1, 2, 3""")
def bfs_by_relation(spark: SparkSession, folder: str) -> DataFrame:
    """What the agents reach within two steps along mentions and co-occurrence, counted by kind and distance."""
    e, seeds = _walked(spark, folder)
    h = gr.neighbourhood(e, seeds)
    return h.groupBy("seed", F.substring_index("node", ":", 1).alias("kind"), "hop").agg(F.count(F.lit(1)).alias("n"))


@R.add("graph_rank_boosted", _T + _EDGES + _BOTH + """, t1 AS (SELECT s.node AS seed, w.*, 1 AS hop FROM seeds s JOIN w ON w.src = s.node), n1 AS (SELECT DISTINCT seed, dst AS node FROM t1 WHERE dst <> seed),
t2 AS (SELECT n.seed, w.*, 2 AS hop FROM n1 n JOIN w ON w.src = n.node), h AS (SELECT seed, least(src, dst) AS a, greatest(src, dst) AS b, relation, observation_id, min(hop) AS hop, max(weight) AS weight FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT seed, observation_id, 0.15 * sum(weight * pow(0.5, hop) * CASE relation WHEN 'co_occurs' THEN 0.5 ELSE 1.0 END) AS score FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, observation_id) AS rank FROM s) SELECT seed, observation_id, round(score, 6) AS score, rank FROM r WHERE rank <= 64""")
def graph_rank_boosted(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 observations that the edges around an agent speak for most, by weight, distance and relation."""
    e, seeds = _walked(spark, folder)
    r = mg.boosted_rank(mg.traversed(e, seeds), 0.15)
    return r.select("seed", "observation_id", F.round("score", 6).alias("score"), "rank")


_G = "0.65 * greatest(confidence, 0.01) * sqrt(greatest(weight, 0.01))"


@R.add("path_walk", _T + f""", e AS (SELECT src, dst, weight, 0.5::DOUBLE AS confidence FROM ce UNION ALL SELECT dst, src, weight, 0.5 FROM ce), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, weight DESC, dst) AS n FROM e) WHERE n <= 8),
p0 AS (SELECT entity_id AS seed, [entity_id] AS path, 1.0::DOUBLE AS score FROM entities WHERE kind = 'agent'), s1 AS (SELECT seed, list_append(path, dst) AS path, score * {_G} AS score, dst AS node FROM p0 JOIN few ON src = path[-1] WHERE NOT list_contains(path, dst)),
p1 AS (SELECT seed, path, score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, path) AS r FROM s1) WHERE r <= 96), k AS (SELECT seed, path[-1] AS node, max(score) AS known FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1) GROUP BY 1, 2),
s2 AS (SELECT seed, list_append(path, dst) AS path, score * {_G} AS score, dst AS node FROM p1 JOIN few ON src = path[-1] WHERE NOT list_contains(path, dst)),
p2 AS (SELECT seed, path, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.seed ORDER BY round(score, 9) DESC, path) AS r FROM s2 s LEFT JOIN k ON k.seed = s.seed AND k.node = s.node WHERE known IS NULL OR score > 0.85 * known) WHERE r <= 96)
SELECT seed, array_to_string(path, '>') AS path, round(score, 6) AS score, len(path) - 1 AS hops FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""")
def path_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest walks of up to two steps from the agents, eight edges a node."""
    e = gr.both_ways(gr.comention_edges(mentions(spark, folder)).select("src", "dst", F.col("weight").cast("double").alias("weight"))).withColumn("confidence", F.lit(0.5))
    seeds = table(spark, folder, "entities").filter("kind = 'agent'").select(F.col("entity_id").alias("node"))
    p = mg.path_walk(e, seeds)
    return p.select("seed", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("score", 6).alias("score"), "hops")


@R.add("relation_upsert", """
WITH p AS (SELECT DISTINCT * FROM dream_proposals WHERE keep_id <> drop_id)
SELECT keep_id AS src, drop_id AS dst, kind AS relation, count(*)::DOUBLE AS weight, max(confidence) AS confidence, arg_min(proposed_at, (proposed_at, proposal_id)) AS valid_from FROM p GROUP BY 1, 2, 3
""")  # fmt: skip
def relation_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals as edges that come again: weights added, highest confidence, first validity."""
    p = table(spark, folder, "dream_proposals").distinct().filter("keep_id <> drop_id")
    e = p.select(F.col("keep_id").alias("src"), F.col("drop_id").alias("dst"), F.col("kind").alias("relation"), F.lit(1.0).alias("weight"), "confidence", F.col("proposed_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.struct("proposed_at", "proposal_id").alias("seq"))
    return mg.upsert_edges(e, ["src", "dst", "relation"], "seq").drop("valid_to")


@R.add("node_upsert", "WITH o AS (SELECT DISTINCT id, title, content, created_at FROM observations), " + MINED + """
SELECT norm_name AS ref_key, arg_max(name, (id, pos)) AS label, arg_min(kind, (id, pos)) AS kind, count(DISTINCT id) AS observations, max(CASE source WHEN 'backtick' THEN 0.9 ELSE 0.7 END)::DOUBLE AS confidence FROM mined GROUP BY 1
""")  # fmt: skip
def node_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Mined entities upserted by their normalized name: the name seen last is shown, the highest confidence holds."""
    m = gr.mine_entities(observations(spark, folder, wide=True), "id", "title", "content")
    seq, conf = F.struct("id", "pos"), F.when(F.col("source") == "backtick", 0.9).otherwise(0.7)
    return m.groupBy(F.col("norm_name").alias("ref_key")).agg(F.max_by("name", seq).alias("label"), F.min_by("kind", seq).alias("kind"), F.countDistinct("id").alias("observations"), F.max(conf).alias("confidence"))


@R.add("text_cooccurrence", "WITH o AS (SELECT DISTINCT id, title, content FROM observations), " + MINED + """
SELECT least(a.norm_name, b.norm_name) AS src, greatest(a.norm_name, b.norm_name) AS dst, count(*)::DOUBLE AS weight, min(a.id) AS first_obs FROM mined a JOIN mined b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2
""")  # fmt: skip
def text_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that a text names together; a text has 24 at most."""
    m = Scratch(spark, "mined").save(gr.mine_entities(observations(spark, folder, wide=True), "id", "title", "content").select("id", "norm_name", "pos"))
    p = m.alias("a").join(m.alias("b"), F.expr("a.id = b.id AND a.pos < b.pos"))
    return p.groupBy(F.least("a.norm_name", "b.norm_name").alias("src"), F.greatest("a.norm_name", "b.norm_name").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("a.id").alias("first_obs"))


@R.add("relations_of", """
WITH p AS (SELECT DISTINCT * FROM dream_proposals WHERE keep_id <> drop_id), e AS (SELECT keep_id AS id, drop_id AS other, kind, proposed_at, proposal_id FROM p UNION ALL SELECT drop_id, keep_id, kind, proposed_at, proposal_id FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY proposed_at DESC, proposal_id DESC) AS rank FROM e) SELECT id, other, kind, rank FROM r WHERE rank <= 5
""")  # fmt: skip
def relations_of(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest relations that touch each observation."""
    p = table(spark, folder, "dream_proposals").distinct().filter("keep_id <> drop_id")
    e = p.select(F.explode(F.array(F.struct(F.col("keep_id").alias("id"), F.col("drop_id").alias("other")), F.struct(F.col("drop_id").alias("id"), F.col("keep_id").alias("other")))).alias("x"), "kind", "proposed_at", "proposal_id")
    return ranked(e.select("x.*", "kind", "proposed_at", "proposal_id"), ["id"], [F.desc("proposed_at"), F.desc("proposal_id")], 5).select("id", "other", "kind", "rank")


_SIZE = "ceil(length(coalesce(type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,'')) / 4)::BIGINT"


@R.add("graph_context", _T.replace("WITH o AS", "WITH RECURSIVE o AS") + _EDGES + _BOTH + f""", t1 AS (SELECT s.node AS seed, w.*, 1 AS hop FROM seeds s JOIN w ON w.src = s.node), n1 AS (SELECT DISTINCT seed, dst AS node FROM t1 WHERE dst <> seed),
t2 AS (SELECT n.seed, w.*, 2 AS hop FROM n1 n JOIN w ON w.src = n.node), h AS (SELECT seed, least(src, dst) AS a, greatest(src, dst) AS b, relation, observation_id, min(hop) AS hop, max(weight) AS weight FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT seed, observation_id, 0.15 * sum(weight * pow(0.5, hop) * CASE relation WHEN 'co_occurs' THEN 0.5 ELSE 1.0 END) AS score FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, observation_id) AS rank FROM s QUALIFY rank <= 64),
z AS (SELECT seed, id, {_SIZE} AS size, row_number() OVER (PARTITION BY seed ORDER BY rank) AS n FROM r JOIN o ON o.id = r.observation_id WHERE deleted_at IS NULL),
g AS (SELECT seed, id, size, n, CASE WHEN size <= 800 THEN 800 - size ELSE 800 END AS room, size <= 800 AS taken FROM z WHERE n = 1
 UNION ALL SELECT z.seed, z.id, z.size, z.n, CASE WHEN z.size <= g.room THEN g.room - z.size ELSE g.room END, z.size <= g.room FROM g JOIN z ON z.seed = g.seed AND z.n = g.n + 1) SELECT seed, id, size FROM g WHERE taken""")
def graph_context(spark: SparkSession, folder: str) -> DataFrame:
    """What the graph adds to a context of each agent: its best ranked live observations, taken while they fit into 800 tokens, larger ones skipped."""
    from lorekeep.functions.text import token_estimate

    e, seeds = _walked(spark, folder)
    r = mg.boosted_rank(mg.traversed(e, seeds), 0.15).select("seed", F.col("observation_id").alias("id"), "rank")
    o = observations(spark, folder, live_only=True).select("id", token_estimate(F.col("type"), F.col("title"), F.col("content")).alias("size"))
    rows = r.join(o, "id").select("seed", F.col("id").alias("key"), "rank", "size")
    return cx.skip_pack(rows, ["seed"], 800).select("seed", F.col("key").alias("id"), "size")
