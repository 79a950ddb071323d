"""Graph queries over entities, facts and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph as gr
from lorekeep.plans.registry import Registry, table
from lorekeep.sources.memory import links, mentions, observations

R = Registry()
_M = "WITH m AS (SELECT DISTINCT l.entity_id AS e, f.evidence_obs_id AS o FROM entity_links l JOIN facts f ON f.fact_id = l.fact_id WHERE f.evidence_obs_id IS NOT NULL)"
_E = _M + ", ce AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight, min(a.o) AS first_obs FROM m a JOIN m b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2), ed AS (SELECT src, dst, weight FROM ce UNION ALL SELECT dst, src, weight FROM ce)"
_SEEDS = ", seeds AS (SELECT entity_id AS node FROM entities WHERE kind = 'agent')"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.comention_edges(mentions(spark, folder))


def _seeds(spark: SparkSession, folder: str, kind: str = "agent") -> DataFrame:
    return table(spark, folder, "entities").filter(F.col("kind") == kind).select(F.col("entity_id").alias("node"))


@R.add("comention_edges", _E + " SELECT src, dst, weight, first_obs FROM ce")
def comention_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


_HOPS = """, h1 AS (SELECT DISTINCT s.node AS seed, e.dst AS node FROM seeds s JOIN ed e ON e.src = s.node WHERE e.dst <> s.node),
h2 AS (SELECT DISTINCT h.seed, e.dst AS node FROM h1 h JOIN ed e ON e.src = h.node),
hop AS (SELECT seed, node, min(hop) AS hop FROM (SELECT node AS seed, node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY 1, 2)"""


@R.add("bfs_two_hop", _E + _SEEDS + _HOPS + " SELECT seed, node, hop::BIGINT AS hop FROM hop")
def bfs_two_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbourhoods of the agent entities."""
    return gr.neighbourhood(gr.both_ways(_edges(spark, folder).select("src", "dst")), _seeds(spark, folder))


@R.add("bfs_degree_cap", _E + _SEEDS + ", deg AS (SELECT dst FROM ed GROUP BY dst HAVING count(*) <= 25), edc AS (SELECT * FROM ed WHERE dst IN (SELECT dst FROM deg))" + _HOPS.replace("JOIN ed e", "JOIN edc e") + " SELECT seed, node, hop::BIGINT AS hop FROM hop")
def bfs_degree_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The same without entering hubs: a rule of the walk, not a cut of its result."""
    return gr.neighbourhood(gr.both_ways(_edges(spark, folder).select("src", "dst")), _seeds(spark, folder), degree_cap=25)


@R.add("graph_rank", _E + _SEEDS + _HOPS + ", s AS (SELECT seed, m.o AS observation_id, 0.15 * sum(pow(0.5, hop)) AS score FROM hop JOIN m ON m.e = hop.node GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, observation_id) AS rank FROM s) SELECT seed, observation_id, round(score, 6) AS score, rank FROM r WHERE rank <= 64")
def graph_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 observations that the seed's neighbourhood mentions most."""
    from lorekeep.operators.relational import ranked

    reached = gr.neighbourhood(gr.both_ways(_edges(spark, folder).select("src", "dst")), _seeds(spark, folder))
    s = gr.graph_rank(reached, mentions(spark, folder))
    r = ranked(s, ["seed"], [F.desc(F.round("score", 9)), F.col("observation_id")], 64)
    return r.select("seed", "observation_id", F.round("score", 6).alias("score"), "rank")


def _ppr_sql(rounds: int = 20) -> str:
    q = _E + _SEEDS + """, tot AS (SELECT src, sum(weight) AS total FROM ed GROUP BY 1), fl AS (SELECT e.src, e.dst, e.weight / t.total AS share FROM ed e JOIN tot t ON t.src = e.src),
nd AS (SELECT DISTINCT src AS node FROM fl), k AS (SELECT count(*) AS k FROM nd WHERE node IN (SELECT node FROM seeds)),
base AS (SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 1.0::DOUBLE / k.k ELSE 0.0::DOUBLE END AS e FROM nd, k), p0 AS (SELECT node, e AS p FROM base)"""
    for i in range(rounds):
        q += f", p{i + 1} AS MATERIALIZED (SELECT b.node, 0.5 * b.e + 0.5 * coalesce(x.inflow, 0) AS p FROM base b LEFT JOIN (SELECT f.dst, sum(p.p * f.share) AS inflow FROM p{i} p JOIN fl f ON f.src = p.node GROUP BY f.dst) x ON x.dst = b.node)"
    return q + f" SELECT node, round(p, 8) AS score FROM p{rounds}"


@R.add("ppr_scores", _ppr_sql())
def ppr_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Personalized PageRank from the agent entities, 20 rounds."""
    p = gr.personalized_pagerank(gr.both_ways(_edges(spark, folder).select("src", "dst", "weight")), _seeds(spark, folder))
    return p.select("node", F.round("score", 8).alias("score"))


@R.add("ppr_observations", _ppr_sql().replace("SELECT node, round(p, 8) AS score FROM p20", ", n AS (SELECT e, count(*) AS n FROM m GROUP BY e) SELECT m.o AS observation_id, round(sum(p.p / n.n), 8) AS score FROM p20 p JOIN n ON n.e = p.node JOIN m ON m.e = p.node GROUP BY 1"))
def ppr_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations by the rank of the entities they mention, each weighted by how specific it is."""
    p = gr.personalized_pagerank(gr.both_ways(_edges(spark, folder).select("src", "dst", "weight")), _seeds(spark, folder))
    m = mentions(spark, folder)
    n = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    s = p.join(n, p["node"] == n["entity_id"]).select("entity_id", (F.col("score") / F.col("n")).alias("s"))
    return m.join(s, "entity_id").groupBy("observation_id").agg(F.round(F.sum("s"), 8).alias("score"))


_GAIN = "0.65 * greatest(0.5, 0.01) * sqrt(greatest(e.weight, 0.01))"


@R.add("beam_walk", _E + _SEEDS + f""", b0 AS (SELECT node AS seed, node, 1.0::DOUBLE AS score FROM seeds),
s1 AS (SELECT b.seed, e.dst AS node, max(b.score * {_GAIN}) AS score FROM b0 b JOIN ed e ON e.src = b.node GROUP BY 1, 2),
t1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.seed ORDER BY round(s.score, 9) DESC, s.node) AS r FROM s1 s LEFT JOIN b0 k ON k.seed = s.seed AND k.node = s.node WHERE k.score IS NULL OR s.score > 0.85 * k.score),
f1 AS (SELECT seed, node, score FROM t1 WHERE r <= 96), k1 AS (SELECT seed, node, max(score) AS score FROM (SELECT * FROM b0 UNION ALL SELECT * FROM f1) GROUP BY 1, 2),
s2 AS (SELECT b.seed, e.dst AS node, max(b.score * {_GAIN}) AS score FROM f1 b JOIN ed e ON e.src = b.node GROUP BY 1, 2),
t2 AS (SELECT s.*, row_number() OVER (PARTITION BY s.seed ORDER BY round(s.score, 9) DESC, s.node) AS r FROM s2 s LEFT JOIN k1 k ON k.seed = s.seed AND k.node = s.node WHERE k.score IS NULL OR s.score > 0.85 * k.score),
f2 AS (SELECT seed, node, score FROM t2 WHERE r <= 96)
SELECT seed, node, round(max(score), 6) AS score FROM (SELECT * FROM k1 UNION ALL SELECT * FROM f2) GROUP BY 1, 2
""")  # fmt: skip
def beam_walk(spark: SparkSession, folder: str) -> DataFrame:
    e = gr.both_ways(_edges(spark, folder).select("src", "dst", "weight")).withColumn("confidence", F.lit(0.5))
    return gr.beam_walk(e, _seeds(spark, folder)).select("seed", "node", F.round("score", 6).alias("score"))


@R.add("entity_walk", """
WITH l AS (SELECT DISTINCT entity_id, fact_id FROM entity_links), seeds AS (SELECT entity_id AS node FROM entities WHERE kind = 'agent'),
sec AS (SELECT DISTINCT s.node, b.entity_id FROM seeds s JOIN l a ON a.entity_id = s.node JOIN l b ON b.fact_id = a.fact_id AND b.entity_id <> s.node),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id) AS r FROM l) WHERE r <= 10)
SELECT s.node AS seed, f.fact_id, round(least(1.0, 0.1 * count(*)), 6)::DOUBLE AS boost FROM sec s JOIN few f ON f.entity_id = s.entity_id GROUP BY 1, 2
""")  # fmt: skip
def entity_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Facts two hops from the agent entities."""
    w = gr.entity_walk(links(spark, folder), _seeds(spark, folder))
    return w.select("seed", "fact_id", F.round("boost", 6).alias("boost"))


_ENDS = "(\\.rs|\\.ts|\\.py|\\.go|\\.js|\\.md|\\.toml|\\.yml|\\.yaml)$"
_KEY = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}./_:]', '', 'g'))"
MINED = f"""t AS (SELECT id, coalesce(title, '') || chr(10) || coalesce(content, '') AS x FROM o),
n AS (SELECT id, list_slice(list_filter(regexp_extract_all(x, '`([^`]*)`', 1), lambda t: trim(t) <> '' AND length(t) <= 64), 1, 12) AS ticks, list_slice(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: contains(t, '/') AND regexp_matches(t, '{_ENDS}')), 1, 12) AS paths FROM t),
u AS (SELECT id, unnest(list_concat(ticks, paths)) AS name, unnest(range(len(ticks) + len(paths))) AS pos, len(ticks) AS k FROM n),
mined AS (SELECT id, {_KEY.format("name")} AS norm_name, arg_min(name, pos) AS name, arg_min(CASE WHEN pos >= k OR contains(name, '/') OR regexp_matches(name, '{_ENDS}') THEN 'file' ELSE 'concept' END, pos) AS kind, arg_min(CASE WHEN pos < k THEN 'backtick' ELSE 'token' END, pos) AS source, min(pos) AS pos FROM u WHERE {_KEY.format("name")} <> '' GROUP BY 1, 2)"""


@R.add("mined_entities", "WITH o AS (SELECT DISTINCT id, title, content FROM observations), " + MINED + " SELECT id, norm_name, name, kind, source, pos FROM mined")
def mined_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that each observation's text names."""
    return gr.mine_entities(observations(spark, folder, wide=True), "id", "title", "content")


@R.add("incident_edges", _E + " SELECT e.entity_id AS node, count(ed.dst) AS degree, coalesce(sum(ed.weight), 0)::BIGINT AS weight FROM entities e LEFT JOIN ed ON ed.src = e.entity_id GROUP BY 1")
def incident_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = gr.both_ways(_edges(spark, folder).select("src", "dst", "weight"))
    d = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    n = table(spark, folder, "entities").select(F.col("entity_id").alias("node"))
    return n.join(d, "node", "left").na.fill(0, ["degree", "weight"])


@R.add("canonical_pairs", """
SELECT least(keep_id, drop_id) AS a, greatest(keep_id, drop_id) AS b, count(*) AS n, max(confidence) AS confidence, arg_max(kind, (confidence, proposal_id)) AS kind
FROM (SELECT DISTINCT * FROM dream_proposals) WHERE keep_id IS NOT NULL AND drop_id IS NOT NULL AND keep_id <> drop_id GROUP BY 1, 2
""")  # fmt: skip
def canonical_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals for the same two observations, either way round, as one row."""
    p = table(spark, folder, "dream_proposals").distinct().filter("keep_id <> drop_id")
    g = p.groupBy(F.least("keep_id", "drop_id").alias("a"), F.greatest("keep_id", "drop_id").alias("b"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max_by("kind", F.struct("confidence", "proposal_id")).alias("kind"))


@R.add("entity_boost", """
WITH l AS (SELECT DISTINCT entity_id, fact_id FROM entity_links), q AS (SELECT entity_id FROM entities WHERE kind = 'concept')
SELECT fact_id, round(least(1.5, 0.75 * count(*)), 6)::DOUBLE AS boost FROM l WHERE entity_id IN (SELECT entity_id FROM q) GROUP BY 1
""")  # fmt: skip
def entity_boost(spark: SparkSession, folder: str) -> DataFrame:
    l = links(spark, folder).join(_seeds(spark, folder, "concept").withColumnRenamed("node", "entity_id"), "entity_id", "left_semi")  # noqa: E741
    return l.groupBy("fact_id").agg(F.round(F.least(F.lit(1.5), 0.75 * F.count(F.lit(1))), 6).alias("boost"))
