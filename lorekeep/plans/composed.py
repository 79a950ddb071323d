"""Retrieval on the vectors of observations, and searches composed of lexical, dense, fact and entity lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import scores as sc
from lorekeep.functions import text as tx
from lorekeep.functions.times import inferred_range
from lorekeep.operators import dense, fusion
from lorekeep.operators import graph as gr
from lorekeep.operators import lexical as lx
from lorekeep.operators.relational import ranked
from lorekeep.plans.registry import TOKENS, Registry, table
from lorekeep.plans.search import _LIVE, _RERANK, NOW, TIERED, _phrase_sql
from lorekeep.scratch import Scratch
from lorekeep.sources.memory import facts, links, observations, once

R = Registry()
DIM, DEPTH = 384, 60
FACT_WEIGHTS = {"subject": 5.0, "predicate": 1.0, "object": 3.0, "temporal": 0.5}

# vectors -----------------------------------------------------------------------
_OV = """o AS (SELECT DISTINCT * FROM observations),
hx AS (SELECT cache_key, any_value(hex(payload)) AS h FROM embedding_cache WHERE octet_length(payload) = 1536 GROUP BY 1),
bits AS (SELECT cache_key, list_transform(range(0, 384), lambda i: ('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::UBIGINT::BIGINT) AS w FROM hx),
floats AS (SELECT cache_key, list_transform(w, lambda b: (CASE WHEN b >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (8388608 + b % 8388608) * pow(2.0::DOUBLE, (b // 8388608) % 256 - 150)) AS vec FROM bits
 WHERE len(list_filter(w, lambda b: (b // 8388608) % 256 = 255)) = 0 AND len(list_filter(w, lambda b: b % 2147483648 <> 0)) > 0),
ov AS (SELECT o.id, o.project, o.title, o.deleted_at IS NULL AS alive, f.vec FROM o JOIN floats f ON f.cache_key = sha256(o.title || ' ' || o.content)),
qv AS (SELECT id AS query, title, vec FROM ov WHERE id % 50 = 0 AND alive)"""


def observation_vectors(spark: SparkSession, folder: str, dim: int = DIM) -> DataFrame:
    """(id, alive, vec) of observations, deleted ones too, whose text has a usable vector of that dimension in the cache."""
    o = observations(spark, folder, wide=True).select("id", F.col("deleted_at").isNull().alias("alive"), F.sha2(F.concat("title", F.lit(" "), "content"), 256).alias("cache_key"))
    c = once(table(spark, folder, "embedding_cache").filter(F.octet_length("payload") == 4 * dim), "cache_key").select("cache_key", "payload")
    v = dense.float_vectors(c, "cache_key", "payload", dim)
    return Scratch(spark, "vectors").save(o.filter("cache_key IS NOT NULL").join(v, "cache_key").select("id", "alive", "vec"))


def _asks(v: DataFrame) -> DataFrame:
    """The query set of searches: every live row whose id is divisible by 50."""
    return v.filter("alive AND id % 50 = 0").select(F.col("id").alias("query"), "vec")


@R.add("observation_knn", f"""
WITH {_OV}, d AS (SELECT q.query, v.id, v.alive, round(list_distance(q.vec, v.vec), 9) AS distance FROM qv q CROSS JOIN ov v),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10 AND alive
""")  # fmt: skip
def observation_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest observations by their cached vectors; deleted ones are taken out of the ten."""
    v = observation_vectors(spark, folder)
    k = dense.block_knn(v, _asks(v), 10, "l2").join(v.filter("alive").select("id"), "id", "left_semi")
    return k.select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@R.add("observation_knn_int8", f"""
WITH {_OV}, m AS (SELECT observation_id AS id, any_value(hex(quantized_blob)) AS h, any_value(scale) AS scale FROM observation_embedding_meta WHERE quantized_blob IS NOT NULL AND octet_length(quantized_blob) = 384 AND scale IS NOT NULL GROUP BY 1),
z AS (SELECT m.id, list_transform(range(0, 384), lambda i: ((('0x' || substr(h, 2 * i + 1, 2))::INT + 128) % 256 - 128) * scale / 127) AS vec FROM m JOIN o ON o.id = m.id WHERE o.deleted_at IS NULL),
d AS (SELECT q.query, z.id, round(1 - list_cosine_similarity(q.vec, z.vec), 9) AS distance FROM qv q CROSS JOIN z),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
""")  # fmt: skip
def observation_knn_int8(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest live observations by their stored int8 vectors, brought back to floats."""
    m = once(table(spark, folder, "observation_embedding_meta").filter((F.octet_length("quantized_blob") == DIM) & F.col("scale").isNotNull()), "observation_id")
    m = m.select(F.col("observation_id").alias("id"), "quantized_blob", "scale").join(observations(spark, folder, live_only=True).select("id"), "id", "left_semi")
    k = dense.block_knn(dense.int8_vectors(m, "id", "quantized_blob", "scale"), _asks(observation_vectors(spark, folder)), 10)
    return k.select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@R.add("vector_modes", """
WITH m AS (SELECT DISTINCT observation_id, model, dim, quantized FROM observation_embedding_meta), o AS (SELECT DISTINCT id, project FROM observations)
SELECT project, count(*) AS vectors, bool_and(quantized = 1) AS all_quantized, count(DISTINCT model) AS models, count(DISTINCT model) <= 1 AS compatible, count(*) FILTER (dim NOT IN (384, 768)) AS refused FROM m JOIN o ON o.id = m.observation_id GROUP BY 1
""")  # fmt: skip
def vector_modes(spark: SparkSession, folder: str) -> DataFrame:
    """How each project's vectors can be searched: all as int8, by one model, of a known dimension."""
    m = table(spark, folder, "observation_embedding_meta").select(F.col("observation_id").alias("id"), "model", "dim", "quantized").distinct()
    g = m.join(observations(spark, folder).select("id", "project"), "id").groupBy("project")
    return g.agg(F.count(F.lit(1)).alias("vectors"), F.bool_and(F.col("quantized") == 1).alias("all_quantized"), F.countDistinct("model").alias("models"), (F.countDistinct("model") <= 1).alias("compatible"), F.count_if(~F.col("dim").isin(384, 768)).alias("refused"))


_EMB = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), q AS (SELECT id AS query, vec FROM v WHERE id % 50 = 0), d AS (SELECT q.query, v.id, round(1 - list_cosine_similarity(q.vec, v.vec), 9) AS distance FROM q CROSS JOIN v)"


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return v, v.filter("id % 50 = 0").select(F.col("id").alias("query"), "vec")


@R.add("doc_chunk_merge", f"""
WITH {_EMB}, r AS (SELECT *, id % 4 = 0 AS whole, row_number() OVER (PARTITION BY query, id % 4 = 0 ORDER BY distance, id) AS rank FROM d), m AS (SELECT query, id // 4 AS doc, min(distance) AS distance FROM r WHERE rank <= CASE WHEN whole THEN 10 ELSE 40 END GROUP BY 1, 2)
SELECT query, doc, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS rank FROM m
""")  # fmt: skip
def doc_chunk_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of whole documents (every fourth vector) and, four times as many, of their chunks: the smaller distance of a document holds."""
    v, q = _embeddings(spark, folder)
    both = dense.block_knn(v.filter("id % 4 = 0"), q, 10).unionByName(dense.block_knn(v.filter("id % 4 <> 0"), q, 40))
    m = both.groupBy("query", F.expr("id div 4").alias("doc")).agg(F.min("distance").alias("distance"))
    return ranked(m, ["query"], [F.col("distance"), F.col("doc")]).select("query", "doc", F.round("distance", 6).alias("distance"), "rank")


@R.add("shard_merge", f"WITH {_EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10")
def shard_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Each of four shards gives half as many again as asked for; the merge by distance and id is the answer of the whole."""
    v, q = _embeddings(spark, folder)
    k = dense.block_knn(v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(4))), q, 15, group="shard")
    return ranked(k.select("query", "id", "distance"), ["query"], [F.col("distance"), F.col("id")], 10).select("query", "id", "rank", F.round("distance", 6).alias("distance"))


# hybrid ------------------------------------------------------------------------
def _tiered_terms(queries: str, text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"""terms AS (SELECT query, list_filter(list_transform(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}'']+'), lambda x: strlen(x) >= 3), lambda x: lower(x)), lambda x: x NOT IN ({stop})) AS t FROM {queries}),
raw AS (SELECT query, array_to_string(t, ' ') AS p FROM terms WHERE len(t) >= 2 UNION SELECT query, t[i] || ' ' || t[i + 1] FROM (SELECT query, t, unnest(range(1, len(t))) AS i FROM terms) UNION SELECT query, unnest(t) FROM terms),
phrase AS (SELECT DISTINCT query, array_to_string({TOKENS.format("p")}, ' ') AS phrase FROM raw WHERE len({TOKENS.format("p")}) > 0)"""


_SUM = f""", total AS (SELECT query, doc, sum(score) AS score FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM total) SELECT query, doc, score, rank FROM r WHERE rank <= {DEPTH}"""
_LANES = f"""WITH {_OV},
lex AS ({_phrase_sql(TIERED, _LIVE, "id", _tiered_terms("qv", "title"), _SUM)}),
fct AS ({_phrase_sql(FACT_WEIGHTS, "SELECT DISTINCT * FROM facts", "fact_id", _tiered_terms("qv", "title"), _SUM)}),
par AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY first) AS rank FROM (SELECT c.query, f.evidence_obs_id AS id, min(c.rank) AS first FROM fct c JOIN (SELECT DISTINCT fact_id, evidence_obs_id FROM facts) f ON f.fact_id = c.doc WHERE f.evidence_obs_id IN (SELECT id FROM o WHERE deleted_at IS NULL) GROUP BY 1, 2)),
dns AS (SELECT * FROM (SELECT q.query, v.id, round(list_distance(q.vec, v.vec), 9) AS distance, row_number() OVER (PARTITION BY q.query ORDER BY round(list_distance(q.vec, v.vec), 9), v.id) AS rank FROM qv q CROSS JOIN ov v WHERE v.alive) WHERE rank <= {DEPTH})"""


def hybrid_lanes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries (query, title) and their lanes: lexical (query, doc, score, rank), dense (query, id, distance, rank), fact parents (query, id, rank)."""
    s = Scratch(spark, "lanes")
    v = observation_vectors(spark, folder).filter("alive")
    o = observations(spark, folder, live_only=True, wide=True)
    q = s.save(o.filter("id % 50 = 0").select(F.col("id").alias("query"), "title").join(v.select(F.col("id").alias("query")), "query"))
    phrases = s.save(lx.phrase_table(q, "query", "title", tiered=True))
    lex = s.save(lx.top(lx.search(o, "id", TIERED, phrases), DEPTH))
    f = facts(spark, folder)
    hits = lx.top(lx.search(f, "fact_id", FACT_WEIGHTS, phrases), DEPTH)
    alive = observations(spark, folder, live_only=True).select("id")
    par = hits.join(f.select(F.col("fact_id").alias("doc"), F.col("evidence_obs_id").alias("id")), "doc").join(alive, "id", "left_semi").groupBy("query", "id").agg(F.min("rank").alias("first"))
    par = s.save(ranked(par, ["query"], [F.col("first")]).select("query", "id", "rank"))
    dns = s.save(dense.block_knn(v, _asks(v), DEPTH, "l2"))
    return q, lex, dns, par


_BOOST = "greatest(0.6 - 0.02 * (rank - 1), 0.2)"


@R.add("hybrid_search", _LANES + f""",
n AS (SELECT query, len(regexp_split_to_array(trim(title), '\\s+')) AS n, title FROM qv),
a AS (SELECT l.query, l.doc AS id, 1 / (1 + exp(-(CASE WHEN n <= 3 THEN 0.7 WHEN n <= 7 THEN 0.6 WHEN n <= 15 THEN 0.55 ELSE 0.5 END) * (l.score - CASE WHEN n <= 3 THEN 5.0 WHEN n <= 7 THEN 8.0 WHEN n <= 15 THEN 10.0 ELSE 12.0 END))) AS s FROM lex l JOIN n ON n.query = l.query),
b AS (SELECT query, id, CASE WHEN max(distance) OVER w > min(distance) OVER w THEN 1 - (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) ELSE 1.0 END AS s FROM dns WINDOW w AS (PARTITION BY query)),
c AS (SELECT query, id, {_BOOST} AS s FROM par),
u AS (SELECT query, id, sum(s) AS base FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2),
g AS (SELECT u.query, u.id, o.created_at, base * least(1.2, greatest(0.3, CASE type WHEN 'decision' THEN 1.0 WHEN 'policy' THEN 1.0 WHEN 'fix' THEN 0.85 WHEN 'pattern' THEN 0.85 WHEN 'preference' THEN 0.75 WHEN 'fact' THEN 0.7 ELSE 0.6 END
 * CASE verify_state WHEN 'verified' THEN 1.1 WHEN 'stale' THEN 0.7 WHEN 'invalidated' THEN 0.5 WHEN 'unprovable' THEN 0.5 ELSE 1.0 END)) * exp(-0.005 * greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0)) AS score FROM u JOIN o ON o.id = u.id WHERE o.deleted_at IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM g QUALIFY rank <= 10),
t AS (SELECT query, CASE WHEN regexp_matches(lower(title), 'yesterday|today|last week|this week|last month|this month|last year|ago|in 20|before |after |on 20') THEN TIMESTAMP '{NOW}' - INTERVAL 90 DAY END AS lo FROM n),
k AS (SELECT r.*, lo IS NULL OR created_at BETWEEN lo AND TIMESTAMP '{NOW}' AS inside, count(*) FILTER (lo IS NULL OR created_at BETWEEN lo AND TIMESTAMP '{NOW}') OVER (PARTITION BY r.query) AS n_in FROM r JOIN t ON t.query = r.query)
SELECT query, id, rank, round(score, 6) AS score FROM k WHERE inside OR n_in = 0
""")  # fmt: skip
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Observations found by words, vectors and facts: lanes added, times salience and decay, the ten best, kept in the range of time that the query names if any is in it."""
    q, lex, dns, par = hybrid_lanes(spark, folder)
    words = F.size(F.split(F.trim("title"), r"\s+"))
    a = lex.join(F.broadcast(q.select("query", words.alias("n"))), "query").select("query", F.col("doc").alias("id"), sc.adaptive_sigmoid(F.col("score"), F.col("n")).alias("lexical"))
    c = par.select("query", "id", F.greatest(0.6 - 0.02 * (F.col("rank") - 1), F.lit(0.2)).alias("boost"))
    m = fusion.score_map(a, dns, c)
    now = F.to_timestamp_ntz(F.lit(NOW))
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), now) / 86_400_000_000.0
    o = observations(spark, folder, live_only=True).select("id", "created_at", (sc.salience(F.col("type"), F.col("verify_state")) * sc.decay(age)).alias("quality"))
    g = m.join(o, "id").withColumn("score", (F.col("lexical") + F.col("dense") + F.col("boost")) * F.col("quality"))
    r = ranked(g, ["query"], [F.desc(F.round("score", 9)), F.col("id")], 10)
    t = r.join(F.broadcast(q.select("query", inferred_range(F.col("title"), now).alias("range"))), "query")
    t = t.withColumn("inside", F.col("range").isNull() | F.col("created_at").between(F.col("range.start"), F.col("range.end")))
    t = t.withColumn("n_in", F.count_if("inside").over(Window.partitionBy("query")))  # ten rows a query
    return t.filter("inside OR n_in = 0").select("query", "id", "rank", F.round("score", 6).alias("score"))


@R.add("rrf_three_lane", _LANES + """,
l AS (SELECT query, 1 AS lane, doc AS id, rank FROM lex UNION ALL SELECT query, 2, id, rank FROM dns UNION ALL SELECT query, 3, id, rank FROM par),
g AS (SELECT query, id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lanes, min(lane * 100000 + rank) AS seen FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, seen, id) AS rank FROM g) SELECT query, id, lanes, rank, round(score, 9) AS score FROM r WHERE rank <= 20
""")  # fmt: skip
def rrf_three_lane(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical, dense and fact-parent lanes fused by reciprocal ranks; an empty lane adds nothing."""
    _, lex, dns, par = hybrid_lanes(spark, folder)
    lanes = lex.select("query", F.lit(1).alias("lane"), F.col("doc").alias("id"), "rank").unionByName(dns.select("query", F.lit(2).alias("lane"), "id", "rank")).unionByName(par.select("query", F.lit(3).alias("lane"), "id", "rank"))
    return fusion.reciprocal_rank(lanes).filter("rank <= 20").select("query", "id", "lanes", "rank", F.round("score", 9).alias("score"))


@R.add("dense_rerank", f"""
WITH {_OV}, d AS (SELECT q.query, q.title AS asked, q.vec AS qvec, v.id, v.vec, row_number() OVER (PARTITION BY q.query ORDER BY round(list_distance(q.vec, v.vec), 9), v.id) AS place FROM qv q CROSS JOIN ov v WHERE v.alive QUALIFY place <= 20),
x AS (SELECT d.query, d.id, {_RERANK.format("d.asked")} AS q, {_RERANK.format("o.title")} AS ti, {_RERANK.format("o.content")} AS bo, greatest(strlen(coalesce(o.title, '')) + strlen(coalesce(o.content, '')), 1) AS bytes, list_cosine_similarity(qvec, vec) AS cosine FROM d JOIN o ON o.id = d.id),
s AS (SELECT query, id, 3.0 * len(list_intersect(q, ti)) / len(q) + 1.5 * len(list_intersect(q, bo)) / len(q) + 0.15 / (1 + ln(1 + bytes / 2000.0)) + 2 * greatest(cosine, 0) AS score FROM x WHERE len(q) > 0),
r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT query, id, rank, round(score, 5) AS score FROM r WHERE rank <= 10
""")  # fmt: skip
def dense_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest observations rescored by cover of title and text, length and similarity of the vectors."""
    v = observation_vectors(spark, folder).filter("alive")
    k = dense.block_knn(v, _asks(v), 20, "l2").select("query", "id")
    o = observations(spark, folder, live_only=True, wide=True)
    d = o.select("id", "title", tx.rerank_terms(F.col("title")).alias("ti"), tx.rerank_terms(F.col("content")).alias("bo"), F.greatest(F.octet_length("title") + F.octet_length("content"), F.lit(1)).alias("bytes"))
    q = _asks(v).join(o.select(F.col("id").alias("query"), tx.rerank_terms(F.col("title")).alias("q")), "query").withColumnRenamed("vec", "qvec").filter("size(q) > 0")
    j = k.join(F.broadcast(q), "query").join(v.select("id", "vec"), "id").join(d, "id")  # the query set is a fiftieth of the vectors' rows, 20 hits each
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("qvec", "vec") / F.sqrt(dot("qvec", "qvec") * dot("vec", "vec"))
    cover = lambda c: F.size(F.array_intersect("q", c)) / F.size("q")
    s = j.select("query", "id", (sc.rerank_features(cover("ti"), cover("bo"), F.col("bytes")) + 2 * F.greatest(cosine, F.lit(0.0))).alias("score"))
    return ranked(s, ["query"], [F.desc(F.round("score", 6)), F.col("id")], 10).select("query", "id", "rank", F.round("score", 5).alias("score"))


# facts -------------------------------------------------------------------------
_WHOLE_AGENT = f"phrase AS (SELECT entity_id AS query, array_to_string({TOKENS.format('name')}, ' ') AS phrase FROM entities WHERE kind IN ('agent', 'concept') AND len({TOKENS.format('name')}) > 0)"
_DAY = "CASE WHEN regexp_full_match(temporal, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN temporal::DATE WHEN regexp_full_match(temporal, '[0-9]{4}-[0-9]{2}') THEN (temporal || '-01')::DATE WHEN regexp_full_match(temporal, '[0-9]{4}') THEN (temporal || '-01-01')::DATE END"


@R.add("fact_hybrid", f"""
WITH hits AS ({_phrase_sql(FACT_WEIGHTS, "SELECT DISTINCT * FROM facts", "fact_id", _WHOLE_AGENT, _SUM)}),
f AS (SELECT DISTINCT * FROM facts), l AS (SELECT DISTINCT entity_id, fact_id FROM entity_links), seeds AS (SELECT entity_id AS node, name FROM entities WHERE kind IN ('agent', 'concept')),
n AS (SELECT node, len({TOKENS.format("name")}) AS n FROM seeds),
a AS (SELECT h.query, h.doc AS fact_id, 1 / (1 + exp(-(CASE WHEN n <= 3 THEN 0.7 ELSE 0.6 END) * (h.score - CASE WHEN n <= 3 THEN 5.0 ELSE 8.0 END))) AS s FROM hits h JOIN n ON n.node = h.query),
b AS (SELECT node AS query, fact_id, 0.75 AS s FROM seeds JOIN l ON l.entity_id = node),
sec AS (SELECT DISTINCT s.node, b.entity_id FROM seeds s JOIN l a ON a.entity_id = s.node JOIN l b ON b.fact_id = a.fact_id AND b.entity_id <> s.node),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id) AS r FROM l) WHERE r <= 10),
c AS (SELECT s.node AS query, w.fact_id, least(1.0, 0.1 * count(*)) AS s FROM sec s JOIN few w ON w.entity_id = s.entity_id GROUP BY 1, 2),
u AS (SELECT query, fact_id, sum(s) AS base FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2),
m AS (SELECT u.query, u.fact_id, u.base, f.evidence_obs_id, f.salience, lower(trim(subject)) AS s, lower(trim(predicate)) AS p, lower(trim(object)) AS o, {_DAY} AS day FROM u JOIN f ON f.fact_id = u.fact_id),
x AS (SELECT *, min(o) OVER w <> max(o) OVER w AS clash, row_number() OVER (PARTITION BY query, s, p ORDER BY salience DESC, fact_id) AS rn FROM m WINDOW w AS (PARTITION BY query, s, p)),
y AS (SELECT query, fact_id, evidence_obs_id, base * greatest(salience, 0.3) * CASE WHEN day IS NULL THEN 1.0 ELSE exp(-0.005 * greatest(0, DATE '2026-01-01' - day)) END * CASE WHEN clash THEN 0.5 ELSE 1.0 END + CASE WHEN clash AND rn = 1 THEN 0.25 ELSE 0.0 END AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, fact_id) AS rank FROM y QUALIFY rank <= 10),
ob AS (SELECT DISTINCT id, session_id FROM observations WHERE deleted_at IS NULL)
SELECT r.query, r.fact_id, r.rank, round(r.score, 6) AS score, count(e.id) AS evidence FROM r LEFT JOIN ob k ON k.id = r.evidence_obs_id LEFT JOIN ob e ON e.id BETWEEN k.id - 2 AND k.id + 2 AND (e.session_id = k.session_id OR e.id = k.id) GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def fact_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best facts for each agent and concept: words, links and two-step walks added, times salience, age and contradiction among what was found, with the observations around their evidence."""
    f = facts(spark, folder)
    seeds = table(spark, folder, "entities").filter(F.col("kind").isin("agent", "concept")).select(F.col("entity_id").alias("node"), "name")
    n = seeds.select(F.col("node").alias("query"), F.size(tx.tokens(F.col("name"))).alias("n"))
    hits = lx.top(lx.search(f, "fact_id", FACT_WEIGHTS, lx.phrase_table(seeds, "node", "name")), DEPTH)
    a = hits.join(F.broadcast(n), "query").select("query", F.col("doc").alias("fact_id"), sc.adaptive_sigmoid(F.col("score"), F.col("n")).alias("s"))
    l = links(spark, folder)  # noqa: E741
    b = l.join(seeds.select(F.col("node").alias("entity_id")), "entity_id").select(F.col("entity_id").alias("query"), "fact_id", F.lit(0.75).alias("s"))
    c = gr.entity_walk(l, seeds.select("node")).select(F.col("seed").alias("query"), "fact_id", F.col("boost").alias("s"))
    u = a.unionByName(b).unionByName(c).groupBy("query", "fact_id").agg(F.sum("s").alias("base"))
    t = F.col("temporal")
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).try_cast("date")
    m = u.join(f.select("fact_id", "evidence_obs_id", "salience", "subject", "predicate", "object", day.alias("day")), "fact_id")
    m = fusion.contradictions(m, ["query"], "subject", "predicate", "object", "salience", "fact_id")
    age = F.datediff(F.lit("2026-01-01").cast("date"), "day").cast("double")
    m = m.withColumn("score", F.col("base") * F.greatest("salience", F.lit(0.3)) * F.coalesce(sc.decay(age), F.lit(1.0)) * F.col("factor") + F.col("bonus"))
    r = ranked(m, ["query"], [F.desc(F.round("score", 9)), F.col("fact_id")], 10).select("query", "fact_id", "evidence_obs_id", "rank", "score")
    o = observations(spark, folder, live_only=True).select("id", "session_id")
    k = r.join(o.select(F.col("id").alias("evidence_obs_id"), F.col("session_id").alias("s")), "evidence_obs_id")
    near = k.select("query", "fact_id", "evidence_obs_id", "s", F.explode(F.sequence(F.col("evidence_obs_id") - 2, F.col("evidence_obs_id") + 2)).alias("id")).join(o, "id")
    near = near.filter((F.col("s") == F.col("session_id")) | (F.col("id") == F.col("evidence_obs_id"))).groupBy("query", "fact_id").agg(F.count(F.lit(1)).alias("evidence"))
    return r.join(near, ["query", "fact_id"], "left").select("query", "fact_id", "rank", F.round("score", 6).alias("score"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


_NAMES = f"phrase AS (SELECT entity_id AS query, array_to_string({TOKENS.format('name')}, ' ') AS phrase FROM entities WHERE len({TOKENS.format('name')}) > 0)"
_TEN = """, total AS (SELECT query, doc, sum(score) AS score FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM total) SELECT query, doc, rank FROM r WHERE rank <= 10"""


@R.add("rrf_by_text", f"""
WITH fc AS ({_phrase_sql(FACT_WEIGHTS, "SELECT DISTINCT * FROM facts", "fact_id", _NAMES, _TEN)}), ob AS ({_phrase_sql({"title": 5.0, "content": 1.0}, _LIVE, "id", _NAMES, _TEN)}),
l AS (SELECT fc.query, f.subject || ' ' || f.predicate || ' ' || f.object AS hit, fc.rank FROM fc JOIN (SELECT DISTINCT * FROM facts) f ON f.fact_id = fc.doc UNION ALL SELECT ob.query, o.title, ob.rank FROM ob JOIN ({_LIVE}) o ON o.id = ob.doc),
g AS (SELECT query, hit, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l WHERE hit IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, hit) AS rank FROM g) SELECT query, hit, rank, round(score, 9) AS score FROM r WHERE rank <= 10
""")  # fmt: skip
def rrf_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """Facts and observations fused by their text: equal texts are one hit, ties go by text."""
    q = table(spark, folder, "entities").select(F.col("entity_id").alias("q"), "name")
    phrases, f, o = lx.phrase_table(q, "q", "name"), facts(spark, folder), observations(spark, folder, live_only=True, wide=True)
    a = lx.top(lx.search(f, "fact_id", FACT_WEIGHTS, phrases), 10).join(f.select(F.col("fact_id").alias("doc"), F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object").alias("hit")), "doc")
    b = lx.top(lx.search(o, "id", {"title": 5.0, "content": 1.0}, phrases), 10).join(o.select(F.col("id").alias("doc"), F.col("title").alias("hit")), "doc")
    g = a.select("query", "hit", "rank").unionByName(b.select("query", "hit", "rank")).filter("hit IS NOT NULL").groupBy("query", "hit").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("score"))
    return ranked(g, ["query"], [F.desc(F.round("score", 12)), F.col("hit")], 10).select("query", "hit", "rank", F.round("score", 9).alias("score"))
