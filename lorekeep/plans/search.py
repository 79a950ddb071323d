"""Retrieval queries: lexical, dense, fused, rescored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import scores as sc
from lorekeep.functions import text as tx
from lorekeep.functions.times import CUES, inferred_range
from lorekeep.operators import dense, fusion
from lorekeep.operators import lexical as lx
from lorekeep.operators.relational import ranked
from lorekeep.plans.registry import TOKENS, Registry, table
from lorekeep.sources.memory import facts, links, observations, queries

R = Registry()
WEIGHTS = {"title": 5.0, "content": 1.0, "topic_key": 2.0}
NOW = "2026-01-01 00:00:00"

_TOK = TOKENS


def _phrase_sql(cols: dict[str, float], source: str, key: str, phrases: str, tail: str) -> str:
    """BM25 by counting delimited phrases in delimited token strings."""
    toks = ", ".join(f"{_TOK.format(c)} AS t_{c}" for c in cols)
    strings = ", ".join(f"' ' || array_to_string(t_{c}, '  ') || ' ' AS s_{c}" for c in cols)
    size = " + ".join(f"len(t_{c})" for c in cols)
    # a space more between tokens, so that neighbouring matches do not share one
    hits = " + ".join(f"{w} * ((length(s_{c}) - length(replace(s_{c}, p.needle, ''))) / length(p.needle))" for c, w in cols.items())
    meets = " OR ".join(f"contains(s_{c}, p.needle)" for c in cols)
    return f"""
WITH src AS ({source}), tok AS (SELECT {key} AS doc, {toks} FROM src), corpus AS (SELECT doc, {strings}, ({size})::DOUBLE AS size FROM tok),
stats AS (SELECT count(*)::DOUBLE AS n, avg(size) AS avg_size FROM corpus),
words AS (SELECT entity_id AS query, {_TOK.format("name")} AS t FROM entities),
{phrases},
needles AS (SELECT DISTINCT query, phrase, ' ' || replace(phrase, ' ', '  ') || ' ' AS needle FROM phrase),
uniq AS (SELECT DISTINCT phrase, needle FROM needles),
found AS (SELECT p.phrase, c.doc, c.size, ({hits})::DOUBLE AS f FROM corpus c JOIN uniq p ON {meets}),
df AS (SELECT phrase, count(*)::DOUBLE AS n_hit FROM found GROUP BY 1),
part AS (SELECT n.query, n.phrase, f.doc, greatest(1e-6, ln((s.n - d.n_hit + 0.5) / (d.n_hit + 0.5))) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * f.size / s.avg_size)) AS score
  FROM found f JOIN needles n ON n.phrase = f.phrase JOIN df d ON d.phrase = f.phrase CROSS JOIN stats s)
{tail}"""


_WHOLE = "phrase AS (SELECT query, array_to_string(t, ' ') AS phrase FROM words WHERE len(t) > 0)"
_TOP = """, total AS (SELECT query, doc, sum(score) AS score FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM total)
SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
_LIVE = "SELECT * FROM (SELECT DISTINCT * FROM observations) WHERE deleted_at IS NULL"


def _live(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder, live_only=True, wide=True)


def _phrases(spark: SparkSession, folder: str, tiered: bool = False) -> DataFrame:
    return lx.phrase_table(queries(spark, folder), "query_id", "text", tiered)


def _top(scored: DataFrame) -> DataFrame:
    return lx.top(scored, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@R.add("phrase_bm25_topk", _phrase_sql({"content": 1.0}, _LIVE, "id", _WHOLE, _TOP))
def phrase_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The entity names as phrases in the notes' contents."""
    return _top(lx.search(_live(spark, folder), "id", {"content": 1.0}, _phrases(spark, folder)))


@R.add("weighted_bm25_topk", _phrase_sql(WEIGHTS, _LIVE, "id", _WHOLE, _TOP))
def weighted_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same over title, content and topic, weighted."""
    return _top(lx.search(_live(spark, folder), "id", WEIGHTS, _phrases(spark, folder)))


_WORDS = "phrase AS (SELECT query, unnest(list_distinct(t)) AS phrase FROM words)"


@R.add("and_bm25_global", _phrase_sql({"content": 1.0}, _LIVE, "id", _WORDS, """, total AS (SELECT query, doc, sum(score) AS score, count(*) AS met FROM part GROUP BY 1, 2),
need AS (SELECT query, count(*) AS n FROM phrase GROUP BY 1), kept AS (SELECT t.* FROM total t JOIN need n ON n.query = t.query AND n.n = t.met),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM kept) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""))  # fmt: skip
def and_bm25_global(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that hold every word of the query."""
    words = queries(spark, folder).select(F.col("query_id").alias("query"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("phrase"), F.lit(1).alias("words"))
    need = words.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    scored = lx.search(_live(spark, folder), "id", {"content": 1.0}, words, bag=True).join(F.broadcast(need), "query").filter("met = n")
    return _top(scored.select("query", "doc", "score"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TIERS = f"""terms AS (SELECT entity_id AS query, list_filter(list_transform(list_filter(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}'']+'), lambda x: strlen(x) >= 3), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS t FROM entities),
raw AS (SELECT query, array_to_string(t, ' ') AS p FROM terms WHERE len(t) >= 2
 UNION SELECT query, t[i] || ' ' || t[i + 1] FROM (SELECT query, t, unnest(range(1, len(t))) AS i FROM terms) UNION SELECT query, unnest(t) FROM terms),
phrase AS (SELECT DISTINCT query, array_to_string({TOKENS.format("p")}, ' ') AS phrase FROM raw WHERE len({TOKENS.format("p")}) > 0)"""
TIERED = {"title": 5.0, "content": 1.0, "type": 0.5, "scope": 0.5, "topic_key": 2.0}


@R.add("tiered_or_bm25", _phrase_sql(TIERED, _LIVE, "id", _TIERS, _TOP))
def tiered_or_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """All terms as a phrase, neighbouring terms or single terms, scores added."""
    return _top(lx.search(_live(spark, folder), "id", TIERED, _phrases(spark, folder, tiered=True)))


@R.add("fact_bm25_topk", _phrase_sql({"subject": 5.0, "predicate": 1.0, "object": 3.0, "temporal": 0.5}, "SELECT DISTINCT * FROM facts", "fact_id", _WHOLE, _TOP))
def fact_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    cols = {"subject": 5.0, "predicate": 1.0, "object": 3.0, "temporal": 0.5}
    return _top(lx.search(facts(spark, folder), "fact_id", cols, _phrases(spark, folder)))


@R.add("recognition_filter", f"""
WITH q AS (SELECT entity_id AS query, unnest(list_filter({TOKENS.format("name")}, lambda x: length(x) >= 2)) AS tok FROM entities),
f AS (SELECT id, lower(coalesce(title,'') || ' ' || coalesce(content,'')) AS blob FROM ({_LIVE}))
SELECT query, count(DISTINCT id) AS notes FROM q JOIN f ON contains(blob, tok) GROUP BY query
""")  # fmt: skip
def recognition_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose title and content contain any token of a query as a substring: each distinct token of the fixed entities is looked for once a note."""
    q = queries(spark, folder).select(F.col("query_id").alias("query"), F.explode(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda x: F.length(x) >= 2))).alias("token"))
    toks = [r["token"] for r in q.select("token").distinct().collect()]  # words of a fixed table
    o = _live(spark, folder).select("id", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))).alias("blob"))
    hit = o.select("id", F.explode(F.filter(F.array(*[F.lit(t) for t in toks]), lambda t: F.contains(F.col("blob"), t))).alias("token"))
    return hit.join(F.broadcast(q), "token").groupBy("query").agg(F.countDistinct("id").alias("notes"))


# dense -------------------------------------------------------------------------
_VEC = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT id AS query, vec FROM v WHERE id % 50 = 0)"


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return v, v.filter("id % 50 = 0").select(F.col("id").alias("query"), "vec")


def _knn_sql(dist: str, part: str = "query", cols: str = "") -> str:
    return f"""{_VEC}, d AS (SELECT q.query, v.id, v.label, round({dist}, 9) AS distance FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY distance, id) AS rank FROM d) SELECT query, id, {cols} rank, round(distance, 6) AS distance FROM r WHERE rank <= 10"""


@R.add("knn_cosine", _knn_sql("1 - list_cosine_similarity(q.vec, v.vec)"))
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    v, q = _vectors(spark, folder)
    return dense.block_knn(v, q, 10).select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@R.add("knn_l2", _knn_sql("list_distance(q.vec, v.vec)"))
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    v, q = _vectors(spark, folder)
    return dense.block_knn(v, q, 10, "l2").select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@R.add("knn_per_project", _knn_sql("1 - list_cosine_similarity(q.vec, v.vec)", "query, label", "CAST(label AS VARCHAR) AS label,").replace("rank <= 10", "rank <= 3"))
def knn_per_project(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest in each label."""
    v, q = _vectors(spark, folder)
    return dense.block_knn(v, q, 3, group="label").select("query", "id", "label", "rank", F.round("distance", 6).alias("distance"))


_QUANT = _VEC.replace("WITH v AS (", "WITH v0 AS (") .replace(", q AS (SELECT id AS query, vec FROM v WHERE id % 50 = 0)", "") + """,
s AS (SELECT id, label, vec, greatest(1e-9, list_max(list_transform(vec, lambda x: abs(x)))) AS scale FROM v0),
v AS (SELECT id, label, vec AS full_vec, list_transform(vec, lambda x: greatest(-128, least(127, round(x * 127 / scale)))) AS vec FROM s),
q AS (SELECT id AS query, list_transform(full_vec, lambda x: greatest(-128, least(127, round(x * 127 / 1.0)))) AS vec, full_vec FROM v WHERE id % 50 = 0)"""


def _quantized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows by their own scale, queries by scale 1."""
    v, q = _vectors(spark, folder)
    z = v.select("id", dense.quantize(F.col("vec"), dense.scale_of(F.col("vec"))).cast("array<double>").alias("vec"))
    return z, q.select("query", dense.quantize(F.col("vec"), F.lit(1.0)).cast("array<double>").alias("vec"))


@R.add("knn_int8", _QUANT + """, d AS (SELECT q.query, v.id, round(1 - list_cosine_similarity(q.vec, v.vec), 9) AS distance FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10""")  # fmt: skip
def knn_int8(spark: SparkSession, folder: str) -> DataFrame:
    z, q = _quantized(spark, folder)
    return dense.block_knn(z, q, 10).select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@R.add("quant_jaccard", _QUANT + """, d AS (SELECT q.query, v.id, round(1 - list_cosine_similarity(q.vec, v.vec), 9) AS di, round(1 - list_cosine_similarity(q.full_vec, v.full_vec), 9) AS df FROM q CROSS JOIN v),
r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY di, id) AS ri, row_number() OVER (PARTITION BY query ORDER BY df, id) AS rf FROM d),
j AS (SELECT query, count(*) FILTER (ri <= 10 AND rf <= 10) AS both_n, count(*) FILTER (ri <= 10 OR rf <= 10) AS any_n FROM r GROUP BY query)
SELECT query, round(both_n / any_n, 6) AS jaccard FROM j""")  # fmt: skip
def quant_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the ten nearest with full and with int8 vectors."""
    v, q = _vectors(spark, folder)
    z, zq = _quantized(spark, folder)
    both = dense.block_knn(v, q, 10).select("query", "id", F.lit(1).alias("a")).join(dense.block_knn(z, zq, 10).select("query", "id", F.lit(1).alias("b")), ["query", "id"], "full")
    return both.groupBy("query").agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1)), 6).alias("jaccard"))


@R.add("chunk_maxpool", _VEC + """, d AS (SELECT q.query, v.id // 4 AS parent, min(round(1 - list_cosine_similarity(q.vec, v.vec), 9)) AS distance FROM q CROSS JOIN v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, parent) AS rank FROM d) SELECT query, parent, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10""")  # fmt: skip
def chunk_maxpool(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk vectors (four a parent) pooled to their parent: 4k + 40 chunks always hold the k best parents."""
    v, q = _vectors(spark, folder)
    hits = dense.block_knn(v, q, 40)
    pooled = dense.max_pool(hits, v.select("id", F.expr("id div 4").alias("parent")))
    return ranked(pooled, ["query"], [F.col("distance"), F.col("parent")], 10).select("query", "parent", "rank", F.round("distance", 6).alias("distance"))


# fusion ------------------------------------------------------------------------
_LANES = _VEC + """, d AS (SELECT q.query, v.id, v.label, round(1 - list_cosine_similarity(q.vec, v.vec), 9) AS di, round(sqrt(list_sum(list_transform(list_zip(q.vec, v.vec), lambda x: abs(x[1] - x[2])))), 9) AS l1 FROM q CROSS JOIN v),
lanes AS (SELECT query, 1 AS lane, id, row_number() OVER (PARTITION BY query ORDER BY di, id) AS rank FROM d
 UNION ALL SELECT query, 2, id, row_number() OVER (PARTITION BY query, label ORDER BY di, id) AS rank FROM d)"""


def _lanes(spark: SparkSession, folder: str) -> DataFrame:
    """Lane 1: the 20 nearest; lane 2: the 3 nearest of each label, in that rank."""
    v, q = _vectors(spark, folder)
    a = dense.block_knn(v, q, 20).select("query", F.lit(1).alias("lane"), "id", "rank")
    return a.unionByName(dense.block_knn(v, q, 3, group="label").select("query", F.lit(2).alias("lane"), "id", "rank"))


@R.add("rrf_two_lane", _LANES + """, l AS (SELECT * FROM lanes WHERE rank <= CASE lane WHEN 1 THEN 20 ELSE 3 END),
g AS (SELECT query, id, sum(1.0 / (60 + rank)) AS score, count(*) AS lanes, min(lane * 100000 + rank) AS seen FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, seen, id) AS rank FROM g) SELECT query, id, round(score, 9) AS score, lanes, rank FROM r""")  # fmt: skip
def rrf_two_lane(spark: SparkSession, folder: str) -> DataFrame:
    f = fusion.reciprocal_rank(_lanes(spark, folder))
    return f.select("query", "id", F.round("score", 9).alias("score"), "lanes", "rank")


@R.add("adaptive_sigmoid", _phrase_sql({"content": 1.0}, _LIVE, "id", _WHOLE, """, total AS (SELECT query, doc, sum(score) AS score FROM part GROUP BY 1, 2), w AS (SELECT query, len(t) AS n FROM words),
p AS (SELECT t.query, t.doc, t.score, CASE WHEN n <= 3 THEN 5.0 WHEN n <= 7 THEN 8.0 WHEN n <= 15 THEN 10.0 ELSE 12.0 END AS m, CASE WHEN n <= 3 THEN 0.7 WHEN n <= 7 THEN 0.6 WHEN n <= 15 THEN 0.55 ELSE 0.5 END AS s FROM total t JOIN w ON w.query = t.query)
SELECT query, doc, round(1 / (1 + exp(-s * (score - m))), 6) AS weight FROM p"""))  # fmt: skip
def adaptive_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase scores brought to 0..1 by query length."""
    scored = lx.search(_live(spark, folder), "id", {"content": 1.0}, _phrases(spark, folder))
    n = queries(spark, folder).select(F.col("query_id").alias("query"), F.size(tx.tokens(F.col("text"))).alias("n"))
    return scored.join(F.broadcast(n), "query").select("query", "doc", F.round(sc.adaptive_sigmoid(F.col("score"), F.col("n")), 6).alias("weight"))


@R.add("salience_decay", """
WITH o AS (SELECT DISTINCT * FROM observations WHERE deleted_at IS NULL),
s AS (SELECT id, least(1.2, greatest(0.3, CASE type WHEN 'decision' THEN 1.0 WHEN 'policy' THEN 1.0 WHEN 'fix' THEN 0.85 WHEN 'pattern' THEN 0.85 WHEN 'preference' THEN 0.75 WHEN 'fact' THEN 0.7 ELSE 0.6 END
 * CASE verify_state WHEN 'verified' THEN 1.1 WHEN 'stale' THEN 0.7 WHEN 'invalidated' THEN 0.5 WHEN 'unprovable' THEN 0.5 ELSE 1.0 END)) AS salience,
 exp(-0.005 * greatest(0, (epoch(TIMESTAMP '2026-01-01') - epoch(created_at)) / 86400.0)) AS decay FROM o)
SELECT id, round(salience, 6) AS salience, round(decay, 6) AS decay, round(salience * decay, 6) AS weight FROM s
""")  # fmt: skip
def salience_decay(spark: SparkSession, folder: str) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit(NOW))
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), now) / 86_400_000_000.0
    s = observations(spark, folder, live_only=True).select("id", sc.salience(F.col("type"), F.col("verify_state")).alias("salience"), sc.decay(age).alias("decay"))
    return s.select("id", F.round("salience", 6).alias("salience"), F.round("decay", 6).alias("decay"), F.round(F.col("salience") * F.col("decay"), 6).alias("weight"))


@R.add("quality_modifiers", """
WITH f AS (SELECT DISTINCT * FROM facts),
c AS (SELECT *, count(DISTINCT lower(trim(object))) OVER w > 1 AS clash, row_number() OVER (PARTITION BY project, lower(trim(subject)), lower(trim(predicate)) ORDER BY salience DESC, fact_id) AS rn
 FROM f WINDOW w AS (PARTITION BY project, lower(trim(subject)), lower(trim(predicate))))
SELECT fact_id, CASE WHEN clash THEN 0.5 ELSE 1.0 END::DOUBLE AS factor, CASE WHEN clash AND rn = 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS bonus,
 round(greatest(salience, 0.3) * CASE WHEN clash THEN 0.5 ELSE 1.0 END + CASE WHEN clash AND rn = 1 THEN 0.25 ELSE 0.0 END, 6)::DOUBLE AS quality FROM c
""")  # fmt: skip
def quality_modifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that contradict each other are halved, the weightiest of them gets a bonus."""
    f = fusion.contradictions(facts(spark, folder), ["project"], "subject", "predicate", "object", "salience", "fact_id")
    return f.select("fact_id", "factor", "bonus", F.round(F.greatest("salience", F.lit(0.3)) * F.col("factor") + F.col("bonus"), 6).alias("quality"))


@R.add("ambiguity_gate", _knn_sql("1 - list_cosine_similarity(q.vec, v.vec)").replace("SELECT query, id,  rank, round(distance, 6) AS distance FROM r WHERE rank <= 10", ", g AS (SELECT query, max(CASE WHEN rank = 3 THEN distance END) - max(CASE WHEN rank = 2 THEN distance END) AS gap FROM r GROUP BY query) SELECT query, round(gap, 6) AS gap, gap < 0.15 AS ambiguous FROM g"))
def ambiguity_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Distance between the two nearest others of each query, and whether it is too small to trust."""
    v, q = _vectors(spark, folder)
    k = dense.block_knn(v, q, 3)
    g = k.groupBy("query").agg((F.max(F.when(F.col("rank") == 3, F.col("distance"))) - F.max(F.when(F.col("rank") == 2, F.col("distance")))).alias("gap"))
    return g.select("query", F.round("gap", 6).alias("gap"), (F.col("gap") < 0.15).alias("ambiguous"))


_RERANK = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2))"


@R.add("local_rerank", _phrase_sql({"content": 1.0}, _LIVE, "id", _WHOLE, f""", pair AS (SELECT DISTINCT query, doc FROM part), b AS (SELECT p.query, p.doc, {_RERANK.format("e.name")} AS q, {_RERANK.format("o.title")} AS ti,
 {_RERANK.format("o.content")} AS bo, greatest(strlen(coalesce(o.title, '')) + strlen(coalesce(o.content, '')), 1) AS bytes FROM pair p JOIN entities e ON e.entity_id = p.query JOIN src o ON o.id = p.doc)
SELECT query, doc, round(3.0 * len(list_intersect(q, ti)) / len(q) + 1.5 * len(list_intersect(q, bo)) / len(q) + 0.15 / (1 + ln(1 + bytes / 2000.0)), 6) AS score FROM b WHERE len(q) > 0"""))  # fmt: skip
def local_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase hits rescored by cover of title and body and by length."""
    o = _live(spark, folder)
    phrases = _phrases(spark, folder)
    pair = lx.phrase_hits(lx.matched(o, "id", {"content": 1.0}, phrases), phrases).select("query", "doc").distinct()
    q = queries(spark, folder).select(F.col("query_id").alias("query"), tx.rerank_terms(F.col("text")).alias("q")).filter(F.size("q") > 0)
    bytes_ = F.greatest(F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("content", F.lit(""))), F.lit(1))
    d = o.select(F.col("id").alias("doc"), tx.rerank_terms(F.col("title")).alias("ti"), tx.rerank_terms(F.col("content")).alias("bo"), bytes_.alias("bytes"))
    j = pair.join(F.broadcast(q), "query").join(d, "doc")
    cover = lambda c: F.size(F.array_intersect("q", c)) / F.size("q")
    return j.select("query", "doc", F.round(sc.rerank_features(cover("ti"), cover("bo"), F.col("bytes")), 6).alias("score"))


# Fixed questions that the entities' names are put into, so that every rule of the router is met.
QUESTIONS = ["%s", "how does %s relate to it", "what is the current state of %s", "`%s` and `b/c.rs`", "what changed in %s last week", "compare %s", "see a/b.py for %s"]
_ENDS = "(\\.rs|\\.ts|\\.py|\\.go|\\.js|\\.md|\\.toml|\\.yml|\\.yaml)$"
ASKED = "asked AS (SELECT e.entity_id AS query, t.i AS form, replace(t.q, '%s', e.name) AS text FROM entities e CROSS JOIN (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") t(i, q))"
NAMED = f"""list_slice(list_filter(n, lambda x, i: list_position(n, x) = i), 1, 3) FROM (SELECT *, list_filter(list_concat(list_filter(regexp_extract_all(text, '`([^`]*)`', 1), lambda t: trim(t) <> '' AND length(t) <= 64),
 list_filter(regexp_split_to_array(text, '\\s+'), lambda t: contains(t, '/') AND regexp_matches(t, '{_ENDS}'))), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}./_:]')) AS n FROM asked)"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query, form, text): each entity's name in each of the questions."""
    forms = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("form"), F.lit(q).alias("q")) for i, q in enumerate(QUESTIONS)]))
    q = queries(spark, folder).select(F.col("query_id").alias("query"), "text", forms.alias("f"))
    return q.select("query", "f.form", F.replace("f.q", F.lit("%s"), "text").alias("text"))


@R.add("query_names", f"WITH {ASKED}, x AS (SELECT query, form, {NAMED.replace(' FROM (', ' AS names FROM (', 1)}) SELECT query, form, array_to_string(names, '|') AS names FROM x")
def query_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names that a question mentions, three at most."""
    return asked(spark, folder).select("query", "form", F.array_join(tx.query_entities(F.col("text")), "|").alias("names"))


_HOPS = " OR ".join(f"contains(lower(text), '{h}')" for h in tx.MULTI_HOP)
_CUES = "|".join(CUES)


@R.add("query_tier", f"""
WITH {ASKED}, x AS (SELECT query, form, text, len(names) AS named FROM (SELECT query, form, text, {NAMED.replace(' FROM (', ' AS names FROM (', 1)}))
SELECT query, form, CASE WHEN trim(text) = '' THEN 'easy' WHEN regexp_matches(lower(text), '{_CUES}') OR regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR {_HOPS} OR named >= 2
  OR length(text) - length(replace(text, '`', '')) >= 2 OR contains(text, '::') THEN 'hard' WHEN len(regexp_split_to_array(trim(text), '\\s+')) <= 3 AND named <= 1 THEN 'easy' ELSE 'normal' END AS tier FROM x
""")  # fmt: skip
def query_tier(spark: SparkSession, folder: str) -> DataFrame:
    """How much work a question needs."""
    temporal = inferred_range(F.col("text"), F.to_timestamp_ntz(F.lit(NOW))).isNotNull()
    return asked(spark, folder).select("query", "form", tx.query_tier(F.col("text"), temporal).alias("tier"))
