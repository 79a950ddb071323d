"""Smaller queries of the reads, writes, graph, context and evaluation families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.times import inferred_range
from lorekeep.operators import graph as gr
from lorekeep.operators import lexical as lx
from lorekeep.operators import memory as mem
from lorekeep.operators.hierarchy import hierarchy
from lorekeep.operators.relational import keyset_page, ranked
from lorekeep.plans.search import _WHOLE, _phrase_sql
from lorekeep.plans.registry import TOKENS, Registry, table
from lorekeep.sources.memory import facts, links, mentions, observations, queries

R = Registry()
O = "WITH o AS (SELECT DISTINCT * FROM observations) "  # noqa: E741
F_ = "WITH f AS (SELECT DISTINCT * FROM facts) "


def _n() -> Column:
    return F.count(F.lit(1))


@R.add("point_lookup", O + "SELECT id, sync_id, title FROM o WHERE deleted_at IS NULL AND id = (SELECT max(id) FROM o WHERE deleted_at IS NULL)")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One live row by its id: here the largest."""
    o = observations(spark, folder, live_only=True)
    top = o.agg(F.max("id")).first()[0]
    return o.filter(F.col("id") == F.lit(top)).select("id", "sync_id", "title")


@R.add("dirty_rows", O + "SELECT id, updated_at FROM o WHERE updated_at > created_at + INTERVAL 1 DAY")
def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows changed after their export, taken as a day after creation."""
    return observations(spark, folder).filter(F.col("updated_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY")).select("id", "updated_at")


@R.add("project_listing", O + """
, a AS (SELECT project, count(*) AS observations FROM o GROUP BY 1), b AS (SELECT project, count(*) AS facts FROM (SELECT DISTINCT * FROM facts) GROUP BY 1), c AS (SELECT project, count(*) AS documents FROM documents GROUP BY 1),
p AS (SELECT project FROM a UNION SELECT project FROM b UNION SELECT project FROM c)
SELECT p.project, coalesce(observations, 0) AS observations, coalesce(facts, 0) AS facts, coalesce(documents, 0) AS documents FROM p LEFT JOIN a ON a.project = p.project LEFT JOIN b ON b.project = p.project LEFT JOIN c ON c.project = p.project
""")  # fmt: skip
def project_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of three tables per project, in one aggregation of their tagged union."""
    parts = [observations(spark, folder).select("project", F.lit("o").alias("t")), facts(spark, folder).select("project", F.lit("f").alias("t")), table(spark, folder, "documents").select("project", F.lit("d").alias("t"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("project").agg(F.count_if(F.col("t") == "o").alias("observations"), F.count_if(F.col("t") == "f").alias("facts"), F.count_if(F.col("t") == "d").alias("documents"))


@R.add("job_page", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def job_page(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(20)


@R.add("save_validation", O + "SELECT CASE WHEN content IS NULL OR trim(content) = '' THEN 'blank' WHEN length(content) > 50000 THEN 'long' WHEN scope IS NULL OR scope NOT IN ('project','personal','team') THEN 'scope' ELSE 'ok' END AS reason, count(*) AS n FROM o GROUP BY 1")
def save_validation(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder)
    bad_scope = F.col("scope").isNull() | ~F.col("scope").isin("project", "personal", "team")
    reason = F.when(F.col("content").isNull() | (F.trim("content") == ""), "blank").when(F.length("content") > mem.MOST_CHARS, "long").when(bad_scope, "scope").otherwise("ok")
    return o.select(reason.alias("reason")).groupBy("reason").agg(_n().alias("n"))


_SAVE = """
WITH RECURSIVE o AS (SELECT DISTINCT id, sync_id, topic_key, scope, normalized_hash AS h, created_at AS t, content FROM observations WHERE deleted_at IS NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY sync_id ORDER BY t, id) AS ns FROM o WHERE content IS NOT NULL AND trim(content) <> '' AND length(content) <= 50000 AND scope IN ('project','personal','team')),
w AS (SELECT *, CASE WHEN topic_key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY topic_key, scope ORDER BY t, id) END AS nt FROM g WHERE ns = 1 OR sync_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY t, id) AS n FROM w WHERE nt = 1 AND h IS NOT NULL),
f AS (SELECT h, t, id, n, t AS t0, id AS first_id FROM r WHERE n = 1
 UNION ALL SELECT r.h, r.t, r.id, r.n, CASE WHEN r.t <= f.t0 + INTERVAL 30 DAY THEN f.t0 ELSE r.t END, CASE WHEN r.t <= f.t0 + INTERVAL 30 DAY THEN f.first_id ELSE r.id END FROM f JOIN r ON r.h = f.h AND r.n = f.n + 1)
SELECT o.id, CASE WHEN g.id IS NULL THEN 'rejected' WHEN w.id IS NULL THEN 'repeated' WHEN w.nt > 1 THEN 'topic_update' WHEN f.id <> f.first_id THEN 'duplicate' ELSE 'inserted' END AS outcome
FROM o LEFT JOIN g ON g.id = o.id LEFT JOIN w ON w.id = o.id LEFT JOIN f ON f.id = o.id
"""


@R.add("save_outcomes", _SAVE)
def save_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The save pipeline over all live rows in time order: deleted ones match nothing."""
    return mem.save_outcomes(observations(spark, folder, live_only=True))


@R.add("facts_of_observations", F_ + "SELECT evidence_obs_id AS id, count(*) AS facts, round(max(salience), 6) AS top_salience FROM f WHERE evidence_obs_id IS NOT NULL GROUP BY 1")
def facts_of_observations(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).filter("evidence_obs_id IS NOT NULL")
    return f.groupBy(F.col("evidence_obs_id").alias("id")).agg(_n().alias("facts"), F.round(F.max("salience"), 6).alias("top_salience"))


_CE = "WITH m AS (SELECT DISTINCT l.entity_id AS e, f.evidence_obs_id AS o FROM entity_links l JOIN facts f ON f.fact_id = l.fact_id WHERE f.evidence_obs_id IS NOT NULL), ce AS (SELECT a.e AS src, b.e AS dst, a.o FROM m a JOIN m b ON a.o = b.o AND a.e < b.e) "


@R.add("edge_upsert", _CE + "SELECT src, dst, count(*) AS weight, min(o) AS first_obs, max(o) AS last_obs FROM ce GROUP BY 1, 2")
def edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of even and of odd observations accumulated: weights added, first and last kept."""
    m = mentions(spark, folder)
    out = None
    for side in (0, 1):  # the two halves together are all mentions
        e = m.filter(F.pmod("observation_id", F.lit(2)) == side)
        pair = e.select(F.col("entity_id").alias("src"), "observation_id").join(e.select(F.col("entity_id").alias("dst"), "observation_id"), "observation_id").filter("src < dst")
        g = pair.groupBy("src", "dst").agg(_n().alias("weight"), F.min("observation_id").alias("first_obs"), F.max("observation_id").alias("last_obs"))
        out = g if out is None else out.unionByName(g)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("first_obs").alias("first_obs"), F.max("last_obs").alias("last_obs"))


@R.add("fact_packs", F_ + "SELECT lower(subject) AS subject, lower(predicate) AS predicate, lower(object) AS object, count(DISTINCT fact_id) AS n, count(DISTINCT evidence_obs_id) AS sources, min(fact_id) AS first_fact FROM f GROUP BY 1, 2, 3")
def fact_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that say the same, with the number of their sources."""
    f = facts(spark, folder)
    return f.groupBy(*[F.lower(c).alias(c) for c in ("subject", "predicate", "object")]).agg(_n().alias("n"), F.countDistinct("evidence_obs_id").alias("sources"), F.min("fact_id").alias("first_fact"))


@R.add("project_round_robin", O + """
, r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY id) AS turn FROM o WHERE deleted_at IS NULL AND type = 'decision') SELECT project, id, turn FROM r ORDER BY turn, project LIMIT 100
""")  # fmt: skip
def project_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 100 decisions, one project after the other: sampling is the operator."""
    o = observations(spark, folder, live_only=True).filter("type = 'decision'").select("project", "id")
    return ranked(o, ["project"], [F.col("id")], 100, "turn").orderBy("turn", "project").limit(100)


@R.add("recent_prompts", "SELECT doc_id, created_at FROM documents WHERE lower(trim(replace(source, '-', '_'))) = 'prompt_log' AND text IS NOT NULL ORDER BY created_at DESC, doc_id DESC LIMIT 20")
def recent_prompts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter((F.lower(F.trim(F.regexp_replace("source", "-", "_"))) == "prompt_log") & F.col("text").isNotNull())
    return keyset_page(d.select("doc_id", "created_at"), F.col("created_at"), F.col("doc_id"), None, 20)


@R.add("prompt_search", "SELECT doc_id FROM documents WHERE lower(trim(replace(source, '-', '_'))) = 'prompt_log' AND list_contains(" + TOKENS.format("text") + ", 'session') ORDER BY doc_id DESC")
def prompt_search(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with a word, newest id first."""
    d = table(spark, folder, "documents").filter(F.lower(F.trim(F.regexp_replace("source", "-", "_"))) == "prompt_log")
    return d.filter(F.array_contains(tx.tokens(F.col("text")), "session")).select("doc_id").orderBy(F.desc("doc_id"))


@R.add("lineage_closure", """
WITH RECURSIVE o AS (SELECT DISTINCT id, superseded_by_id AS p FROM observations), e AS (SELECT a.id AS x, a.p AS y FROM o a JOIN o b ON b.id = a.p UNION SELECT a.p, a.id FROM o a JOIN o b ON b.id = a.p),
v AS (SELECT DISTINCT x AS id FROM e), reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, e.y FROM reach r JOIN e ON e.x = r.other)
SELECT id, count(*) AS members FROM reach GROUP BY 1
""")  # fmt: skip
def lineage_closure(spark: SparkSession, folder: str) -> DataFrame:
    """How many observations share the lineage of each one, in both directions: those of the same root or circle."""
    t = hierarchy(table(spark, folder, "observations"), "id", "superseded_by_id")
    n = t.groupBy("root_id").agg(_n().alias("members"))
    linked = t.join(n, "root_id").filter("members > 1 OR is_cycle")
    return linked.select(F.col("node_id").alias("id"), "members")


@R.add("fact_membership", f"""
WITH q AS (SELECT entity_id AS query, list_distinct({TOKENS.format("name")}) AS t FROM entities), f AS (SELECT DISTINCT fact_id, list_distinct({TOKENS.format("coalesce(subject,'') || ' ' || coalesce(predicate,'') || ' ' || coalesce(object,'')")}) AS w FROM facts)
SELECT query, fact_id FROM q JOIN f ON len(t) > 0 AND list_has_all(w, t)
""")  # fmt: skip
def fact_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that hold every word of an entity's name: an equality join on words, counted."""
    q = queries(spark, folder).select(F.col("query_id").alias("query"), F.array_distinct(tx.tokens(F.col("text"))).alias("t")).withColumn("need", F.size("t"))
    f = facts(spark, folder).select("fact_id", F.explode(F.array_distinct(tx.tokens(F.concat_ws(" ", "subject", "predicate", "object")))).alias("word"))
    hit = f.join(F.broadcast(q.select("query", "need", F.explode("t").alias("word"))), "word")  # words of the fixed entities
    return hit.groupBy("query", "fact_id", "need").agg(_n().alias("n")).filter("n = need").select("query", "fact_id")


@R.add("key_expand", F_ + """
, t AS (SELECT evidence_obs_id AS id, unnest([lower(subject), lower(object)]) AS term FROM f WHERE evidence_obs_id IS NOT NULL)
SELECT id, string_agg(DISTINCT term, ' ' ORDER BY term) AS key_expand FROM t WHERE term IS NOT NULL GROUP BY 1
""")  # fmt: skip
def key_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct terms of an observation's facts, as its search keys."""
    f = facts(spark, folder).filter("evidence_obs_id IS NOT NULL")
    t = f.select(F.col("evidence_obs_id").alias("id"), F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("term")).filter("term IS NOT NULL")
    return t.distinct().groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("key_expand"))


_FACT_HITS = _phrase_sql({"subject": 5.0, "predicate": 1.0, "object": 3.0, "temporal": 0.5}, "SELECT DISTINCT * FROM facts", "fact_id", _WHOLE, """, total AS (SELECT query, doc, sum(score) AS score FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM total),
x AS (SELECT r.query, e.name, unnest([trim(s.subject), trim(s.object)]) AS term, unnest([2 * r.rank, 2 * r.rank + 1]) AS pos FROM r JOIN src s ON s.fact_id = r.doc JOIN entities e ON e.entity_id = r.query WHERE r.rank <= 12),
y AS (SELECT query, lower(term) AS term, min(pos) AS pos FROM x WHERE strlen(term) >= 2 AND NOT contains(lower(name), lower(term)) GROUP BY 1, 2)
SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY pos) AS n FROM y QUALIFY n <= 8""")


@R.add("query_expansion", _FACT_HITS)
def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Up to eight subjects and objects of a query's twelve best facts that it does not hold already, in the order of the facts."""
    f, cols = facts(spark, folder), {"subject": 5.0, "predicate": 1.0, "object": 3.0, "temporal": 0.5}
    hits = lx.top(lx.search(f, "fact_id", cols, lx.phrase_table(queries(spark, folder), "query_id", "text")), 12)
    x = hits.join(f.select(F.col("fact_id").alias("doc"), "subject", "object"), "doc").join(F.broadcast(queries(spark, folder).withColumnRenamed("query_id", "query")), "query")
    x = x.select("query", F.lower("text").alias("text"), "rank", F.posexplode(F.array(F.trim("subject"), F.trim("object"))).alias("side", "term")).withColumn("low", F.lower("term"))
    y = x.filter((F.octet_length("term") >= 2) & ~F.contains("text", F.col("low"))).groupBy("query", F.col("low").alias("term")).agg(F.min(2 * F.col("rank") + F.col("side")).alias("pos"))
    return ranked(y, ["query"], [F.col("pos")], 8, "n").select("query", "term", "n")


@R.add("embedding_cache_hits", O + """
, k AS (SELECT id, sha256(title || ' ' || content) AS cache_key FROM o WHERE deleted_at IS NULL AND title IS NOT NULL AND content IS NOT NULL), c AS (SELECT DISTINCT cache_key FROM embedding_cache WHERE payload IS NOT NULL)
SELECT k.id, c.cache_key IS NOT NULL AS hit FROM k LEFT JOIN c ON c.cache_key = k.cache_key
""")  # fmt: skip
def embedding_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Which live observations have a cached vector of their text."""
    o = observations(spark, folder, live_only=True).filter("title IS NOT NULL AND content IS NOT NULL")
    k = o.select("id", F.sha2(F.concat("title", F.lit(" "), "content"), 256).alias("cache_key"))
    c = table(spark, folder, "embedding_cache").filter("payload IS NOT NULL").select("cache_key", F.lit(True).alias("known")).dropDuplicates(["cache_key"])
    return k.join(c, "cache_key", "left").select("id", F.col("known").isNotNull().alias("hit"))


@R.add("document_previews", "SELECT doc_id, md5(substring(array_to_string(string_split(text, chr(10))[1:12], ' '), 1, 900)) AS preview FROM documents WHERE text IS NOT NULL")
def document_previews(spark: SparkSession, folder: str) -> DataFrame:
    """The display preview of each document: a short view is the feature."""
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(tx.preview(F.col("text"))).alias("preview"))


@R.add("entity_normal_forms", "SELECT entity_id, lower(regexp_replace(name, '[^\\p{L}\\p{N}./_:]', '', 'g')) AS norm_name, CASE WHEN contains(name, '/') OR regexp_matches(name, '\\.(rs|ts|py|go|js|md|toml|yml|yaml)$') THEN 'file' ELSE 'concept' END AS shape FROM entities")
def entity_normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities")
    file = F.contains("name", F.lit("/")) | tx.has_file_ending(F.col("name"))
    return e.select("entity_id", tx.entity_key(F.col("name")).alias("norm_name"), F.when(file, "file").otherwise("concept").alias("shape"))


# Fixed ends that the names are given, so that every form of an anchor is met.
_ANCHOR_ENDS = ["", "::run", "::run::42", "::run::x", "::", ":12-40", ":x-y", ":7", "::run::0007"]


@R.add("anchor_parts", f"""
WITH a AS (SELECT DISTINCT trim(name || s) AS t FROM entities, (SELECT unnest([{", ".join(repr(x) for x in _ANCHOR_ENDS)}]) AS s) WHERE trim(name || s) <> ''),
p AS (SELECT t, regexp_matches(t, '^[^:]*:[0-9]+-[0-9]+$') AS ranged, string_split(t, '::') AS x FROM a),
q AS (SELECT t AS anchor, replace(CASE WHEN ranged THEN split_part(t, ':', 1) ELSE x[1] END, chr(92), '/') AS path, CASE WHEN NOT ranged THEN nullif(x[2], '') END AS symbol,
 CASE WHEN ranged THEN split_part(split_part(t, ':', 2), '-', 1) ELSE x[3] END AS a, CASE WHEN ranged THEN split_part(split_part(t, ':', 2), '-', 2) ELSE x[3] END AS b FROM p),
n AS (SELECT anchor, path, symbol, TRY_CAST(a AS INT) AS lo, TRY_CAST(b AS INT) AS hi FROM q)
SELECT anchor, path, coalesce(symbol, '') AS symbol, coalesce(lo, -1) AS line_start, coalesce(hi, -1) AS line_end,
 CASE WHEN symbol IS NOT NULL AND lo = hi THEN path || '::' || symbol || '::' || lo WHEN symbol IS NOT NULL THEN path || '::' || symbol WHEN lo <> hi THEN path || ':' || lo || '-' || hi WHEN lo IS NOT NULL THEN path || '::' || lo ELSE path END AS canonical FROM n
""")  # fmt: skip
def anchor_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of all forms taken apart and written in the one canonical way."""
    ends = F.explode(F.array(*[F.lit(x) for x in _ANCHOR_ENDS])).alias("s")
    e = table(spark, folder, "entities").select("name", ends).select(F.trim(F.concat("name", "s")).alias("anchor")).distinct().withColumn("a", tx.anchor(F.col("anchor"))).filter("a IS NOT NULL")
    none = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return e.select("anchor", "a.path", F.coalesce("a.symbol", F.lit("")).alias("symbol"), none("a.line_start").alias("line_start"), none("a.line_end").alias("line_end"), tx.anchor_text(F.col("a")).alias("canonical"))


@R.add("induced_edges", _CE + """
, ed AS (SELECT src, dst, count(*) AS weight FROM ce GROUP BY 1, 2), s AS (SELECT entity_id FROM entities WHERE kind = 'agent'), nb AS (SELECT entity_id AS node FROM s UNION SELECT dst FROM ed WHERE src IN (SELECT entity_id FROM s) UNION SELECT src FROM ed WHERE dst IN (SELECT entity_id FROM s))
SELECT src, dst, weight FROM ed WHERE src IN (SELECT node FROM nb) AND dst IN (SELECT node FROM nb)
""")  # fmt: skip
def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges among the agents and their direct neighbours."""
    e = gr.comention_edges(mentions(spark, folder)).select("src", "dst", "weight")
    seeds = table(spark, folder, "entities").filter("kind = 'agent'").select(F.col("entity_id").alias("node"))
    near = gr.neighbourhood(gr.both_ways(e), seeds, hops=1).select("node").distinct()
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


@R.add("open_conflicts", """
WITH p AS (SELECT DISTINCT least(keep_id, drop_id) AS a, greatest(keep_id, drop_id) AS b, kind FROM dream_proposals WHERE keep_id <> drop_id),
r AS (SELECT a AS id FROM p WHERE kind = 'duplicate' UNION SELECT b FROM p WHERE kind = 'duplicate') SELECT a, b FROM p WHERE kind = 'supersede' AND a NOT IN (SELECT id FROM r) AND b NOT IN (SELECT id FROM r)
""")  # fmt: skip
def open_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Supersede proposals of which neither side is settled by a duplicate proposal."""
    p = table(spark, folder, "dream_proposals").filter("keep_id <> drop_id").select(F.least("keep_id", "drop_id").alias("a"), F.greatest("keep_id", "drop_id").alias("b"), "kind").distinct()
    done = p.filter("kind = 'duplicate'").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return p.filter("kind = 'supersede'").join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")


@R.add("change_deliveries", "SELECT change_id, count(*) AS deliveries, min(feed_pos) AS first_pos, arg_min(sync_id, feed_pos) AS sync_id FROM observation_changes GROUP BY 1")
def change_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Each change once, by its first delivery."""
    return table(spark, folder, "observation_changes").groupBy("change_id").agg(_n().alias("deliveries"), F.min("feed_pos").alias("first_pos"), F.min_by("sync_id", "feed_pos").alias("sync_id"))


@R.add("deletable_sessions", O + "SELECT session_id, count(*) AS observations FROM o WHERE session_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (deleted_at IS NULL) = 0")
def deletable_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions without a live observation."""
    g = observations(spark, folder).filter("session_id IS NOT NULL").groupBy("session_id")
    return g.agg(_n().alias("observations"), F.count_if(F.col("deleted_at").isNull()).alias("live")).filter("live = 0").select("session_id", "observations")


@R.add("cascade_children", O + """
, d AS (SELECT id FROM o WHERE deleted_at IS NOT NULL) SELECT 'fact' AS kind, fact_id AS child, evidence_obs_id AS parent FROM (SELECT DISTINCT fact_id, evidence_obs_id FROM facts) WHERE evidence_obs_id IN (SELECT id FROM d)
UNION ALL SELECT 'embedding', observation_id, observation_id FROM (SELECT DISTINCT observation_id FROM observation_embedding_meta) WHERE observation_id IN (SELECT id FROM d)
""")  # fmt: skip
def cascade_children(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that go with a deleted observation."""
    d = table(spark, folder, "observations").filter("deleted_at IS NOT NULL").select(F.col("id").alias("parent")).distinct()
    f = facts(spark, folder).select(F.lit("fact").alias("kind"), F.col("fact_id").alias("child"), F.col("evidence_obs_id").alias("parent"))
    m = table(spark, folder, "observation_embedding_meta").select("observation_id").distinct().select(F.lit("embedding").alias("kind"), F.col("observation_id").alias("child"), F.col("observation_id").alias("parent"))
    return f.unionByName(m).join(d, "parent", "left_semi").select("kind", "child", "parent")


@R.add("prunable_projects", O + "SELECT project, count(*) AS observations FROM o GROUP BY 1 HAVING count(*) FILTER (deleted_at IS NULL) = 0")
def prunable_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects without a live observation."""
    g = observations(spark, folder).groupBy("project").agg(_n().alias("observations"), F.count_if(F.col("deleted_at").isNull()).alias("live"))
    return g.filter("live = 0").select("project", "observations")


@R.add("worst_state", O + """
, r AS (SELECT session_id, max(CASE verify_state WHEN 'verified' THEN 1 WHEN 'stale' THEN 2 WHEN 'invalidated' THEN 3 WHEN 'unprovable' THEN 4 ELSE 0 END) AS k FROM o WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session_id, ['unanchored','verified','stale','invalidated','unprovable'][k + 1] AS worst FROM r
""")  # fmt: skip
def worst_state(spark: SparkSession, folder: str) -> DataFrame:
    """The worst verify state of each session."""
    g = observations(spark, folder).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.max(tx.state_rank(F.col("verify_state"))).alias("k"))
    return g.select("session_id", tx.state_of(F.col("k")).alias("worst"))


@R.add("session_summaries", F_ + "SELECT source_session AS session_id, count(*) AS facts, round(sum(salience), 3) AS salience FROM f WHERE source_session IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def session_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with facts enough to be summarised."""
    g = facts(spark, folder).filter("source_session IS NOT NULL").groupBy(F.col("source_session").alias("session_id"))
    return g.agg(_n().alias("facts"), F.round(F.sum("salience"), 3).alias("salience")).filter("facts >= 3")


@R.add("sync_status", "SELECT project, count(DISTINCT change_id) AS changes, count(*) AS deliveries, count(*) - count(DISTINCT change_id) AS repeats, count(DISTINCT sync_id) AS records FROM observation_changes GROUP BY 1")
def sync_status(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "observation_changes").groupBy("project")
    return g.agg(F.countDistinct("change_id").alias("changes"), _n().alias("deliveries"), (_n() - F.countDistinct("change_id")).alias("repeats"), F.countDistinct("sync_id").alias("records"))


@R.add("doctor_findings", O + """
, m AS (SELECT DISTINCT observation_id, dim FROM observation_embedding_meta) SELECT 'missing_embedding' AS rule, count(*) AS n FROM o WHERE deleted_at IS NULL AND id NOT IN (SELECT observation_id FROM m)
UNION ALL SELECT 'orphan_embedding', count(*) FROM m WHERE observation_id NOT IN (SELECT id FROM o) UNION ALL SELECT 'odd_dim', count(*) FROM m WHERE dim NOT IN (384, 768)
UNION ALL SELECT 'bad_payload', count(*) FROM embedding_cache WHERE payload IS NULL OR octet_length(payload) NOT IN (1536, 3072) UNION ALL SELECT 'missing_hash', count(*) FROM o WHERE normalized_hash IS NULL
""")  # fmt: skip
def doctor_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each rule with the number of rows that break it."""
    o, m = observations(spark, folder), table(spark, folder, "observation_embedding_meta").select("observation_id", "dim").distinct()
    live = observations(spark, folder, live_only=True).select(F.col("id").alias("observation_id"))
    c = table(spark, folder, "embedding_cache")
    rules = {
        "missing_embedding": live.join(m, "observation_id", "left_anti"), "orphan_embedding": m.join(o.select(F.col("id").alias("observation_id")), "observation_id", "left_anti"),
        "odd_dim": m.filter(~F.col("dim").isin(384, 768)), "bad_payload": c.filter(F.col("payload").isNull() | ~F.octet_length("payload").isin(1536, 3072)), "missing_hash": o.filter("normalized_hash IS NULL"),
    }
    out = None
    for name, rows in rules.items():
        r = rows.agg(_n().alias("n")).select(F.lit(name).alias("rule"), "n")
        out = r if out is None else out.unionByName(r)
    return out


@R.add("ingest_ids", O + "SELECT id, sha256(coalesce(project,'') || '|' || coalesce(session_id,'') || '|' || coalesce(type,'') || '|' || coalesce(scope,'') || '|' || coalesce(title,'') || '|' || coalesce(content,'') || '|' || coalesce(topic_key,'')) AS ingest_id FROM o")
def ingest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A stable id from seven fields."""
    cols = ["project", "session_id", "type", "scope", "title", "content", "topic_key"]
    return observations(spark, folder).select("id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols]), 256).alias("ingest_id"))


# Fixed texts, so that every phrase and date form is met.
_TIMES = ["what happened yesterday", "done today", "over the last weekend", "this week", "last week", "this month", "last month", "last year", "on 2025-02-30 or 2025-03-01", "in 2024", "in 20xx", "two days ago", "before the move", "yesterday, not 2025-03-01", "last week, not 2025-03-01", "no time at all", ""]


@R.add("inferred_ranges", f"""
WITH s AS (SELECT DISTINCT 'fact ' || fact_id AS key, temporal AS text FROM facts WHERE temporal IS NOT NULL UNION ALL SELECT * FROM (VALUES {", ".join(f"('text {i}', '{x}')" for i, x in enumerate(_TIMES))})),
d AS (SELECT key, lower(text) AS t, list_filter(list_transform(regexp_extract_all(lower(text), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), lambda x: TRY_CAST(x AS DATE)), lambda x: x IS NOT NULL)[1] AS iso, TRY_CAST(regexp_extract(lower(text), 'in (20[0-9]{{2}})', 1) || '-01-01' AS DATE) AS yr FROM s),
r AS (SELECT key, CASE WHEN contains(t, 'yesterday') THEN 'day:2025-12-31' WHEN contains(t, 'today') THEN 'day:2026-01-01' WHEN contains(t, 'last weekend') THEN 'weekend' WHEN contains(t, 'this week') THEN 'back:7' WHEN contains(t, 'last week') THEN 'back:14'
 WHEN contains(t, 'this month') THEN 'back:31' WHEN contains(t, 'last month') THEN 'back:62' WHEN contains(t, 'last year') THEN 'back:730' WHEN coalesce(iso, yr) IS NOT NULL THEN 'day:' || coalesce(iso, yr) WHEN regexp_matches(t, 'ago|in 20|before |after |on 20') THEN 'back:90' END AS k FROM d)
SELECT key, CASE WHEN k = 'weekend' THEN TIMESTAMP '2025-12-27' WHEN k LIKE 'day:%' THEN k[5:]::TIMESTAMP ELSE TIMESTAMP '2026-01-01 09:30:00' - to_days(k[6:]::INT) END AS start_at,
 CASE WHEN k = 'weekend' THEN TIMESTAMP '2025-12-28 23:59:59' WHEN k LIKE 'day:%' THEN k[5:]::TIMESTAMP + INTERVAL '23:59:59' ELSE TIMESTAMP '2026-01-01 09:30:00' END AS end_at FROM r WHERE k IS NOT NULL
""")  # fmt: skip
def inferred_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Time ranges that facts and questions name."""
    f = facts(spark, folder).filter("temporal IS NOT NULL").select(F.concat(F.lit("fact "), "fact_id").alias("key"), F.col("temporal").alias("text"))
    t = spark.createDataFrame([(f"text {i}", x) for i, x in enumerate(_TIMES)], "key string, text string")
    r = f.unionByName(t).select("key", inferred_range(F.col("text"), F.to_timestamp_ntz(F.lit("2026-01-01 09:30:00"))).alias("r")).filter("r IS NOT NULL")
    return r.select("key", F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"))


_NAME_FORMS = ["{0}", "{0} _a/b", ".{0}", "{0}..{0}", "{0}--x-", "é?"]


@R.add("project_slugs", "WITH s AS (" + " UNION ".join("SELECT DISTINCT " + " || ".join(["''", *[f"'{x}'" if i % 2 == 0 else "source" for i, x in enumerate(f.split("{0}")[j // 2] if j % 2 == 0 else "" for j in range(2 * len(f.split("{0}")) - 1)) if i % 2 or x]]) + " AS source FROM documents WHERE source IS NOT NULL" for f in _NAME_FORMS) + """),
n AS (SELECT source, regexp_replace(translate(lower(trim(source)), ' _', '--'), '[^a-z0-9.-]', '', 'g') AS name FROM s) SELECT source, name FROM n WHERE name <> '' AND NOT starts_with(name, '.') AND NOT contains(name, '..')""")
def project_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Names on disk of the documents' sources and of variants of them; unsafe ones have none."""
    d = table(spark, folder, "documents").filter("source IS NOT NULL").select("source").distinct()
    forms = F.explode(F.array(*[F.replace(F.lit(f), F.lit("{0}"), "source") for f in _NAME_FORMS]))
    return d.select(forms.alias("source")).distinct().select("source", tx.project_name(F.col("source")).alias("name")).filter("name IS NOT NULL")


@R.add("decision_keys", O + "SELECT id, 'decision/' || substring(sha256(trim(title)), 1, 12) AS topic_key FROM o WHERE type = 'decision' AND title IS NOT NULL")
def decision_keys(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder).filter("type = 'decision' AND title IS NOT NULL")
    return o.select("id", tx.decision_key(F.col("title")).alias("topic_key"))


@R.add("type_families", O + "SELECT CASE WHEN type IN ('decision','policy','preference','note','learning','config') THEN type ELSE 'general' END AS family, count(*) AS n FROM o GROUP BY 1")
def type_families(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select(tx.family(F.col("type")).alias("family")).groupBy("family").agg(_n().alias("n"))


# Fixed questions, one for each relation in time.
_ASKED = ["what is the latest rule", "what came first in 2025", "what was before that", "what did it use later", "what does it use in 2026", "which one"]


@R.add("temporal_order", F_ + f"""
, h AS (SELECT project, fact_id, row_number() OVER (PARTITION BY project ORDER BY salience DESC, fact_id) AS place, lower(coalesce(subject,'') || ' ' || coalesce(predicate,'') || ' ' || coalesce(object,'') || ' ' || coalesce(temporal,'')) AS t FROM f QUALIFY place <= 20),
q AS (SELECT i AS question, q, CASE WHEN regexp_matches(q, 'latest|most recent|last') THEN 'latest|most recent' WHEN regexp_matches(q, 'first|earliest') THEN 'first|earliest' WHEN regexp_matches(q, 'before|earlier') THEN 'before|earlier' WHEN regexp_matches(q, 'after|later') THEN 'after|later' END AS says,
 nullif(regexp_extract(q, '[0-9]{{4}}'), '') AS yr FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(_ASKED))}) v(i, q)),
s AS (SELECT question, project, fact_id, place, CASE WHEN yr IS NOT NULL AND NOT contains(t, yr) THEN -100 WHEN says IS NOT NULL AND regexp_matches(t, says) THEN 2 ELSE 0 END AS score FROM h, q)
SELECT question, project, fact_id, score, row_number() OVER (PARTITION BY question, project ORDER BY score DESC, place) AS rank FROM s
""")  # fmt: skip
def temporal_order(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 weightiest facts of each project reordered for questions on time: by score, then as they were."""
    h = ranked(facts(spark, folder), ["project"], [F.desc("salience"), F.col("fact_id")], 20, "place")
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object", "temporal")])
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("question"), F.lit(q).alias("q")) for i, q in enumerate(_ASKED)]))
    s = h.select("project", "fact_id", "place", text.alias("t"), asked.alias("a")).select("project", "fact_id", "place", "a.question", tx.temporal_score(F.col("a.q"), F.col("t")).alias("score"))
    return ranked(s, ["question", "project"], [F.desc("score"), F.col("place")]).select("question", "project", "fact_id", "score", "rank")


@R.add("session_windows", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens, event_id FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.n
""")  # fmt: skip
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of events less than half an hour apart."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(_n().alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


_SIZE = "ceil(length(coalesce(type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,'')) / 4)::BIGINT"


@R.add("context_final", O + f"""
, q AS (SELECT *, row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id DESC) AS turn FROM o WHERE deleted_at IS NULL AND (verify_state IS NULL OR verify_state NOT IN ('stale','invalidated','unprovable'))),
p AS (SELECT project, id, turn, sum({_SIZE}) OVER (PARTITION BY project ORDER BY turn, created_at DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens FROM q WHERE turn <= 4) SELECT project, id, turn, tokens FROM p WHERE tokens <= 1500
""")  # fmt: skip
def context_final(spark: SparkSession, folder: str) -> DataFrame:
    """A briefing for each project: fresh rows, kinds in turns, packed into 1 500 tokens."""
    from lorekeep.operators import context as cx

    o = observations(spark, folder, live_only=True).filter(F.col("verify_state").isNull() | ~F.col("verify_state").isin("stale", "invalidated", "unprovable"))
    q = cx.type_round_robin(o, ["project"], "type", [F.desc("created_at"), F.desc("id")], 4)
    p = cx.token_pack(q, ["project"], F.col("turn"), [F.col("turn"), F.desc("created_at"), F.desc("id")], tx.token_estimate(F.col("type"), F.col("title"), F.col("content")), 1500)
    return p.select("project", "id", "turn", F.col("tokens_after").alias("tokens"))


@R.add("fact_char_pack", F_ + """
, s AS (SELECT project, fact_id, row_number() OVER w AS rank, sum(length(coalesce(subject,'') || ' ' || coalesce(predicate,'') || ' ' || coalesce(object,''))) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS chars FROM f WINDOW w AS (PARTITION BY project ORDER BY salience DESC, fact_id))
SELECT project, fact_id, chars FROM s WHERE chars <= 600 OR rank = 1
""")  # fmt: skip
def fact_char_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The weightiest facts of each project that fit 600 characters; the first is always kept."""
    from lorekeep.operators.prefix import block_prefix_sum

    f = facts(spark, folder).withColumn("n", F.length(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")])))
    s = block_prefix_sum(f, ["project"], -F.floor(F.col("salience") * 50), [F.desc("salience"), F.col("fact_id")], F.col("n"), "before")
    return s.filter((F.col("before") + F.col("n") <= 600) | (F.col("before") == 0)).select("project", "fact_id", (F.col("before") + F.col("n")).alias("chars"))


@R.add("skip_pack", O.replace("WITH o", "WITH RECURSIVE o") + f"""
, z AS (SELECT project, id, {_SIZE} AS size, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rank FROM o WHERE deleted_at IS NULL),
g AS (SELECT *, CASE WHEN size <= 1000 THEN 1000 - size ELSE 1000 END AS room, size <= 1000 AS taken FROM z WHERE rank = 1
 UNION ALL SELECT z.*, CASE WHEN z.size <= g.room THEN g.room - z.size ELSE g.room END, z.size <= g.room FROM g JOIN z ON z.project = g.project AND z.rank = g.rank + 1) SELECT project, id, size, rank FROM g WHERE taken
""")  # fmt: skip
def skip_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's newest observations, taken greedily into 1 000 tokens."""
    from lorekeep.operators import context as cx

    o = observations(spark, folder, live_only=True).select("project", "id", "created_at", tx.token_estimate(F.col("type"), F.col("title"), F.col("content")).alias("size"))
    o = cx.newest_ranked(o, ["project"]).select("project", F.col("id").alias("key"), "rank", "size")
    return cx.skip_pack(o, ["project"], 1000).withColumnRenamed("key", "id")


@R.add("retrieval_trace", F_ + """
, a AS (SELECT project, fact_id, row_number() OVER (PARTITION BY project ORDER BY salience DESC, fact_id) AS ra, row_number() OVER (PARTITION BY project ORDER BY extracted_at DESC, fact_id) AS rb FROM f),
l AS (SELECT project, fact_id, 1 AS lane, ra AS rank FROM a WHERE ra <= 10 UNION ALL SELECT project, fact_id, 2, rb FROM a WHERE rb <= 10),
g AS (SELECT project, fact_id, sum(1.0 / (60 + rank)) AS score, coalesce(max(CASE lane WHEN 1 THEN rank END), 0) AS lane1, coalesce(max(CASE lane WHEN 2 THEN rank END), 0) AS lane2, min(lane * 100000 + rank) AS seen FROM l GROUP BY 1, 2)
SELECT project, fact_id, lane1, lane2, round(score, 9) AS score, row_number() OVER (PARTITION BY project ORDER BY round(score, 12) DESC, seen, fact_id) AS fused FROM g
""")  # fmt: skip
def retrieval_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by weight and by age fused per project, with the rank in each lane (0: not in it)."""
    from lorekeep.operators.fusion import reciprocal_rank

    f = facts(spark, folder)
    a = ranked(f, ["project"], [F.desc("salience"), F.col("fact_id")], 10).select("project", "fact_id", F.lit(1).alias("lane"), "rank")
    b = ranked(f, ["project"], [F.desc("extracted_at"), F.col("fact_id")], 10).select("project", "fact_id", F.lit(2).alias("lane"), "rank")
    lanes = a.unionByName(b)
    fused = reciprocal_rank(lanes, by=("project",), item="fact_id").withColumnRenamed("rank", "fused")
    own = lanes.groupBy("project", "fact_id").agg(*[F.coalesce(F.max(F.when(F.col("lane") == n, F.col("rank"))), F.lit(0)).alias(f"lane{n}") for n in (1, 2)])
    return fused.join(own, ["project", "fact_id"]).select("project", "fact_id", "lane1", "lane2", F.round("score", 9).alias("score"), "fused")


@R.add("fact_lane_boost", F_ + """
, r AS (SELECT evidence_obs_id AS id, row_number() OVER (PARTITION BY project ORDER BY salience DESC, fact_id) AS rank FROM f WHERE evidence_obs_id IS NOT NULL)
SELECT id, round(max(greatest(0.6 - 0.02 * (rank - 1), 0.2)), 6)::DOUBLE AS boost FROM r GROUP BY 1
""")  # fmt: skip
def fact_lane_boost(spark: SparkSession, folder: str) -> DataFrame:
    """What an observation gains from the rank of its facts: 0.6 less 0.02 a place, at least 0.2."""
    r = ranked(facts(spark, folder).filter("evidence_obs_id IS NOT NULL"), ["project"], [F.desc("salience"), F.col("fact_id")])
    return r.groupBy(F.col("evidence_obs_id").alias("id")).agg(F.round(F.max(F.greatest(0.6 - 0.02 * (F.col("rank") - 1), F.lit(0.2))), 6).alias("boost"))
