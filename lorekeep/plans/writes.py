"""Write-path, context and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.instants import instant
from lorekeep.operators import context as cx
from lorekeep.operators import dense
from lorekeep.operators import evaluate as ev
from lorekeep.operators import memory as mem
from lorekeep.operators.names import similar_names
from lorekeep.plans.registry import TOKENS, Registry, table
from lorekeep.sources.memory import facts, observations

R = Registry()
O = "WITH o AS (SELECT DISTINCT * FROM observations) "  # noqa: E741


@R.add("topic_upsert", O + """
SELECT topic_key, scope, count(*) AS revision_count, arg_max(content, (created_at, id)) AS content, min(created_at) AS created_at, arg_max(id, (created_at, id)) AS id
FROM o WHERE topic_key IS NOT NULL AND deleted_at IS NULL GROUP BY 1, 2
""")  # fmt: skip
def topic_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return mem.topic_upsert(observations(spark, folder, live_only=True))


@R.add("dedupe_hash", """
WITH RECURSIVE o AS (SELECT DISTINCT id, normalized_hash AS h, created_at AS t FROM observations WHERE deleted_at IS NULL),
r AS (SELECT h, t, id, row_number() OVER (PARTITION BY h ORDER BY t, id) AS n FROM o WHERE h IS NOT NULL),
f AS (SELECT h, t, id, n, t AS t0, id AS first_id FROM r WHERE n = 1
 UNION ALL SELECT r.h, r.t, r.id, r.n, CASE WHEN r.t <= f.t0 + INTERVAL 30 DAY THEN f.t0 ELSE r.t END, CASE WHEN r.t <= f.t0 + INTERVAL 30 DAY THEN f.first_id ELSE r.id END FROM f JOIN r ON r.h = f.h AND r.n = f.n + 1)
SELECT id, first_id, id <> first_id AS duplicate FROM f UNION ALL SELECT id, id, false FROM o WHERE h IS NULL
""")  # fmt: skip
def dedupe_hash(spark: SparkSession, folder: str) -> DataFrame:
    return mem.window_dedupe(observations(spark, folder, live_only=True), "normalized_hash", "created_at", "id")


@R.add("supersede_titles", O + """
SELECT id, coalesce(lead(id) OVER (PARTITION BY scope, type, title ORDER BY created_at, id), -1) AS superseded_by FROM o WHERE title IS NOT NULL
""")  # fmt: skip
def supersede_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of equal scope, type and title: each is superseded by the next (-1: none)."""
    o = observations(spark, folder).filter("title IS NOT NULL")
    return mem.supersede_next(o, ["scope", "type", "title"], ["created_at", "id"], "id").select("id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


_F = "WITH f AS (SELECT DISTINCT * FROM facts), k AS (SELECT fact_id, project, lower(trim(subject)) AS s, lower(trim(predicate)) AS p, lower(trim(object)) AS object, extracted_at AS t, salience FROM f) "


@R.add("fact_supersede", _F + """
SELECT a.fact_id, coalesce((SELECT arg_min(b.fact_id, (b.t, b.fact_id)) FROM k b WHERE b.project = a.project AND b.s = a.s AND b.p = a.p AND (b.t, b.fact_id) > (a.t, a.fact_id) AND b.object <> a.object), -1) AS superseded_by
FROM k a
""")  # fmt: skip
def fact_supersede(spark: SparkSession, folder: str) -> DataFrame:
    """Facts superseded by the first later fact of the same subject and predicate with another object (-1: none)."""
    f = facts(spark, folder).select("fact_id", "project", *[F.lower(F.trim(c)).alias(a) for c, a in (("subject", "s"), ("predicate", "p"), ("object", "object"))], "extracted_at")
    out = mem.supersede_on_change(f, ["project", "s", "p"], ["extracted_at", "fact_id"], "object", "fact_id")
    return out.select("fact_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@R.add("canonical_fact", _F + """
, r AS (SELECT *, row_number() OVER (PARTITION BY project, s, p ORDER BY salience DESC, fact_id) AS rn FROM k) SELECT fact_id, project, s AS subject, p AS predicate, salience FROM r WHERE rn = 1
""")  # fmt: skip
def canonical_fact(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).groupBy("project", F.lower(F.trim("subject")).alias("subject"), F.lower(F.trim("predicate")).alias("predicate"))
    return f.agg(F.max_by("fact_id", F.struct(F.col("salience"), -F.col("fact_id"))).alias("fact_id"), F.max("salience").alias("salience"))


_TS = "CAST(CASE WHEN regexp_matches(updated_at[11:], '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN updated_at ELSE updated_at || '+00' END AS TIMESTAMPTZ)"


@R.add("lww_sync", f"""
WITH c AS (SELECT sync_id, {_TS} AS t, feed_pos % 2 AS side FROM observation_changes), l AS (SELECT sync_id, max(t) AS t FROM c WHERE side = 0 GROUP BY 1), r AS (SELECT sync_id, max(t) AS t FROM c WHERE side = 1 GROUP BY 1)
SELECT coalesce(l.sync_id, r.sync_id) AS sync_id, CASE WHEN l.t IS NULL THEN 'insert' WHEN r.t IS NULL THEN 'local_only' WHEN r.t > l.t THEN 'overwrite' ELSE 'keep' END AS outcome FROM l FULL JOIN r ON l.sync_id = r.sync_id
""")  # fmt: skip
def lww_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Odd feed positions as the remote side, even ones as the local: both sides together are the whole feed."""
    c = table(spark, folder, "observation_changes").select("sync_id", instant(F.col("updated_at")).alias("t"), F.pmod("feed_pos", F.lit(2)).alias("side"))
    side = lambda n: c.filter(F.col("side") == n).groupBy("sync_id").agg(F.max("t").alias("t"))
    return mem.last_writer(side(0), side(1), "sync_id", "t")


@R.add("merge_ignore", O + """
, t AS (SELECT topic_key, scope, min(id) AS id FROM o WHERE topic_key IS NOT NULL AND scope = 'project' GROUP BY 1, 2), s AS (SELECT topic_key, min(id) AS id FROM o WHERE topic_key IS NOT NULL AND scope = 'team' GROUP BY 1)
SELECT topic_key, id, 'project' AS origin FROM t UNION ALL SELECT topic_key, id, 'team' FROM s WHERE topic_key NOT IN (SELECT topic_key FROM t)
""")  # fmt: skip
def merge_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Team topics merged into the project's, existing keys kept."""
    o = observations(spark, folder).filter("topic_key IS NOT NULL")
    side = lambda s: o.filter(F.col("scope") == s).groupBy("topic_key").agg(F.min("id").alias("id")).withColumn("origin", F.lit(s))
    return mem.merge_ignore(side("project"), side("team"), "topic_key")


@R.add("job_fold", """
SELECT user_id AS job, count(*) AS attempts, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS last_ts, count(*) FILTER (event_type = 'error') AS failures,
 CASE WHEN count(*) FILTER (event_type = 'error') >= 5 AND arg_max(event_type, (ts, event_id)) = 'error' THEN 'dead' WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'pending' WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'completed' ELSE 'running' END AS status
FROM events GROUP BY 1
""")  # fmt: skip
def job_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The event log folded to one state a job."""
    g = table(spark, folder, "events").groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("attempts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("failures"))
    err = F.col("last_event") == "error"
    return g.withColumn("status", F.when(err & (F.col("failures") >= 5), "dead").when(err, "pending").when(F.col("last_event") == "purchase", "completed").otherwise("running"))


@R.add("dream_duplicates", O + """
, g AS (SELECT id, first_value(id) OVER (PARTITION BY type, scope, normalized_hash ORDER BY created_at DESC, id DESC) AS keep_id FROM o WHERE normalized_hash <> '' AND deleted_at IS NULL)
SELECT keep_id, id AS drop_id, 'duplicate' AS kind, 1.0::DOUBLE AS confidence FROM g WHERE id <> keep_id
""")  # fmt: skip
def dream_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Live observations of equal type, scope and content hash: the newest is kept; one row a duplicate, not a pair of all."""
    same = ["type", "scope", "normalized_hash"]
    o = observations(spark, folder, live_only=True).filter("normalized_hash <> ''").select(*same, "id", "created_at")
    k = o.groupBy(*same).agg(F.max_by("id", F.struct("created_at", "id")).alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return o.join(k, same).filter("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"), F.lit("duplicate").alias("kind"), F.lit(1.0).alias("confidence"))


@R.add("dream_supersedes", O + f"""
, t AS (SELECT id, type, scope, created_at, nullif(normalized_hash, '') AS h, length(trim(title)) AS n, {TOKENS.format("title")} AS t, ' ' || array_to_string({TOKENS.format("title")}, ' ') || ' ' AS ti, ' ' || array_to_string({TOKENS.format("content")}, ' ') || ' ' AS co FROM o WHERE deleted_at IS NULL),
j AS (SELECT a.id AS a, b.id AS b, (a.created_at, a.id) > (b.created_at, b.id) AS newer FROM t a JOIN t b ON b.type = a.type AND b.scope = a.scope AND b.id <> a.id WHERE a.type <> 'note' AND a.n >= 8 AND len(a.t) > 0 AND (contains(b.ti, a.ti) OR contains(b.co, a.ti)) AND NOT coalesce(a.h = b.h, false)
 AND 2.0 * len(list_intersect(list_distinct(a.t), list_distinct(b.t))) / (len(list_distinct(a.t)) + len(list_distinct(b.t))) >= 0.55)
SELECT DISTINCT CASE WHEN newer THEN a ELSE b END AS keep_id, CASE WHEN newer THEN b ELSE a END AS drop_id, 'supersede' AS kind, 0.6::DOUBLE AS confidence FROM j
""")  # fmt: skip
def dream_supersedes(spark: SparkSession, folder: str) -> DataFrame:
    """The title half of the consolidation scan: live observations whose titles overlap; ``dream_duplicates`` is the other half."""
    return mem.title_supersedes(observations(spark, folder, live_only=True, wide=True)).select("keep_id", "drop_id", F.lit("supersede").alias("kind"), F.lit(0.6).alias("confidence"))


# context -----------------------------------------------------------------------
_SIZE = "ceil(length(coalesce(type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,'')) / 4)::BIGINT"


@R.add("token_pack", O + f"""
, s AS (SELECT project, id, sum({_SIZE}) OVER (PARTITION BY project ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_after FROM o WHERE deleted_at IS NULL)
SELECT project, id, tokens_after FROM s WHERE tokens_after <= 2000
""")  # fmt: skip
def token_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The newest live observations of each project that fit 2 000 tokens."""
    o = observations(spark, folder, live_only=True)
    day = -F.datediff(F.col("created_at"), F.lit("1970-01-01").cast("date"))
    return cx.token_pack(o, ["project"], day, [F.desc("created_at"), F.desc("id")], tx.token_estimate(F.col("type"), F.col("title"), F.col("content")), 2000).select("project", "id", "tokens_after")


@R.add("type_round_robin", O + """
, r AS (SELECT project, type, id, row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id DESC) AS turn FROM o WHERE deleted_at IS NULL) SELECT project, type, id, turn FROM r WHERE turn <= 3
""")  # fmt: skip
def type_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True).select("project", "type", "id", "created_at")
    return cx.type_round_robin(o, ["project"], "type", [F.desc("created_at"), F.desc("id")], 3).select("project", "type", "id", "turn")


@R.add("evidence_window", O + """
, d AS (SELECT id, session_id, project, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rank FROM o WHERE deleted_at IS NULL AND type = 'decision' AND session_id IS NOT NULL),
j AS (SELECT s.project AS query, b.id, min(s.rank * 2 + CASE WHEN b.id = s.id THEN 0 ELSE 1 END) AS pos FROM d s JOIN o b ON b.session_id = s.session_id AND b.id BETWEEN s.id - 3 AND s.id + 3 AND b.deleted_at IS NULL WHERE s.rank <= 5 GROUP BY 1, 2)
SELECT query, id, pos // 2 AS seed_rank, pos % 2 = 0 AS is_seed FROM j
""")  # fmt: skip
def evidence_window(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest decisions of each project with what stands around them in their session."""
    o = observations(spark, folder, live_only=True).select("id", "session_id", "project", "type", "created_at")
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("id"))
    seeds = o.filter("type = 'decision' AND session_id IS NOT NULL").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select(F.col("project").alias("query"), "rank", "id", "session_id")
    return cx.evidence_window(seeds, o.select("id", "session_id"), "id", "session_id", 3)


_SLOTS = f"""
WITH o AS (SELECT DISTINCT * FROM observations WHERE deleted_at IS NULL),
z AS (SELECT project, id, CASE WHEN type IN ('decision', 'policy') THEN 0 WHEN topic_key IS NOT NULL THEN 1 ELSE 2 END AS slot, {_SIZE} AS size, created_at FROM o),
c AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM z WINDOW w AS (PARTITION BY project, slot ORDER BY created_at DESC, id DESC)),
p AS (SELECT DISTINCT project FROM z)"""
_SPARE = {0: "700", 1: "700 + greatest(700 - t0, 0)", 2: "600 + greatest(700 + greatest(700 - t0, 0) - t1, 0)"}
_USED = {0: "0", 1: "t0", 2: "t0 + t1"}
for _s in (0, 1, 2):
    _room, _prev = f"greatest(1, least({_SPARE[_s]}, 2000 - ({_USED[_s]})))", f"p{_s - 1}" if _s else "p"
    # the longest prefix that fits the slot; else its first row, if the whole budget has room for it
    _fits = f"coalesce((SELECT max(upto) FROM c WHERE c.project = q.project AND slot = {_s} AND upto <= {_room}), (SELECT max(size) FROM c WHERE c.project = q.project AND slot = {_s} AND n = 1 AND size <= 2000 - ({_USED[_s]})), 0)"
    _SLOTS += f", p{_s} AS (SELECT q.*, {_fits} AS t{_s} FROM {_prev} q)"
_SLOTS += " SELECT c.project, c.id, c.slot, c.size, c.rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rank FROM c) c JOIN p2 ON p2.project = c.project WHERE upto <= CASE slot WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END"


@R.add("slot_pack", _SLOTS)
def slot_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's newest observations in slots of a 2 000 token budget."""
    slot = F.when(F.col("type").isin("decision", "policy"), 0).when(F.col("topic_key").isNotNull(), 1).otherwise(2)
    o = observations(spark, folder, live_only=True).select("project", "id", "created_at", slot.alias("slot"), tx.token_estimate(F.col("type"), F.col("title"), F.col("content")).alias("size"))
    rows = cx.newest_ranked(o, ["project"]).select("project", F.col("id").alias("key"), "slot", "rank", "size")
    return cx.slot_pack(rows, ["project"], 2000).withColumnRenamed("key", "id")


@R.add("turn_windows", O + """
, t AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM o WHERE session_id IS NOT NULL),
w AS (SELECT DISTINCT session_id, unnest(range(0, CAST(ceil(greatest(n - 6, 0) / 3.0) AS BIGINT) + 1)) AS win FROM t)
SELECT t.session_id, w.win AS window_no, t.pos, t.id FROM t JOIN w ON w.session_id = t.session_id AND t.pos BETWEEN w.win * 3 AND w.win * 3 + 5
""")  # fmt: skip
def turn_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions cut into overlapping windows of six turns, three apart."""
    o = observations(spark, folder).filter("session_id IS NOT NULL").select("session_id", "id", "created_at")
    t = cx.turn_windows(o, ["session_id"], [F.col("created_at"), F.col("id")])
    return t.select("session_id", F.col("window").alias("window_no"), "pos", "id")


@R.add("word_chunks", """
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 350, 0) / 300.0) AS BIGINT) + 1)) AS n FROM d)
SELECT doc_id, n AS chunk, len(w[n * 300 + 1 : n * 300 + 350]) AS words, CASE WHEN len(w) <= 350 THEN '' ELSE md5(array_to_string(w[n * 300 + 1 : n * 300 + 350], ' ')) END AS hash FROM c
""")  # fmt: skip
def word_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in chunks of 350 words, 50 shared."""
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    c = d.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n"), F.posexplode(tx.word_chunks(F.col("text"))).alias("chunk", "part"))
    words = F.size(F.filter(F.split("part", r"\s+"), lambda x: x != "")).cast("long")
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), words.alias("words"), F.when(F.col("n") <= 350, "").otherwise(F.md5("part")).alias("hash"))


@R.add("chunk_export", O + """
, l AS (SELECT project, id // 1024 AS part, id, '{"_kind":"observation","id":' || id || ',"sync_id":"' || sync_id || '","revision_count":' || revision_count || '}' AS line FROM o),
c AS (SELECT project, part, count(*) AS lines, string_agg(line, chr(10) ORDER BY id) AS body FROM l GROUP BY 1, 2)
SELECT project, part, lines, substring(sha256(body), 1, 16) AS chunk_id FROM c
""")  # fmt: skip
def chunk_export(spark: SparkSession, folder: str) -> DataFrame:
    """Content-addressed chunks of tagged lines; a chunk spans at most 1 024 ids of a project."""
    from lorekeep.sources.chunks import chunk_ids

    o = observations(spark, folder).select("project", "id", F.to_json(F.struct(F.lit("observation").alias("_kind"), "id", "sync_id", "revision_count")).alias("line"))
    return chunk_ids(o, ["project"], "id", "line").drop("body")


# evaluation --------------------------------------------------------------------
_EVAL = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT * FROM v WHERE id % 50 = 0),
d AS (SELECT q.id AS query, q.label AS ql, v.label AS vl, v.id, round(1 - list_cosine_similarity(q.vec, v.vec), 9) AS distance FROM q JOIN v ON v.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d), f AS (SELECT query, ql, min(CASE WHEN ql = vl THEN rank END) AS first FROM r WHERE rank <= 10 GROUP BY 1, 2)
SELECT CAST(ql AS BIGINT) AS label, count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f GROUP BY 1
"""


@R.add("eval_report", _EVAL)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at 10 and mean reciprocal rank of the nearest neighbours, a hit being one of the query's label."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query"), "vec", "label")
    k = dense.block_knn(v, q.select("query", "vec"), 11).filter("id <> query")
    w = Window.partitionBy("query").orderBy("distance", "id")
    k = k.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    j = k.join(v.select("id", F.col("label").alias("vl")), "id").join(q.select("query", "label"), "query").withColumn("relevant", F.col("label") == F.col("vl"))
    r = ev.retrieval_report(j, ["label"])
    return r.select("label", "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@R.add("latency_percentiles", """
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT unnest([50, 95, 99]) AS percent) SELECT event_type, percent, value FROM e JOIN p ON pos = CAST(round(percent / 100.0 * (n - 1)) AS BIGINT)
""")  # fmt: skip
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles by a distributed rank."""
    return ev.nearest_rank(table(spark, folder, "events"), ["event_type"], "value", "event_id", [50, 95, 99], F.floor("value"))


@R.add("stratified_sample", O + """
, n AS (SELECT type, count(*) AS n FROM o GROUP BY 1), t AS (SELECT sum(n) AS total FROM n), b AS (SELECT type, n, 200 * n // total AS base, 200 * n % total AS rest FROM n, t),
k AS (SELECT type, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, type) <= 200 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS rn FROM o) SELECT r.type, r.id FROM r JOIN k ON k.type = r.type WHERE rn <= quota
""")  # fmt: skip
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """200 observations, types in proportion: sampling is what this operator is for."""
    return ev.stratified(observations(spark, folder).select("type", "id"), "type", "id", 200)


@R.add("failure_class", O + """
, n AS (SELECT o.id, o.type, o.verify_state, count(f.fact_id) AS n_facts FROM o LEFT JOIN (SELECT DISTINCT fact_id, evidence_obs_id FROM facts) f ON f.evidence_obs_id = o.id GROUP BY 1, 2, 3)
SELECT id, CASE WHEN verify_state = 'verified' THEN 'none' WHEN n_facts = 0 AND verify_state = 'unanchored' THEN 'retrieval_miss' WHEN type = 'decision' AND n_facts > 0 THEN 'wrong_temporal_version' WHEN type = 'bugfix' AND n_facts > 0 AND (n_facts < 2 OR verify_state = 'unanchored') THEN 'incomplete_chain'
 WHEN n_facts = 0 THEN 'fact_extraction' WHEN verify_state = 'unanchored' THEN 'context_packing' ELSE 'answer_synthesis' END AS failure FROM n
""")  # fmt: skip
def failure_class(spark: SparkSession, folder: str) -> DataFrame:
    """The failure tree over observations: facts found, anchored evidence found, kind of question."""
    n = facts(spark, folder).filter("evidence_obs_id IS NOT NULL").groupBy(F.col("evidence_obs_id").alias("id")).agg(F.count(F.lit(1)).alias("n_facts"))
    o = observations(spark, folder).join(n, "id", "left").na.fill(0, ["n_facts"])
    n_obs = F.when(F.col("verify_state") == "unanchored", 0).otherwise(2)
    kind = F.when(F.col("type") == "decision", "temporal").when(F.col("type") == "bugfix", "multi_hop").otherwise("single_hop")
    f = ev.failure_class(F.col("verify_state") == "verified", F.col("n_facts") > 0, F.col("n_facts"), n_obs, kind)
    return o.select("id", F.coalesce(f, F.lit("none")).alias("failure"))


@R.add("temporal_facts", """
WITH f AS (SELECT DISTINCT fact_id, project, temporal FROM facts), t AS (SELECT fact_id, project, CASE WHEN regexp_full_match(temporal, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN temporal::DATE WHEN regexp_full_match(temporal, '[0-9]{4}-[0-9]{2}') THEN (temporal || '-01')::DATE WHEN regexp_full_match(temporal, '[0-9]{4}') THEN (temporal || '-01-01')::DATE END AS day FROM f),
c AS (SELECT *, day BETWEEN DATE '2025-03-01' AND DATE '2025-09-30' AS inside, count(*) FILTER (day BETWEEN DATE '2025-03-01' AND DATE '2025-09-30') OVER (PARTITION BY project) AS n FROM t)
SELECT fact_id, project FROM c WHERE n < 3 OR inside
""")  # fmt: skip
def temporal_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A soft time filter: facts of a range where a project has at least three, else all of its facts."""
    t = F.col("temporal")
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).try_cast("date")
    f = facts(spark, folder).select("fact_id", "project", day.between(F.lit("2025-03-01").cast("date"), F.lit("2025-09-30").cast("date")).alias("inside"))
    n = f.groupBy("project").agg(F.count_if("inside").alias("n"))
    return f.join(n, "project").filter("n < 3 OR inside").select("fact_id", "project")


@R.add("name_similarity", """
WITH p AS (SELECT DISTINCT project AS name FROM observations WHERE project IS NOT NULL)
SELECT a.name AS name_a, b.name AS name_b, round(jaro_winkler_similarity(a.name, b.name), 6) AS similarity FROM p a JOIN p b ON a.name < b.name WHERE round(jaro_winkler_similarity(a.name, b.name), 9) >= 0.85
""")  # fmt: skip
def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Project names that are nearly the same."""
    p = table(spark, folder, "observations").select(F.col("project").alias("name")).filter("name IS NOT NULL").distinct()
    return similar_names(p, "name", 0.85)


_HEADINGS = "key learnings|open points|what changed|outcome"
# Fixed texts, as no document has a list below such a heading.
_CAPTURED = ["## Key Learnings:\n- one\n  * two \n3. three\nplain\n- one\n### Next\n- not this", "- before\n##  KEY learnings\r\n+ four\r\n4) five\n- \n## Key Learnings::\n- six", "# Key Learnings\n- no\n## Outcome\n\n - seven\n## Why\n- no"]
_CAPTURED_SQL = " ".join(f"UNION ALL SELECT {-i - 1}, replace('" + t.replace("\r", "").replace("\n", "|") + "', '|', chr(10))" for i, t in enumerate(_CAPTURED))


@R.add("passive_capture", f"""
WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL {_CAPTURED_SQL}),
l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x, unnest(range(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) AS n FROM docs),
h AS (SELECT *, regexp_matches(x, '^\\s*#{{1,6}} ') AS closes, regexp_matches(lower(rtrim(x)), '^\\s*## \\s*({_HEADINGS})\\s*:*$') AS opens FROM l),
b AS (SELECT *, last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS inside, trim(regexp_extract(x, '^\\s*(?:[-*+] |[0-9]+[.)] )(.*)$', 1)) AS item FROM h),
d AS (SELECT doc_id, item, min(n) AS n FROM b WHERE inside = 1 AND NOT closes AND item <> '' GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, md5(item) AS bullet FROM d
""")  # fmt: skip
def passive_capture(spark: SparkSession, folder: str) -> DataFrame:
    """List items under the headings that are worth keeping."""
    from lorekeep.sources.loaders import bullets

    d = table(spark, folder, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(_CAPTURED)], "doc_id long, text string"))
    b = bullets(d, "doc_id", "text", _HEADINGS)
    return b.select("doc_id", "pos", F.md5("bullet").alias("bullet"))


@R.add("beam_rows", """
WITH r AS (SELECT range AS n FROM range(100000)) SELECT ((n * 7) % 20)::BIGINT AS person, ((n // 20) % 4)::BIGINT AS property, count(*) AS n_rows FROM r GROUP BY 1, 2
""")  # fmt: skip
def beam_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The synthetic generator's rows counted by person and property."""
    from lorekeep.sources.loaders import beam

    b = beam(spark, 100_000)
    return b.groupBy("person", "property").agg(F.count(F.lit(1)).alias("n_rows"))


@R.add("stream_event_counts", "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by a stream over the events file."""
    from lorekeep.streaming.windows import hourly_counts

    return hourly_counts(spark, folder)
