"""Relational queries: filters, pages, neighbours, aggregates, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators.relational import keyset_page, latest, live, near_keys, orphan_rows, ranked
from lorekeep.plans.registry import Registry, table
from lorekeep.sources.memory import facts, links, mentions, observations

R = Registry()
O = "WITH o AS (SELECT DISTINCT * FROM observations) "  # noqa: E741
STALE = ["stale", "invalidated", "unprovable"]
NOW = "2026-01-01 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


@R.add("live_filter", O + "SELECT id, type, scope, verify_state FROM o WHERE deleted_at IS NULL AND (verify_state IS NULL OR verify_state NOT IN ('stale','invalidated','unprovable'))")
def live_filter(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True)
    return o.filter(F.col("verify_state").isNull() | ~F.col("verify_state").isin(STALE)).select("id", "type", "scope", "verify_state")


@R.add("filtered_list", O + "SELECT id, title, session_id FROM o WHERE deleted_at IS NULL AND type = 'decision' AND scope = 'project' AND created_by IS NOT NULL")
def filtered_list(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True).filter("type = 'decision' AND scope = 'project' AND created_by IS NOT NULL")
    return o.select("id", "title", "session_id")


@R.add("keyset_page2", O + """
, r AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM o WHERE deleted_at IS NULL)
SELECT id, created_at FROM r WHERE rn BETWEEN 21 AND 40
""")  # fmt: skip
def keyset_page2(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True).select("id", "created_at")
    first = keyset_page(o, F.col("created_at"), F.col("id"), None, 20).collect()
    return keyset_page(o, F.col("created_at"), F.col("id"), (first[-1]["created_at"], first[-1]["id"]), 20)


@R.add("session_page", O + """
, s AS (SELECT session_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS n FROM o WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session_id, started_at, ended_at, n FROM s ORDER BY started_at DESC, session_id DESC LIMIT 50
""")  # fmt: skip
def session_page(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder).filter("session_id IS NOT NULL")
    s = o.groupBy("session_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count(F.lit(1)).alias("n"))
    return keyset_page(s, F.col("started_at"), F.col("session_id"), None, 50)


@R.add("timeline_neighbors", O + """
, t AS (SELECT id, project, lag(id) OVER w AS before_id, lead(id) OVER w AS after_id FROM o WHERE deleted_at IS NULL WINDOW w AS (PARTITION BY project, session_id ORDER BY created_at, id))
SELECT id, project, coalesce(before_id, -1) AS before_id, coalesce(after_id, -1) AS after_id FROM t
""")  # fmt: skip
def timeline_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The observation before and after each one within its project and session (-1: none)."""
    w = Window.partitionBy("project", "session_id").orderBy("created_at", "id")
    return observations(spark, folder, live_only=True).select("id", "project", F.lag("id", 1, -1).over(w).alias("before_id"), F.lead("id", 1, -1).over(w).alias("after_id"))


@R.add("active_topics", O + """
, t AS (SELECT topic_key, scope, title, updated_at, id, row_number() OVER (PARTITION BY topic_key, scope ORDER BY updated_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY topic_key, scope) AS n
        FROM o WHERE deleted_at IS NULL AND topic_key IS NOT NULL)
SELECT topic_key, scope, title, n AS observations, updated_at FROM t WHERE rn = 1
""")  # fmt: skip
def active_topics(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True).filter("topic_key IS NOT NULL")
    return o.groupBy("topic_key", "scope").agg(F.max_by("title", F.struct("updated_at", "id")).alias("title"), F.count(F.lit(1)).alias("observations"), F.max("updated_at").alias("updated_at"))


@R.add("project_stats", O + """
SELECT project, count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, count(*) FILTER (superseded_by_id IS NOT NULL) AS superseded,
       count(DISTINCT session_id) AS sessions, count(DISTINCT topic_key) AS topics
FROM o GROUP BY project
""")  # fmt: skip
def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder)
    return o.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("superseded_by_id").isNotNull()).alias("superseded"),
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("topic_key").alias("topics"),
    )


@R.add("project_summary", O + """
, f AS (SELECT project, count(*) AS facts, round(sum(salience), 3) AS salience FROM (SELECT DISTINCT * FROM facts) GROUP BY project),
p AS (SELECT project, count(*) AS observations, max(updated_at) AS last_update FROM o WHERE deleted_at IS NULL GROUP BY project)
SELECT coalesce(p.project, f.project) AS project, coalesce(observations, 0) AS observations, coalesce(facts, 0) AS facts, salience, last_update
FROM p FULL JOIN f ON p.project = f.project
""")  # fmt: skip
def project_summary(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).groupBy("project").agg(F.count(F.lit(1)).alias("facts"), F.round(F.sum("salience"), 3).alias("salience"))
    p = observations(spark, folder, live_only=True).groupBy("project").agg(F.count(F.lit(1)).alias("observations"), F.max("updated_at").alias("last_update"))
    return p.join(f, "project", "full").select("project", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("facts", F.lit(0)).alias("facts"), "salience", "last_update")


@R.add("verify_hist_rollup", O + "SELECT coalesce(scope, '*') AS scope, coalesce(verify_state, '*') AS verify_state, count(*) AS n FROM o GROUP BY ROLLUP (scope, verify_state)")
def verify_hist_rollup(spark: SparkSession, folder: str) -> DataFrame:
    h = observations(spark, folder).rollup("scope", "verify_state").agg(F.count(F.lit(1)).alias("n"))
    return h.select(F.coalesce("scope", F.lit("*")).alias("scope"), F.coalesce("verify_state", F.lit("*")).alias("verify_state"), "n")


@R.add("missing_embeddings", O + "SELECT id, project FROM o WHERE deleted_at IS NULL AND id NOT IN (SELECT observation_id FROM observation_embedding_meta)")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "observation_embedding_meta").select(F.col("observation_id").alias("id"))
    return orphan_rows(observations(spark, folder, live_only=True), meta, ["id"]).select("id", "project")


@R.add("unextracted", O + "SELECT id FROM o WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '2025-06-01' AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.evidence_obs_id = o.id)")
def unextracted(spark: SparkSession, folder: str) -> DataFrame:
    """Live observations since a date that no fact cites."""
    o = observations(spark, folder, live_only=True).filter(F.col("created_at") >= F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")))
    return orphan_rows(o, table(spark, folder, "facts").select(F.col("evidence_obs_id").alias("id")), ["id"]).select("id")


@R.add("session_neighbors", O + """
SELECT a.id AS anchor, b.id FROM o a JOIN o b ON a.session_id = b.session_id AND b.id BETWEEN a.id - 2 AND a.id + 2
WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL AND a.type = 'decision'
""")  # fmt: skip
def session_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder, live_only=True).select("id", "session_id", "type")
    return near_keys(o.drop("type"), o.filter("type = 'decision'").select("id", "session_id"), "id", "session_id", 2).select("anchor", "id")


@R.add("cross_project_union", O + """
, d AS (SELECT 'observation' AS kind, project, id AS key, updated_at AS at_time FROM o WHERE deleted_at IS NULL
 UNION ALL SELECT 'document', project, doc_id, created_at FROM documents WHERE text IS NOT NULL)
SELECT kind, project, count(*) AS n, max(at_time) AS newest FROM d GROUP BY kind, project
""")  # fmt: skip
def cross_project_union(spark: SparkSession, folder: str) -> DataFrame:
    a = observations(spark, folder, live_only=True).select(F.lit("observation").alias("kind"), "project", F.col("id").alias("key"), F.col("updated_at").alias("at_time"))
    b = table(spark, folder, "documents").filter("text IS NOT NULL").select(F.lit("document").alias("kind"), "project", F.col("doc_id").alias("key"), F.col("created_at").alias("at_time"))
    return a.unionByName(b).groupBy("kind", "project").agg(F.count(F.lit(1)).alias("n"), F.max("at_time").alias("newest"))


@R.add("supersedes_list", O + """
SELECT n.id, count(*) AS n_older, string_agg(CAST(q.id AS VARCHAR), ',' ORDER BY q.id) AS older
FROM o n JOIN o q ON q.superseded_by_id = n.id GROUP BY n.id
""")  # fmt: skip
def supersedes_list(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that each observation directly supersedes; a node's direct list is part of its row by definition."""
    o = observations(spark, folder)
    g = o.filter("superseded_by_id IS NOT NULL").groupBy(F.col("superseded_by_id").alias("id")).agg(F.count(F.lit(1)).alias("n_older"), F.sort_array(F.collect_list("id")).alias("ids"))
    return g.join(o.select("id"), "id", "left_semi").select("id", "n_older", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("older"))


@R.add("embedding_drift", """
WITH m AS (SELECT DISTINCT observation_id, model, dim, quantized, scale FROM observation_embedding_meta), o AS (SELECT DISTINCT id, deleted_at FROM observations)
SELECT coalesce(model, '-') AS model, dim, count(*) AS rows_n, count(*) FILTER (quantized = 1) AS quantized_n,
       count(*) FILTER (o.id IS NULL) AS orphans, count(*) FILTER (o.deleted_at IS NOT NULL) AS deleted_n
FROM m LEFT JOIN o ON o.id = m.observation_id GROUP BY 1, 2
""")  # fmt: skip
def embedding_drift(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "observation_embedding_meta").select("observation_id", "model", "dim", "quantized", "scale").distinct()
    o = observations(spark, folder).select(F.col("id").alias("observation_id"), F.lit(True).alias("known"), "deleted_at")
    j = m.join(o, "observation_id", "left")
    return j.groupBy(F.coalesce("model", F.lit("-")).alias("model"), "dim").agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_if(F.col("quantized") == 1).alias("quantized_n"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted_n"),
    )


@R.add("health_drift", O + """
, x AS (SELECT (SELECT count(*) FROM o WHERE deleted_at IS NULL AND id NOT IN (SELECT observation_id FROM observation_embedding_meta)) AS missing_embeddings,
 (SELECT count(DISTINCT observation_id) FROM observation_embedding_meta WHERE observation_id NOT IN (SELECT id FROM o)) AS orphan_embeddings,
 (SELECT count(*) FROM o WHERE deleted_at IS NULL AND verify_state IN ('stale','invalidated')) AS stale_rows)
SELECT missing_embeddings, orphan_embeddings, stale_rows, missing_embeddings + orphan_embeddings + stale_rows AS drift, missing_embeddings + orphan_embeddings + stale_rows = 0 AS healthy FROM x
""")  # fmt: skip
def health_drift(spark: SparkSession, folder: str) -> DataFrame:
    o, m = observations(spark, folder), table(spark, folder, "observation_embedding_meta").select(F.col("observation_id").alias("id")).distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    a = one(live(o).join(m, "id", "left_anti"), "missing_embeddings")
    b = one(m.join(o, "id", "left_anti"), "orphan_embeddings")
    c = one(live(o).filter(F.col("verify_state").isin("stale", "invalidated")), "stale_rows")
    x = a.crossJoin(b).crossJoin(c)  # three frames of one row
    drift = F.col("missing_embeddings") + F.col("orphan_embeddings") + F.col("stale_rows")
    return x.withColumn("drift", drift).withColumn("healthy", F.col("drift") == 0)


@R.add("entity_kinds", """
WITH l AS (SELECT DISTINCT entity_id, fact_id FROM entity_links)
SELECT e.kind, count(DISTINCT e.entity_id) AS entities, count(l.fact_id) AS links FROM entities e LEFT JOIN l ON l.entity_id = e.entity_id GROUP BY e.kind
""")  # fmt: skip
def entity_kinds(spark: SparkSession, folder: str) -> DataFrame:
    n = links(spark, folder).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "entities").join(n, "entity_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


_MENTIONS = "WITH mentions AS (SELECT DISTINCT l.entity_id, f.evidence_obs_id AS observation_id FROM entity_links l JOIN facts f ON f.fact_id = l.fact_id WHERE f.evidence_obs_id IS NOT NULL), o AS (SELECT DISTINCT * FROM observations) "


@R.add("graph_coverage", _MENTIONS + """
SELECT project, count(*) AS live_n, count(*) FILTER (id IN (SELECT observation_id FROM mentions)) AS covered,
       round(count(*) FILTER (id IN (SELECT observation_id FROM mentions)) / count(*), 6) AS coverage
FROM o WHERE deleted_at IS NULL GROUP BY project
""")  # fmt: skip
def graph_coverage(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder).select(F.col("observation_id").alias("id"), F.lit(1).alias("hit")).distinct()
    j = observations(spark, folder, live_only=True).join(m, "id", "left")
    return j.groupBy("project").agg(F.count(F.lit(1)).alias("live_n"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("coverage"))


@R.add("seed_ranked_observations", _MENTIONS + """
SELECT observation_id, count(*) AS seeds FROM mentions WHERE entity_id IN (SELECT entity_id FROM entities WHERE kind = 'concept') GROUP BY 1
""")  # fmt: skip
def seed_ranked_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations by the number of seed entities (all concepts) they mention."""
    seeds = table(spark, folder, "entities").filter("kind = 'concept'").select("entity_id")
    return mentions(spark, folder).join(seeds, "entity_id", "left_semi").groupBy("observation_id").agg(F.count(F.lit(1)).alias("seeds"))


@R.add("fact_history", """
WITH f AS (SELECT DISTINCT * FROM facts),
r AS (SELECT *, row_number() OVER (PARTITION BY project, lower(subject), lower(predicate) ORDER BY extracted_at DESC, fact_id DESC) AS rn FROM f)
SELECT fact_id, project, subject, predicate, object FROM r WHERE rn = 1
""")  # fmt: skip
def fact_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest fact of each subject and predicate."""
    f = facts(spark, folder).select("project", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), "extracted_at", "fact_id", "subject", "predicate", "object")
    return latest(f, ["project", "s", "p"], ["extracted_at", "fact_id"]).select("fact_id", "project", "subject", "predicate", "object")


@R.add("facts_by_salience", """
WITH f AS (SELECT DISTINCT * FROM facts), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY salience DESC, fact_id DESC) AS rank FROM f)
SELECT project, fact_id, salience, rank FROM r WHERE rank <= 10
""")  # fmt: skip
def facts_by_salience(spark: SparkSession, folder: str) -> DataFrame:
    r = ranked(facts(spark, folder), ["project"], [F.desc("salience"), F.desc("fact_id")], 10)
    return r.select("project", "fact_id", "salience", "rank")


@R.add("content_hash", O + """
SELECT id, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS hash FROM o WHERE content IS NOT NULL
""")  # fmt: skip
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).filter("content IS NOT NULL").select("id", tx.content_hash(F.col("content")).alias("hash"))


_SLUG = "CASE WHEN {0} = '' THEN 'untitled' ELSE {0} END".format("regexp_replace(substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '')")


@R.add("slug_topic_key", O + f"""
, s AS (SELECT id, scope, {_SLUG} AS slug FROM o WHERE title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY scope, slug ORDER BY id) AS n FROM s)
SELECT id, scope, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS topic_key FROM r
""")  # fmt: skip
def slug_topic_key(spark: SparkSession, folder: str) -> DataFrame:
    """A suggested topic key for each observation; later ones of the same key get a number."""
    s = observations(spark, folder).filter("title IS NOT NULL").select("id", "scope", tx.slug(F.col("title")).alias("slug"))
    r = ranked(s, ["scope", "slug"], [F.col("id")], name="n")
    return r.select("id", "scope", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n"))).otherwise("")).alias("topic_key"))


@R.add("review_due", O + f"""
, d AS (SELECT id, type, created_at + CASE type WHEN 'decision' THEN INTERVAL 6 MONTH WHEN 'policy' THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END AS review_after
 FROM o WHERE deleted_at IS NULL AND type IN ('decision','policy','preference'))
SELECT id, type, review_after FROM d WHERE review_after <= TIMESTAMP '{NOW}'
""")  # fmt: skip
def review_due(spark: SparkSession, folder: str) -> DataFrame:
    """Observations due for review: months by type, the day clamped to the month's length."""
    o = observations(spark, folder, live_only=True).filter(F.col("type").isin("decision", "policy", "preference"))
    months = F.when(F.col("type") == "decision", 6).when(F.col("type") == "policy", 12).otherwise(3)
    due = F.col("created_at") + F.make_ym_interval(F.lit(0), months)
    return o.select("id", "type", due.alias("review_after")).filter(F.col("review_after") <= _now())


@R.add("event_windows", """
SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")  # fmt: skip
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling hours over the event stream's table."""
    e = table(spark, folder, "events").withColumn("window_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("event_type", "window_start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("job_queue_stats", """
SELECT event_type AS kind, count(*) AS total, count(*) FILTER (value > 50) AS large, min(ts) AS oldest, count(DISTINCT user_id) AS owners FROM events GROUP BY 1
""")  # fmt: skip
def job_queue_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("large"), F.min("ts").alias("oldest"), F.countDistinct("user_id").alias("owners"))


@R.add("anchor_prefix_lookup", """
SELECT kind, entity_id, norm_name FROM entities WHERE starts_with(norm_name, 'm') ORDER BY length(norm_name), entity_id LIMIT 25
""")  # fmt: skip
def anchor_prefix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities").filter(F.col("norm_name").startswith("m"))
    return e.orderBy(F.length("norm_name"), "entity_id").limit(25).select("kind", "entity_id", "norm_name")


@R.add("token_sizes", O + "SELECT project, count(*) AS n, sum(ceil(length(coalesce(type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,'')) / 4))::BIGINT AS tokens FROM o GROUP BY 1")
def token_sizes(spark: SparkSession, folder: str) -> DataFrame:
    o = observations(spark, folder).select("project", tx.token_estimate(F.col("type"), F.col("title"), F.col("content")).alias("t"))
    return o.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"))
