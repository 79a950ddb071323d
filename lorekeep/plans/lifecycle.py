"""Queries over sessions, prompts, conflicts, anchors, snapshots, sync and contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.instants import instant
from lorekeep.operators import lifecycle as lc
from lorekeep.operators import memory as mem
from lorekeep.operators.context import newest_ranked, token_pack
from lorekeep.operators.relational import keyset_page, ranked
from lorekeep.plans.registry import TOKENS, Registry, table
from lorekeep.scratch import Scratch
from lorekeep.sources.memory import facts, links, mentions, observations

R = Registry()
O = "WITH o AS (SELECT DISTINCT * FROM observations) "  # noqa: E741
F_ = "WITH f AS (SELECT DISTINCT * FROM facts) "
NOW = "2026-01-01 00:00:00"
COLUMNS = ["id", "sync_id", "project", "session_id", "type", "scope", "title", "content", "topic_key", "normalized_hash", "verify_state", "created_by", "superseded_by_id", "revision_count", "created_at", "updated_at", "deleted_at"]


def _n():
    return F.count(F.lit(1))


# reads -------------------------------------------------------------------------
@R.add("project_turns", O + "SELECT project, session_id, id, title AS speaker, md5(content) AS said, row_number() OVER (PARTITION BY project, session_id ORDER BY created_at, id) AS turn FROM o WHERE deleted_at IS NULL AND session_id IS NOT NULL")
def project_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Live observations as turns of their sessions: who speaks, what is said, in order."""
    o = observations(spark, folder, live_only=True).filter("session_id IS NOT NULL")
    return ranked(o, ["project", "session_id"], [F.col("created_at"), F.col("id")], name="turn").select("project", "session_id", "id", F.col("title").alias("speaker"), F.md5("content").alias("said"), "turn")


@R.add("full_projection", O + "SELECT id, sync_id, project, session_id, type, scope, title, md5(content) AS content, topic_key, normalized_hash, verify_state, created_by, superseded_by_id, revision_count, created_at, updated_at FROM o WHERE deleted_at IS NULL ORDER BY created_at, id")
def full_projection(spark: SparkSession, folder: str) -> DataFrame:
    """All live rows with every column of the model, in order of creation."""
    o = observations(spark, folder, live_only=True, wide=True)
    return o.orderBy("created_at", "id").select(*[F.md5(c).alias(c) if c == "content" else c for c in COLUMNS if c != "deleted_at"])


@R.add("anchor_lookup", O + """
, m AS (SELECT DISTINCT l.entity_id, f.evidence_obs_id AS id FROM entity_links l JOIN facts f ON f.fact_id = l.fact_id), e AS (SELECT entity_id, name FROM entities WHERE kind = 'file' AND (name = 'anchor' OR starts_with(name, 'a')))
, j AS (SELECT DISTINCT o.id, o.updated_at FROM e JOIN m ON m.entity_id = e.entity_id JOIN o ON o.id = m.id WHERE o.deleted_at IS NULL) SELECT id, updated_at FROM j ORDER BY updated_at DESC, id DESC LIMIT 50
""")  # fmt: skip
def anchor_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Observations anchored at a path or below it, the newest first: a context by anchor."""
    e = table(spark, folder, "entities").filter("kind = 'file'").filter((F.col("name") == "anchor") | F.col("name").startswith("a")).select("entity_id")
    m = mentions(spark, folder).join(F.broadcast(e), "entity_id", "left_semi").select(F.col("observation_id").alias("id")).distinct()  # entities are a fixed table
    return keyset_page(observations(spark, folder, live_only=True).select("id", "updated_at").join(m, "id", "left_semi"), F.col("updated_at"), F.col("id"), None, 50)


def cursor_text(last_id, last_at):
    """The opaque token of a page: base64 without padding of a JSON object with version, last_id and last_created_at."""
    body = F.concat(F.lit('{"version":1,"last_id":'), last_id.cast("string"), F.lit(',"last_created_at":"'), F.date_format(last_at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('"}'))
    return F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "[=\r\n]+", "")


def parse_cursor(token):
    """(last_id, last_created_at) of a token; null if it is malformed or of another version."""
    padded = F.rpad(token, (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    body = F.when(token.rlike("^[A-Za-z0-9+/]+$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    c = F.from_json(body, "version int, last_id long, last_created_at string")
    return F.when((c["version"] == 1) & c["last_id"].isNotNull(), F.struct(c["last_id"].alias("last_id"), c["last_created_at"].try_cast("timestamp_ntz").alias("last_created_at")))


@R.add("page_cursors", O + """
, r AS (SELECT id, project, created_at, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY project) AS all_n FROM o WHERE deleted_at IS NULL)
SELECT project, id AS last_id, rtrim(to_base64(encode('{"version":1,"last_id":' || id || ',"last_created_at":"' || strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || '"}')), '=') AS token, true AS reads_back FROM r WHERE n = 20 AND all_n > 20
""")  # fmt: skip
def page_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The cursor behind each project's first page of 20, where there is more; a token reads back to what it was made of."""
    o = observations(spark, folder, live_only=True).select("id", "project", "created_at")
    more = o.groupBy("project").agg(_n().alias("all_n")).filter("all_n > 20").select("project")
    page = newest_ranked(o, ["project"]).filter("rank = 20").join(more, "project", "left_semi").withColumn("token", cursor_text(F.col("id"), F.col("created_at")))
    back = parse_cursor(F.col("token"))
    return page.select("project", F.col("id").alias("last_id"), "token", ((back["last_id"] == F.col("id")) & (back["last_created_at"] == F.col("created_at"))).alias("reads_back"))


@R.add("session_start", O + """
, a AS (SELECT project, 'recent' AS part, CAST(id AS VARCHAR) AS item, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rank FROM o WHERE deleted_at IS NULL),
t AS (SELECT project, topic_key, max((updated_at, id)) AS newest FROM o WHERE deleted_at IS NULL AND topic_key IS NOT NULL GROUP BY 1, 2), b AS (SELECT project, 'topic' AS part, topic_key AS item, row_number() OVER (PARTITION BY project ORDER BY newest DESC, topic_key) AS rank FROM t)
SELECT * FROM a WHERE rank <= 10 UNION ALL SELECT * FROM b WHERE rank <= 20
""")  # fmt: skip
def session_start(spark: SparkSession, folder: str) -> DataFrame:
    """What a session of a project begins with: its ten newest observations and its twenty topics that changed last."""
    o = observations(spark, folder, live_only=True).select("project", "id", "created_at", "updated_at", "topic_key")
    a = ranked(o, ["project"], [F.desc("created_at"), F.desc("id")], 10).select("project", F.lit("recent").alias("part"), F.col("id").cast("string").alias("item"), "rank")
    t = o.filter("topic_key IS NOT NULL").groupBy("project", "topic_key").agg(F.max(F.struct("updated_at", "id")).alias("newest"))
    b = ranked(t, ["project"], [F.desc("newest"), F.col("topic_key")], 20).select("project", F.lit("topic").alias("part"), F.col("topic_key").alias("item"), "rank")
    return a.unionByName(b)


_SIZE = "ceil(length(coalesce(type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,'')) / 4)::BIGINT"
# Names of context windows and their tokens.
WINDOWS = {"8k": 8_000, "32k": 32_000, "128k": 128_000, "200k": 200_000, "1m": 1_000_000}


@R.add("context_windows", O + f"""
, s AS (SELECT project, sum({_SIZE}) OVER (PARTITION BY project ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM o WHERE deleted_at IS NULL),
w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in WINDOWS.items())}) v(win, room)) SELECT project, win, count(*) AS notes, max(upto) AS tokens FROM s JOIN w ON upto <= room GROUP BY 1, 2
""")  # fmt: skip
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """How many of each project's newest observations a context of each named size holds."""
    o = observations(spark, folder, live_only=True)
    day = -F.datediff(F.col("created_at"), F.lit("1970-01-01").cast("date"))
    s = token_pack(o, ["project"], day, [F.desc("created_at"), F.desc("id")], tx.token_estimate(F.col("type"), F.col("title"), F.col("content")), max(WINDOWS.values()))
    win = F.explode(F.array(*[F.struct(F.lit(k).alias("win"), F.lit(v).alias("room")) for k, v in WINDOWS.items()]))
    w = s.select("project", "tokens_after", win.alias("w")).filter(F.col("tokens_after") <= F.col("w.room"))
    return w.groupBy("project", "w.win").agg(_n().alias("notes"), F.max("tokens_after").alias("tokens"))


@R.add("observation_detail", O + """
, f AS (SELECT evidence_obs_id AS id, count(*) AS facts, count(DISTINCT lower(subject)) AS subjects FROM (SELECT DISTINCT * FROM facts) GROUP BY 1), m AS (SELECT id, count(*) AS entities FROM (SELECT DISTINCT l.entity_id, f.evidence_obs_id AS id FROM entity_links l JOIN facts f ON f.fact_id = l.fact_id) GROUP BY 1),
p AS (SELECT id, count(*) AS relations FROM (SELECT DISTINCT unnest([keep_id, drop_id]) AS id, proposal_id FROM dream_proposals WHERE keep_id <> drop_id) GROUP BY 1), h AS (SELECT superseded_by_id AS id, count(*) AS older FROM o GROUP BY 1), v AS (SELECT DISTINCT observation_id AS id FROM observation_embedding_meta)
SELECT o.id, coalesce(facts, 0) AS facts, coalesce(subjects, 0) AS subjects, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, coalesce(older, 0) AS older, v.id IS NOT NULL AS embedded
FROM o LEFT JOIN f ON f.id = o.id LEFT JOIN m ON m.id = o.id LEFT JOIN p ON p.id = o.id LEFT JOIN h ON h.id = o.id LEFT JOIN v ON v.id = o.id WHERE o.deleted_at IS NULL
""")  # fmt: skip
def observation_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that hangs on each live observation, counted."""
    f = facts(spark, folder).groupBy(F.col("evidence_obs_id").alias("id")).agg(_n().alias("facts"), F.countDistinct(F.lower("subject")).alias("subjects"))
    m = mentions(spark, folder).groupBy(F.col("observation_id").alias("id")).agg(_n().alias("entities"))
    p = table(spark, folder, "dream_proposals").distinct().filter("keep_id <> drop_id").select(F.explode(F.array("keep_id", "drop_id")).alias("id")).groupBy("id").agg(_n().alias("relations"))
    h = observations(spark, folder).filter("superseded_by_id IS NOT NULL").groupBy(F.col("superseded_by_id").alias("id")).agg(_n().alias("older"))
    v = table(spark, folder, "observation_embedding_meta").select(F.col("observation_id").alias("id"), F.lit(True).alias("embedded")).distinct()
    j = reduce(lambda a, b: a.join(b, "id", "left"), [f, m, p, h, v], observations(spark, folder, live_only=True).select("id"))
    return j.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "subjects", "entities", "relations", "older")], F.coalesce("embedded", F.lit(False)).alias("embedded"))


# writes ------------------------------------------------------------------------
@R.add("title_conflicts", O + f"""
, t AS (SELECT id, type, scope, created_at, {TOKENS.format("title")} AS t, ' ' || array_to_string({TOKENS.format("title")}, ' ') || ' ' AS ti FROM o WHERE deleted_at IS NULL),
j AS (SELECT a.id, a.type, b.id AS earlier, row_number() OVER (PARTITION BY a.id ORDER BY len(b.t), b.created_at, b.id) AS rn FROM t a JOIN t b ON b.type = a.type AND b.scope = a.scope AND (b.created_at, b.id) < (a.created_at, a.id) AND contains(b.ti, a.ti) WHERE len(a.t) > 0 AND len(b.t) > 0)
SELECT id, earlier, CASE WHEN type IN ('decision', 'policy') THEN 'supersede' ELSE 'conflicts_with' END AS action FROM j WHERE rn = 1
""")  # fmt: skip
def title_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier live observation that each new one's title probe meets, and what happens without a judge."""
    return lc.title_probe(observations(spark, folder, live_only=True))


@R.add("session_fold", O + """
SELECT session_id, arg_min(project, (created_at, id)) AS directory, min(created_at) AS started_at, max(updated_at) AS ended_at, arg_max(title, (created_at, id)) FILTER (type = 'summary' AND title IS NOT NULL) AS summary FROM o WHERE session_id IS NOT NULL GROUP BY 1
""")  # fmt: skip
def session_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions folded from their observations: start, end and the newest summary."""
    o = observations(spark, folder).select("session_id", F.col("created_at").alias("at"), F.col("id").alias("seq"), F.col("project").alias("directory"), F.col("updated_at").alias("ended_at"), F.when(F.col("type") == "summary", F.col("title")).alias("summary"))
    return lc.fold_sessions(o)


@R.add("prompt_saves", """
WITH d AS (SELECT sha256(text) AS sync_id, doc_id, created_at FROM documents WHERE trim(text) <> '' AND lower(trim(replace(source, '-', '_'))) = 'prompt_log'), r AS (SELECT *, row_number() OVER (PARTITION BY sync_id ORDER BY created_at, doc_id) AS rn FROM d)
SELECT sync_id, doc_id, created_at FROM r WHERE rn = 1
""")  # fmt: skip
def prompt_saves(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts saved once each, by the hash of their text; blank ones are refused."""
    d = table(spark, folder, "documents").filter(F.lower(F.trim(F.regexp_replace("source", "-", "_"))) == "prompt_log").select("doc_id", "created_at", F.sha2("text", 256).alias("sync_id"), F.substring(F.trim("text"), 1, 1).alias("begins"))
    return lc.prompts_once(d, "sync_id", "begins", ["created_at", "doc_id"]).select("sync_id", "doc_id", "created_at")


_VERDICT = "CASE WHEN confidence IS NULL THEN 'unsure' WHEN kind = 'duplicate' THEN 'KEEP_NEW' WHEN confidence < 0.3 THEN 'keep_old' WHEN confidence < 0.6 THEN 'keep_both' ELSE 'synthesize' END"


@R.add("verdict_effects", f"""
WITH v AS (SELECT drop_id AS old_id, keep_id AS new_id, lower({_VERDICT}) AS action FROM (SELECT DISTINCT * FROM dream_proposals) WHERE keep_id <> drop_id),
e AS (SELECT old_id AS id, true AS deleted, new_id AS by_id FROM v WHERE action = 'keep_new' UNION ALL SELECT new_id, true, old_id FROM v WHERE action = 'keep_old' UNION ALL SELECT unnest([old_id, new_id]), false, NULL FROM v WHERE action = 'synthesize')
SELECT id, count(*) AS verdicts, bool_or(deleted) AS deleted, coalesce(min(by_id), -1) AS resolved_by FROM e GROUP BY 1
""")  # fmt: skip
def verdict_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Judges' answers, as text with chatter around an object, read and applied to the observations they are about."""
    p = table(spark, folder, "dream_proposals").distinct().filter("keep_id <> drop_id")
    answer = F.concat(F.lit("Verdict: "), F.to_json(F.struct(F.expr(_VERDICT).alias("action"), F.col("confidence"))), F.lit(" - done"))
    v = p.select(F.col("drop_id").alias("old_id"), F.col("keep_id").alias("new_id"), lc.parse_verdict(answer).alias("v")).filter("v IS NOT NULL").select("old_id", "new_id", "v.action")
    g = lc.apply_verdicts(v).groupBy("id")
    return g.agg(_n().alias("verdicts"), F.bool_or("deleted").alias("deleted"), F.coalesce(F.min("resolved_by"), F.lit(-1)).alias("resolved_by"))


@R.add("embedding_upsert", """
SELECT observation_id, arg_max(model, (created_at, dim)) AS model, arg_max(dim, (created_at, dim)) AS dim, max(created_at) AS created_at, count(DISTINCT created_at) AS writes FROM observation_embedding_meta WHERE model IS NOT NULL GROUP BY 1
""")  # fmt: skip
def embedding_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written again: the newest write of an observation holds."""
    m = table(spark, folder, "observation_embedding_meta").filter("model IS NOT NULL")
    seq = F.struct("created_at", "dim")
    return m.groupBy("observation_id").agg(F.max_by("model", seq).alias("model"), F.max_by("dim", seq).alias("dim"), F.max("created_at").alias("created_at"), F.countDistinct("created_at").alias("writes"))


@R.add("job_counts", """
WITH j AS (SELECT user_id, event_type AS kind, arg_max(event_type, (ts, event_id)) AS last, count(*) AS attempts, min(ts) AS first_ts FROM events GROUP BY 1, 2), s AS (SELECT kind, CASE WHEN kind = 'error' AND attempts >= 5 THEN 'dead' WHEN kind = 'error' THEN 'pending' WHEN kind = 'purchase' THEN 'completed' ELSE 'running' END AS status, first_ts FROM j)
SELECT kind, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'dead') AS dead, min(first_ts) FILTER (status IN ('pending', 'running')) AS oldest_open FROM s GROUP BY 1
""")  # fmt: skip
def job_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs (a user and a kind) by status, and since when the oldest open one waits; attempts of one job are deduplicated."""
    j = table(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(_n().alias("attempts"), F.min("ts").alias("first_ts"))
    err = F.col("kind") == "error"
    s = j.withColumn("status", F.when(err & (F.col("attempts") >= 5), "dead").when(err, "pending").when(F.col("kind") == "purchase", "completed").otherwise("running"))
    counts = [F.count_if(F.col("status") == x).alias(x) for x in ("pending", "running", "completed", "dead")]
    return s.groupBy("kind").agg(*counts, F.min(F.when(F.col("status").isin("pending", "running"), F.col("first_ts"))).alias("oldest_open"))


# anchors -----------------------------------------------------------------------
_FILE_LINES = "string_split(CASE WHEN ends_with(x, chr(10)) THEN x[:-2] ELSE x END, chr(10))"


@R.add("slice_digests", f"""
WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, x, {_FILE_LINES} AS ls FROM d)
SELECT doc_id, sha256(array_to_string(ls[2:least(4, len(ls))], chr(10))) AS part, sha256(x) AS whole FROM l
""")  # fmt: skip
def slice_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of lines 2 to 4 and of the whole of each document, line ends aside."""
    place = lambda lo, hi: F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(lo).cast("int").alias("line_start"), F.lit(hi).cast("int").alias("line_end"))
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", tx.slice_digest(F.col("text"), place(2, 4)).alias("part"), tx.slice_digest(F.col("text"), place(None, None)).alias("whole"))


@R.add("anchor_verify", f"""
WITH d AS (SELECT doc_id, project, text IS NOT NULL AS there, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents),
v AS (SELECT project, doc_id, CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE CASE WHEN NOT there THEN 4 WHEN doc_id % 7 = 3 THEN 3 WHEN doc_id % 7 = 4 THEN 2 WHEN doc_id % 7 = 5 THEN 1 ELSE 2 END END AS k,
 CASE doc_id % 7 WHEN 0 THEN 'no anchor_commit' WHEN 1 THEN 'at head' WHEN 2 THEN 'path unchanged' ELSE CASE WHEN NOT there THEN 'file absent at head' WHEN doc_id % 7 = 3 THEN 'symbol missing' WHEN doc_id % 7 = 4 THEN 'path changed, no digest' WHEN doc_id % 7 = 5 THEN 'digest unchanged' ELSE 'digest changed' END END AS reason FROM d),
r AS (SELECT project, k, reason, row_number() OVER (PARTITION BY project ORDER BY k DESC, 'doc/' || doc_id) AS rn FROM v) SELECT project, ['unanchored','verified','stale','invalidated','unprovable'][k + 1] AS state, reason FROM r WHERE rn = 1
""")  # fmt: skip
def anchor_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The worst state of each project's anchors: documents as files, their anchors made in seven ways by id so that every rule is met."""
    d = table(spark, folder, "documents").select("doc_id", "project", "text", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.pmod("doc_id", F.lit(7)).alias("way"))
    way, none = F.col("way"), F.lit(None)
    place = F.struct(none.cast("string").alias("symbol"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    digest = F.when(way == 5, tx.slice_digest(F.col("text"), place)).when(way == 6, F.sha2(F.lit("other"), 256))
    a = d.select(
        F.col("project").alias("observation_id"), "path", F.when(way == 3, F.lit("no_such_symbol_here")).alias("symbol"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"),
        F.when(way == 1, "head").when(way > 1, "base").alias("anchor_commit"), digest.alias("content_digest"),
    )
    changed = d.filter("way > 2").select(F.lit("base").alias("anchor_commit"), "path")
    return lc.verify_anchors(a, "head", changed, d.filter("text IS NOT NULL").select("path", "text")).withColumnRenamed("observation_id", "project")


# entities of facts -------------------------------------------------------------
_ETERMS = "list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}'']+'), lambda x: strlen(x) >= 3), lambda x: lower(x)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in tx.ENTITY_STOP_WORDS) + ")))"


@R.add("fact_entities", F_ + f", t AS (SELECT fact_id, salience, unnest({_ETERMS.format('subject || chr(32) || object')}) AS name FROM f) SELECT name, count(*) AS links, min(fact_id) AS first_fact, bool_or(salience >= 0.85) AS routed FROM t GROUP BY 1")
def fact_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names found in facts without a model, upserted and linked; facts of salience 0.85 or more would go to one."""
    t = facts(spark, folder).select("fact_id", "salience", F.explode(tx.entity_terms(F.concat("subject", F.lit(" "), "object"))).alias("name"))
    return t.groupBy("name").agg(_n().alias("links"), F.min("fact_id").alias("first_fact"), F.bool_or(F.col("salience") >= 0.85).alias("routed"))


@R.add("chain_scores", F_ + """
, l AS (SELECT DISTINCT entity_id, fact_id FROM entity_links), x AS (SELECT f.evidence_obs_id AS id, count(DISTINCT lower(f.predicate)) AS covered, count(DISTINCT l.entity_id) AS overlap, bool_or(f.temporal IS NOT NULL) AS timed, count(DISTINCT f.source_session) AS sources FROM f LEFT JOIN l ON l.fact_id = f.fact_id WHERE f.evidence_obs_id IS NOT NULL GROUP BY 1)
SELECT id, covered * 10 + overlap * 3 + CASE WHEN timed THEN 4 ELSE -8 END + least(sources, 5) AS score FROM x
""")  # fmt: skip
def chain_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How strong a chain of evidence the facts of each observation make."""
    f = facts(spark, folder).filter("evidence_obs_id IS NOT NULL").join(links(spark, folder), "fact_id", "left")
    g = f.groupBy(F.col("evidence_obs_id").alias("id")).agg(F.countDistinct(F.lower("predicate")).alias("covered"), F.countDistinct("entity_id").alias("overlap"), F.bool_or(F.col("temporal").isNotNull()).alias("timed"), F.countDistinct("source_session").alias("sources"))
    return g.select("id", tx.chain_score(F.col("covered"), F.col("overlap"), F.col("timed"), F.col("sources")).alias("score"))


@R.add("skip_tolerance", """
WITH n AS (SELECT user_id % 50 AS run, count(*) AS asked, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY 1) SELECT run, asked, skipped, skipped > 0 AND skipped > greatest(asked * 1 // 100, 1) AS refused FROM n
""")  # fmt: skip
def skip_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation runs (here: users by number) whose skipped questions exceed one in a hundred, one always being allowed."""
    g = table(spark, folder, "events").groupBy(F.pmod("user_id", F.lit(50)).alias("run")).agg(_n().alias("asked"), F.count_if(F.col("event_type") == "error").alias("skipped"))
    return g.withColumn("refused", (F.col("skipped") > 0) & (F.col("skipped") > F.greatest(F.floor(F.col("asked") / 100), F.lit(1))))


# sync and snapshots ------------------------------------------------------------
_TS = "CAST(CASE WHEN regexp_matches(updated_at[11:], '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN updated_at ELSE updated_at || '+00' END AS TIMESTAMPTZ)"


@R.add("sync_round_trip", f"""
WITH c AS (SELECT sync_id, title, epoch_us({_TS}) AS t, change_id, feed_pos % 2 AS side FROM observation_changes WHERE sync_id IS NOT NULL), w AS (SELECT *, row_number() OVER (PARTITION BY side, sync_id ORDER BY t DESC, change_id DESC) AS rn FROM c),
a AS (SELECT sync_id, title, t FROM w WHERE rn = 1 AND side = 0), b AS (SELECT sync_id, title, t FROM w WHERE rn = 1 AND side = 1)
SELECT coalesce(a.sync_id, b.sync_id) AS sync_id, CASE WHEN a.t IS NULL OR b.t > a.t THEN b.title ELSE a.title END AS title, CASE WHEN a.t IS NULL OR b.t > a.t THEN b.t ELSE a.t END AS updated_us, CASE WHEN a.t IS NULL THEN 'insert' WHEN b.t IS NULL THEN 'local_only' WHEN b.t > a.t THEN 'overwrite' ELSE 'keep' END AS outcome
FROM a FULL JOIN b ON a.sync_id = b.sync_id
""")  # fmt: skip
def sync_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """One side's rows written as content-addressed chunks with a manifest, read on the other side, where the newer row wins.

    The import sees a corrupt copy of a chunk too, which is refused, and a second
    import of the same manifest, which brings nothing.
    """
    from lorekeep.sources.chunks import chunk_ids, export_chunks, import_chunks

    s = Scratch(spark, "sync")
    c = table(spark, folder, "observation_changes").filter("sync_id IS NOT NULL").select("sync_id", "title", F.unix_micros(instant(F.col("updated_at"))).alias("t"), "change_id", F.pmod("feed_pos", F.lit(2)).alias("side"))
    newest = lambda n: c.filter(F.col("side") == n).groupBy("sync_id").agg(F.max_by(F.struct("title", "t"), F.struct("t", "change_id")).alias("r")).select("sync_id", "r.*")
    local, remote = newest(0), newest(1)
    lines = remote.select(F.pmod(F.xxhash64("sync_id"), F.lit(64)).alias("part_of"), F.xxhash64("sync_id").alias("k"), F.to_json(F.struct(F.lit("observation").alias("_kind"), "sync_id", "title", "t")).alias("line"))
    chunks = s.save(chunk_ids(lines, ["part_of"], "k", "line", bits=63).select("chunk_id", "lines", "body"))
    manifest = s.save(export_chunks(chunks, f"{s.root}/chunks"))
    broken = chunks.limit(1).select(F.concat(F.lit("broken"), "chunk_id").alias("chunk_id"), F.lit('{"_kind": "observation", "sync_id": ').alias("body"))
    broken.write.mode("append").option("compression", "gzip").json(f"{s.root}/chunks")
    schema = "_kind string, sync_id string, title string, t long"
    got = s.save(import_chunks(spark, f"{s.root}/chunks", schema).filter("_kind = 'observation'").select("sync_id", "title", "t"))
    again = import_chunks(spark, f"{s.root}/chunks", schema, manifest).select("sync_id", "title", "t")
    return mem.merged_rows(local, got.unionByName(again), "sync_id", "t").withColumnRenamed("t", "updated_us")


@R.add("snapshot_merge", O + """
, t AS (SELECT id, sync_id FROM o WHERE id % 3 <> 0), s AS (SELECT id AS source_id, sync_id FROM o WHERE id % 2 = 0), top AS (SELECT max(id) AS m FROM t), j AS (SELECT s.source_id, t.id FROM s LEFT JOIN t ON t.sync_id = s.sync_id),
n AS (SELECT source_id, id, 'kept' AS outcome FROM j WHERE id IS NOT NULL UNION ALL SELECT source_id, m + row_number() OVER (ORDER BY source_id), 'added' FROM j, top WHERE id IS NULL)
SELECT f.fact_id, n.source_id, n.id AS observation_id, n.outcome FROM n JOIN (SELECT DISTINCT fact_id, evidence_obs_id FROM facts) f ON f.evidence_obs_id = n.source_id
""")  # fmt: skip
def snapshot_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A dump of some observations with their facts merged into a table that has part of them: facts follow their observation to its id there."""
    s = Scratch(spark, "snapshot")
    o = observations(spark, folder).select("id", "sync_id")
    dump, held = s.save(o.filter("id % 2 = 0")), o.filter("id % 3 <> 0")  # the two sides of the test overlap; together they are the dump and the table
    ids = s.save(lc.merge_snapshot(held, dump, "id", "sync_id"))
    f = facts(spark, folder).select("fact_id", F.col("evidence_obs_id").alias("source_id"))
    return f.join(ids, "source_id").select("fact_id", "source_id", F.col("id").alias("observation_id"), "outcome")


@R.add("global_mirror", O + "SELECT project, count(*) FILTER (deleted_at IS NULL) AS mirrored, count(*) FILTER (deleted_at IS NOT NULL) AS cleared, max(updated_at) FILTER (deleted_at IS NULL) AS newest FROM o GROUP BY 1")
def global_mirror(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the mirror over all projects: rows that it shows and rows that were taken out."""
    live = F.col("deleted_at").isNull()
    return observations(spark, folder).groupBy("project").agg(F.count_if(live).alias("mirrored"), F.count_if(~live).alias("cleared"), F.max(F.when(live, F.col("updated_at"))).alias("newest"))


# streams -----------------------------------------------------------------------
@R.add("stream_saves", """
WITH o AS (SELECT DISTINCT id, topic_key, scope, created_at FROM observations WHERE topic_key IS NOT NULL AND scope IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY scope, topic_key ORDER BY created_at, id) AS n, first_value(id) OVER (PARTITION BY scope, topic_key ORDER BY created_at, id) AS first_id FROM o)
SELECT id, first_id, n AS revision, CASE WHEN n = 1 THEN 'inserted' ELSE 'topic_update' END AS outcome FROM r
""")  # fmt: skip
def stream_saves(spark: SparkSession, folder: str) -> DataFrame:
    """Saves as a stream with state: each topic of a scope remembers its row and how often it was saved."""
    from lorekeep.streaming.saves import topic_outcomes
    from lorekeep.streaming.windows import run_to_table, table_stream

    o = table_stream(spark, folder, "observations").filter("topic_key IS NOT NULL AND scope IS NOT NULL").select("id", "topic_key", "scope", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    return run_to_table(topic_outcomes(o), "append", keep_all=True)


@R.add("stream_embeddings", O + """
, k AS (SELECT id, sha256(title || ' ' || content) AS cache_key FROM o WHERE deleted_at IS NULL AND title IS NOT NULL AND content IS NOT NULL), c AS (SELECT DISTINCT cache_key FROM embedding_cache WHERE octet_length(payload) IN (1536, 3072)) SELECT k.id, k.cache_key, c.cache_key IS NOT NULL AS from_cache FROM k LEFT JOIN c ON c.cache_key = k.cache_key
""")  # fmt: skip
def stream_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The embed worker as a stream: each batch takes from the cache what is there and leaves the rest to a model."""
    from lorekeep.streaming.saves import cached_first
    from lorekeep.streaming.windows import table_stream

    cache = table(spark, folder, "embedding_cache").filter(F.octet_length("payload").isin(1536, 3072)).select("cache_key").distinct()
    o = table_stream(spark, folder, "observations").filter("deleted_at IS NULL AND title IS NOT NULL AND content IS NOT NULL").select("id", F.sha2(F.concat("title", F.lit(" "), "content"), 256).alias("cache_key"))
    return cached_first(o, cache).distinct()
