"""Queries p1, p4 and p7: hierarchies, change feeds and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.instants import instant
from lorekeep.operators.cdc import BucketTable
from lorekeep.operators.hierarchy import descendants, hierarchy
from lorekeep.operators.orphans import orphans
from lorekeep.plans.registry import Registry, table
from lorekeep.scratch import Scratch

R = Registry()

_LINEAGE = """
WITH RECURSIVE o AS (SELECT DISTINCT id, superseded_by_id AS ptr FROM observations WHERE id IS NOT NULL),
link AS (
  SELECT o.id, p.id AS parent FROM o LEFT JOIN o p ON p.id = o.ptr
  WHERE o.ptr IS NOT NULL OR o.id IN (SELECT ptr FROM o WHERE ptr IS NOT NULL)),
down AS (
  SELECT id, id AS root, 0::BIGINT AS depth, CAST(id AS VARCHAR) AS path FROM link WHERE parent IS NULL
  UNION ALL
  SELECT l.id, d.root, d.depth + 1, CAST(l.id AS VARCHAR) || '>' || d.path FROM link l JOIN down d ON l.parent = d.id)
"""

_RINGS = """
, rest AS (SELECT id, parent FROM link WHERE id NOT IN (SELECT id FROM down)),
walk AS (
  SELECT id AS start, parent AS pos, 1 AS n FROM rest
  UNION
  SELECT w.start, r.parent, least(w.n + 1, 2000) FROM walk w JOIN rest r ON r.id = w.pos WHERE w.n < (SELECT count(*) FROM rest)),
ring AS (SELECT DISTINCT start AS id FROM walk WHERE start = pos),
bad AS (SELECT start AS id, min(pos) AS root FROM walk WHERE pos IN (SELECT id FROM ring) GROUP BY start)
"""


@R.add("p1_found", _LINEAGE + _RINGS + """
SELECT id AS node_id, root AS root_id, depth FROM down
UNION ALL SELECT id, root, -1 FROM bad
""")  # fmt: skip
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(table(spark, folder, "observations"), "id", "superseded_by_id")
    return tree.select("node_id", "root_id", "depth")


@R.add("p1_lineage", _LINEAGE + _RINGS + """
, up AS (
  SELECT id AS node, id AS anc FROM link WHERE id IN (SELECT id FROM down)
  UNION ALL SELECT u.node, l.parent FROM up u JOIN link l ON l.id = u.anc WHERE l.parent IS NOT NULL)
SELECT d.id AS node_id, d.root AS root_id, d.depth, d.path, (SELECT count(*) - 1 FROM up WHERE anc = d.id) AS older, false AS circular FROM down d
UNION ALL SELECT id, root, -1, '', -1, true FROM bad
""")  # fmt: skip
def p1_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Each lineage observation with its path to the newest one and the number of older ones below it; on a circle no path and -1."""
    tree = hierarchy(table(spark, folder, "observations"), "id", "superseded_by_id", with_path=True)
    path, older = F.coalesce(F.array_join("path", ">"), F.lit("")), F.coalesce(F.col("subtree_size") - 1, F.lit(-1))
    return tree.select("node_id", "root_id", "depth", path.alias("path"), older.alias("older"), F.col("is_cycle").alias("circular"))


@R.add("p1_descendants", _LINEAGE + """
, up AS (
  SELECT id AS node, id AS anc, 0::BIGINT AS distance FROM link WHERE id IN (SELECT id FROM down)
  UNION ALL SELECT u.node, l.parent, u.distance + 1 FROM up u JOIN link l ON l.id = u.anc WHERE l.parent IS NOT NULL)
SELECT anc AS ancestor_id, node AS descendant_id, distance FROM up WHERE distance > 0
""")  # fmt: skip
def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(table(spark, folder, "observations"), "id", "superseded_by_id")
    return descendants(tree)


def observation_feed(changes: DataFrame) -> DataFrame:
    """The raw feed with its instants parsed; the columns that decide come first."""
    return changes.select(
        "sync_id", instant(F.col("updated_at")).alias("updated_at"), F.col("revision_count").cast("int").alias("revision_count"), "change_id",
        instant(F.col("deleted_at")).alias("deleted_at"), ((F.col("op") == "delete") | F.col("deleted_at").isNotNull()).alias("gone"),
        "project", "op", "title", "content",
    )


#: Commits in which a feed is applied by arrival.
COMMITS = 4


def current_state(spark: SparkSession, changes: DataFrame, batches: int = COMMITS, interleaved: bool = False) -> DataFrame:
    """The records that exist after all changes, applied in ``batches`` commits by arrival.

    The first commit fills the buckets, the later ones are routed to them and merged.
    Commits are equal stretches of feed positions, which a scan prunes, or, if
    ``interleaved``, every n-th stretch of 128 positions.
    """
    s = Scratch(spark, "changes")
    t = BucketTable(spark, f"{s.root}/observations", "sync_id", ["updated_at", "revision_count", "change_id"])
    lo, hi = changes.agg(F.min("feed_pos"), F.max("feed_pos")).first()
    if lo is not None:
        step = (hi - lo) // batches + 1
        for k in range(batches):
            stretch = F.pmod(F.shiftright("feed_pos", 7), F.lit(batches)) == k if interleaved else F.col("feed_pos").between(lo + k * step, lo + (k + 1) * step - 1)
            t.apply(observation_feed(changes.filter(stretch)))
    rows = t.history()
    if rows is None:
        return observation_feed(changes).limit(0).drop("gone")
    return rows.filter(~F.coalesce("gone", F.lit(False))).drop("gone")


_INSTANT = "CAST(CASE WHEN regexp_matches({0}[11:], '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN {0} ELSE {0} || '+00' END AS TIMESTAMPTZ)"
_WINNER = f"""
WITH w AS (
  SELECT *, row_number() OVER (PARTITION BY sync_id ORDER BY {_INSTANT.format("updated_at")} DESC, revision_count DESC, change_id DESC) AS rn
  FROM observation_changes)
"""


@R.add("p4_found", _WINNER + "SELECT sync_id, change_id FROM w WHERE rn = 1 AND op <> 'delete' AND deleted_at IS NULL")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return current_state(spark, table(spark, folder, "observation_changes")).select("sync_id", "change_id")


@R.add("p4_batches", _WINNER + f"""
SELECT sync_id, change_id, op, project, revision_count, title, content, epoch_us({_INSTANT.format("updated_at")}) AS updated_us
FROM w WHERE rn = 1 AND op <> 'delete' AND deleted_at IS NULL
""")  # fmt: skip
def p4_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The whole current rows after interleaved commits, each rewriting the buckets it touches."""
    rows = current_state(spark, table(spark, folder, "observation_changes"), interleaved=True)
    return rows.select("sync_id", "change_id", "op", "project", "revision_count", "title", "content", F.unix_micros("updated_at").alias("updated_us"))


def reference_rows(spark: SparkSession, folder: str) -> DataFrame:
    facts, links, meta = (table(spark, folder, t) for t in ("facts", "entity_links", "observation_embedding_meta"))

    def rows(df: DataFrame, name: str, parent: str, key: str, target: str, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), F.lit(parent).alias("parent"), F.col(key).cast("long").alias("src_key"), F.col(target).cast("long").alias("target"), F.col(at).alias("at"))

    out = rows(facts, "facts", "observations", "fact_id", "evidence_obs_id", "extracted_at")
    out = out.unionByName(rows(links, "entity_links", "facts", "entity_id", "fact_id", "linked_at"))
    return out.unionByName(rows(meta, "observation_embedding_meta", "observations", "observation_id", "observation_id", "created_at"))


def orphan_references(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan rows once each: src_table, src_key, target, at, reason."""
    live = table(spark, folder, "observations").filter("deleted_at IS NULL").select(F.col("id").alias("key"), F.col("created_at").alias("since"))
    facts = table(spark, folder, "facts").select(F.col("fact_id").alias("key"), F.col("extracted_at").alias("since"))
    found = orphans(reference_rows(spark, folder), {"observations": live, "facts": facts})
    return found.select("src_table", "src_key", "target", "at", "reason").distinct()


_REFS = """
WITH refs AS (
  SELECT 'facts' AS src_table, fact_id AS src_key, evidence_obs_id AS target, extracted_at AS moment FROM facts
  UNION SELECT 'entity_links', entity_id, fact_id, linked_at FROM entity_links
  UNION SELECT 'observation_embedding_meta', observation_id, observation_id, created_at FROM observation_embedding_meta),
parents AS (
  SELECT DISTINCT 'o' AS kind, id AS key, created_at AS since FROM observations WHERE deleted_at IS NULL
  UNION SELECT DISTINCT 'f', fact_id, extracted_at FROM facts),
bad AS (
  SELECT r.*, CASE WHEN p.key IS NULL THEN 'missing' ELSE 'later' END AS reason
  FROM refs r LEFT JOIN parents p ON p.key = r.target AND p.kind = CASE WHEN r.src_table = 'entity_links' THEN 'f' ELSE 'o' END
  WHERE r.target IS NOT NULL AND (p.key IS NULL OR p.since > r.moment))
"""


@R.add("p7_found", _REFS + "SELECT src_table, src_key, target AS target_id, strftime(moment, '%Y-%m') AS period FROM bad")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(spark, folder).select("src_table", "src_key", F.col("target").alias("target_id"), F.date_format("at", "yyyy-MM").alias("period"))


@R.add("p7_report", _REFS + """
SELECT src_table, strftime(moment, '%Y-%m') AS period, reason, count(*) AS orphans, count(DISTINCT target) AS targets
FROM bad GROUP BY ALL
""")  # fmt: skip
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month and reason."""
    rows = orphan_references(spark, folder).withColumn("period", F.date_format("at", "yyyy-MM"))
    return rows.groupBy("src_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("target").alias("targets"))
