"""Sessions, prompts, conflicts, verdicts, anchors and snapshots as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import locates, object_slice, slice_digest, state_of, state_rank, tokens
from lorekeep.operators.prefix import block_prefix_sum

# Types of which a new row with the same title supersedes the old one without a judge.
SUPERSEDING = ["decision", "policy"]
#: Rows that a window of new numbers may hold on average.
NUMBER_BLOCK = 50_000


def fold_sessions(events: DataFrame) -> DataFrame:
    """One row a session_id: directory and start of the first event, the latest end, the summary that came last (null ones change nothing).

    ``events``: session_id, at, seq (a total order), directory, ended_at, summary.
    """
    e = events.filter("session_id IS NOT NULL")
    last = F.max_by("summary", F.when(F.col("summary").isNotNull(), F.struct("at", "seq")))
    return e.groupBy("session_id").agg(F.min_by("directory", F.struct("at", "seq")).alias("directory"), F.min("at").alias("started_at"), F.max("ended_at").alias("ended_at"), last.alias("summary"))


def prompts_once(prompts: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """The first row of each ``key``; blank texts are refused, null keys left out."""
    p = prompts.filter((F.trim(text) != "") & F.col(key).isNotNull())
    rest = [c for c in p.columns if c != key]
    return p.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def title_probe(df: DataFrame, few: int = 200_000) -> DataFrame:
    """(id, earlier, action): the best earlier row of equal type and scope whose title holds the row's title as a phrase.

    All such rows hold the same phrase, so the best by BM25 is the one of the shortest
    title (ties: the earlier one). ``action`` is supersede for single-valued types, else
    conflicts_with. ``df``: id, type, scope, title, created_at. Rows without tokens in
    their title ask for nothing. Titles meet by their phrase's first three words.
    """
    o = df.select("id", "type", "scope", F.struct("created_at", "id").alias("at"), tokens(F.col("title")).alias("t")).filter(F.size("t") > 0)
    start = lambda words: F.xxhash64("type", "scope", F.array_join(words, " "))
    runs = lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: start(F.slice("t", i, n))))
    every = F.concat(*[F.coalesce(runs(n), F.array().cast("array<bigint>")) for n in (1, 2, 3)])
    # equal titles ask once: a title that a third of all rows share is one question
    asked = o.groupBy("type", "scope", "t").agg(F.min(F.lit(1)).alias("one")).withColumn("start", start(F.slice("t", 1, 3)))
    known = asked.select("start").distinct()
    at = o.select("id", "at", "t", F.explode(F.array_distinct(every)).alias("start")).join(F.broadcast(known) if known.count() <= few else known, "start", "left_semi")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    # of equal titles the first one is the earlier one of all others
    first = at.groupBy("start", "t").agg(F.min("at").alias("at"))
    meets = asked.alias("a").join(first.alias("b"), F.col("a.start") == F.col("b.start")).filter(F.contains(padded("b.t"), padded("a.t")))
    holders = meets.select("a.type", "a.scope", F.col("a.t").alias("t"), F.size("b.t").alias("n"), F.col("b.at").alias("held_at"))
    j = o.join(holders, ["type", "scope", "t"]).filter(F.col("held_at") < F.col("at"))
    g = j.groupBy("id", "type").agg(F.min(F.struct("n", "held_at")).alias("best"))
    return g.select("id", F.col("best.held_at.id").alias("earlier"), F.when(F.col("type").isin(SUPERSEDING), "supersede").otherwise("conflicts_with").alias("action"))


def parse_verdict(text: Column) -> Column:
    """(action, statement, confidence) of a judge's answer, with defaults; null without an object or with an unknown action."""
    v = F.from_json(object_slice(text), "action string, statement string, confidence double")
    action = F.lower(v["action"])
    parsed = F.struct(action.alias("action"), F.trim(F.coalesce(v["statement"], F.lit(""))).alias("statement"), F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"))
    return F.when(action.isin("keep_new", "keep_old", "keep_both", "synthesize"), parsed)


def apply_verdicts(verdicts: DataFrame) -> DataFrame:
    """(id, deleted, resolved_by): what verdicts on (old_id, new_id, action) do to observations; resolved_by is null for a text still to be saved."""
    v = verdicts.filter(F.col("action").isin("keep_new", "keep_old", "synthesize"))
    none = F.lit(None).cast("long")
    hit = lambda c, gone, by: F.struct(F.col(c).alias("id"), F.lit(gone).alias("deleted"), by.alias("resolved_by"))
    both = F.array(hit("old_id", False, none), hit("new_id", False, none))
    effect = F.when(F.col("action") == "keep_new", F.array(hit("old_id", True, F.col("new_id")))).when(F.col("action") == "keep_old", F.array(hit("new_id", True, F.col("old_id")))).otherwise(both)
    return v.select(F.explode(effect).alias("e")).select("e.*")


def verify_anchors(anchors: DataFrame, head: str, changed: DataFrame, files: DataFrame) -> DataFrame:
    """(observation_id, state, reason): the worst state of an observation's anchors at ``head``; of equally bad ones the first by path.

    ``anchors``: observation_id, path, symbol, line_start, line_end, anchor_commit,
    content_digest. ``changed``: anchor_commit and path of what changed since then.
    ``files``: path and text at head. A file that is missing has no row.
    """
    hit = changed.select("anchor_commit", "path", F.lit(True).alias("touched")).distinct()
    j = anchors.join(hit, ["anchor_commit", "path"], "left").join(files.select("path", F.col("text").alias("__text")), "path", "left")
    place = F.struct("path", "symbol", "line_start", "line_end")
    say = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(F.col("anchor_commit").isNull(), say("unanchored", "no anchor_commit"))
        .when(F.col("anchor_commit") == head, say("verified", "at head"))
        .when(F.col("touched").isNull(), say("verified", "path unchanged"))
        .when(F.col("__text").isNull(), say("unprovable", "file absent at head"))
        .when(F.col("symbol").isNotNull() & ~locates(F.col("__text"), F.col("symbol")), say("invalidated", "symbol missing"))
        .when(F.col("content_digest").isNull(), say("stale", "path changed, no digest"))
        .when(slice_digest(F.col("__text"), place) == F.col("content_digest"), say("verified", "digest unchanged"))
        .otherwise(say("stale", "digest changed"))
    )
    v = j.select("observation_id", "path", verdict.alias("v")).select("observation_id", "path", state_rank(F.col("v.state")).alias("k"), "v.reason")
    worst = v.groupBy("observation_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "path", "reason")).alias("w"))
    return worst.select("observation_id", state_of(-F.col("w.k")).alias("state"), "w.reason")


def number_rows(df: DataFrame, order: str, after: Column, out: str) -> DataFrame:
    """Adds ``out``: ``after`` + 1, + 2, ... in the order of a whole-number column, without one task for all rows."""
    bits = max(0, (df.count() // NUMBER_BLOCK).bit_length())
    span = df.agg((F.max(order) - F.min(order) + 1).alias("n"), F.min(order).alias("lo")).first()
    width = max(1, -(-(span["n"] or 1) // (1 << bits)))
    rows = block_prefix_sum(df, [], F.floor((F.col(order) - F.lit(span["lo"] or 0)) / width), [F.col(order)], F.lit(1), out)
    return rows.withColumn(out, after + F.col(out) + 1)


def merge_snapshot(target: DataFrame, source: DataFrame, key: str, natural: str) -> DataFrame:
    """(source id, id, outcome) of a snapshot's rows merged into a table.

    A row whose natural key the target has keeps the target's id (``kept``); others get
    new ids behind the target's largest, in the order of their own (``added``).
    """
    ids = target.select(F.col(natural), F.col(key).alias("id"))
    src = source.select(F.col(natural), F.col(key).alias("source_id"))
    j = src.join(ids, natural, "left")
    top = target.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    new = number_rows(j.filter("id IS NULL").drop("id"), "source_id", F.lit(top), "id")
    return j.filter("id IS NOT NULL").select("source_id", "id", F.lit("kept").alias("outcome")).unionByName(new.select("source_id", "id", F.lit("added").alias("outcome")))
