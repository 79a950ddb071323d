"""Write-path semantics as set operations: upserts, dedupe windows, supersession, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import dice, tokens
from lorekeep.scratch import Scratch


def topic_upsert(df: DataFrame) -> DataFrame:
    """One row per (topic_key, scope): newest content, first created_at, number of revisions. Aggregated map-side."""
    t = df.filter("topic_key IS NOT NULL")
    return t.groupBy("topic_key", "scope").agg(
        F.count(F.lit(1)).alias("revision_count"), F.max_by("content", F.struct("created_at", "id")).alias("content"), F.min("created_at").alias("created_at"), F.max_by("id", F.struct("created_at", "id")).alias("id"),
    )


def window_dedupe(df: DataFrame, hash_col: str, at: str, key: str, days: int = 30) -> DataFrame:
    """(key, first_key, duplicate): rows of a hash within ``days`` after an opening row are its duplicates.

    The window is anchored at the opening row, the next row beyond it opens another.
    A round settles the oldest open window of every hash at once: its first row is a
    map-side minimum, so a hash of any size is never gathered; there are as many
    rounds as windows in the longest history. Null hashes are never duplicates.
    """
    s = Scratch(df.sparkSession, "dedupe")
    rest = s.save(df.filter(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("h"), F.col(at).alias("t"), F.col(key).alias("k")))
    out = df.filter(F.col(hash_col).isNull()).select(F.col(key).alias("k"), F.col(key).alias("first"))
    while True:
        opener = rest.groupBy("h").agg(F.min(F.struct("t", "k")).alias("o")).select("h", F.col("o.t").alias("t0"), F.col("o.k").alias("first"))
        marked = s.save(rest.join(opener, "h").withColumn("inside", F.col("t") <= F.col("t0") + F.expr(f"INTERVAL {days} DAYS")))
        out = out.unionByName(marked.filter("inside").select("k", "first"))
        nxt = marked.filter("NOT inside").select("h", "t", "k")
        if not nxt.limit(1).count():
            break
        rest = s.save(nxt)
    return out.select(F.col("k").alias(key), F.col("first").alias(f"first_{key}"), (F.col("k") != F.col("first")).alias("duplicate"))


def supersede_next(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Adds superseded_by: the next row of the same group, null for the newest."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("superseded_by", F.lead(key).over(w))


def supersede_on_change(df: DataFrame, by: list[str], order: list[str], value: str, key: str) -> DataFrame:
    """Adds superseded_by: the first later row of the group whose value differs."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lead(value).over(w) != F.col(value), F.lead(key).over(w))
    df = df.withColumn("__next", change)
    return df.withColumn("superseded_by", F.first("__next", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("__next")


def last_writer(local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """(key, outcome): insert, overwrite, keep or local_only; the remote row wins only if it is strictly newer."""
    a, b = local.select(key, F.col(at).alias("__a")), remote.select(key, F.col(at).alias("__b"))
    outcome = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "local_only").when(F.col("__b") > F.col("__a"), "overwrite").otherwise("keep")
    return a.join(b, key, "full").select(key, outcome.alias("outcome"))


def merged_rows(local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """The rows of both sides with an outcome as in ``last_writer``: the remote row replaces the local one only if it is strictly newer."""
    rest = [c for c in local.columns if c != key]
    a, b = local.select(key, F.struct(*rest).alias("__a")), remote.select(key, F.struct(*rest).alias("__b"))
    newer = F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.col(f"__b.{at}") > F.col(f"__a.{at}")))
    outcome = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "local_only").when(newer, "overwrite").otherwise("keep")
    return a.join(b, key, "full").select(key, F.when(newer, F.col("__b")).otherwise(F.col("__a")).alias("__r"), outcome.alias("outcome")).select(key, "__r.*", "outcome")


def merge_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows, then source rows whose key the target lacks (of equal source keys one)."""
    return target.unionByName(source.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


def patched(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Base rows with the non-null fields of their patch."""
    p = patch.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = base.join(p, key, "left")
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


# Fixed value: characters that an observation may have.
MOST_CHARS = 50_000


def save_outcomes(df: DataFrame, most_chars: int = MOST_CHARS, days: int = 30) -> DataFrame:
    """(id, outcome): what saving each row in time order does.

    rejected (blank or too long content, unknown scope), repeated (a sync_id seen
    before), topic_update (its topic and scope exist), duplicate (equal hash within
    the window), else inserted.
    """
    bad = F.col("content").isNull() | (F.trim("content") == "") | (F.length("content") > most_chars) | ~F.coalesce(F.col("scope").isin("project", "personal", "team"), F.lit(False))
    rows = df.select("id", "sync_id", "topic_key", "scope", "normalized_hash", "created_at", bad.alias("bad"))
    good = rows.filter("NOT bad")
    first = F.min(F.struct("created_at", "id"))
    by_sync = good.filter("sync_id IS NOT NULL").groupBy("sync_id").agg(first.alias("s0"))
    good = good.join(by_sync, "sync_id", "left").withColumn("again", F.coalesce(F.col("s0.id") != F.col("id"), F.lit(False)))
    fresh = good.filter("NOT again")
    topics = fresh.filter("topic_key IS NOT NULL").groupBy("topic_key", "scope").agg(first.alias("t0"))
    fresh = fresh.join(topics, ["topic_key", "scope"], "left").withColumn("updates", F.coalesce(F.col("t0.id") != F.col("id"), F.lit(False)))
    new = window_dedupe(fresh.filter("NOT updates"), "normalized_hash", "created_at", "id", days)
    out = rows.filter("bad").select("id", F.lit("rejected").alias("outcome"))
    out = out.unionByName(good.filter("again").select("id", F.lit("repeated").alias("outcome")))
    out = out.unionByName(fresh.filter("updates").select("id", F.lit("topic_update").alias("outcome")))
    return out.unionByName(new.select("id", F.when(F.col("duplicate"), "duplicate").otherwise("inserted").alias("outcome")))


def title_supersedes(df: DataFrame, least: float = 0.55, few: int = 200_000) -> DataFrame:
    """(keep_id, drop_id): rows of equal type and scope of which one's title stands as a phrase in the other's title or content, and whose titles overlap by Dice at least ``least``; the newer is kept.

    Notes and titles under 8 characters ask for nothing; equal hashes are duplicates
    and no case. A title's first three words meet the word runs of all rows by
    equality, then the whole phrase is compared.
    """
    o = df.select("id", "type", "scope", "created_at", F.nullif("normalized_hash", F.lit("")).alias("hash"), F.trim("title").alias("title"), tokens(F.col("title")).alias("t"), tokens(F.col("content")).alias("c"))
    start = lambda words: F.xxhash64("type", "scope", F.array_join(words, " "))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    asked = o.filter("type <> 'note' AND scope IS NOT NULL AND length(title) >= 8 AND size(t) > 0").select(F.col("id").alias("a"), start(F.slice("t", 1, 3)).alias("start"))
    runs = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: start(F.slice(c, i, n))))
    every = F.concat(*[F.coalesce(runs(c, n), F.array().cast("array<bigint>")) for c in ("t", "c") for n in (1, 2, 3)])
    known = asked.select("start").distinct()
    # only runs that some title asks for are shuffled
    at = o.select(F.col("id").alias("b"), F.explode(F.array_distinct(every)).alias("start")).join(F.broadcast(known) if known.count() <= few else known, "start", "left_semi")
    pairs = asked.join(at, "start").filter("a <> b").select("a", "b")
    x = o.select(F.col("id").alias("a"), F.struct("type", "scope", "created_at", "id", "hash", "t").alias("x"))
    y = o.select(F.col("id").alias("b"), F.struct("type", "scope", "created_at", "id", "hash", "t").alias("y"), padded("t").alias("title"), padded("c").alias("content"))
    j = pairs.join(x, "a").filter(F.size("x.t") > 0).join(y, "b").filter("x.type = y.type AND x.scope = y.scope AND NOT coalesce(x.hash = y.hash, false)")
    j = j.filter(F.contains("title", padded("x.t")) | F.contains("content", padded("x.t"))).filter(dice(F.col("x.t"), F.col("y.t")) >= least)
    newer = F.struct("x.created_at", "x.id") > F.struct("y.created_at", "y.id")
    return j.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("keep_id"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("drop_id")).distinct()
