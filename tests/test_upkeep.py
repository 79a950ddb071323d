import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from lorekeep.functions.instants import instant
from lorekeep.operators.cdc import BucketTable
from lorekeep.operators.orphans import contiguous_runs, orphans
from lorekeep.operators.prefix import block_prefix_sum
from lorekeep.operators.skew import lookup
from lorekeep.plans.upkeep import current_state


def test_instants_of_all_notations_agree(spark):
    same = ["2025-01-06T10:00:00Z", "2025-01-06 10:00:00", "2025-01-06T12:00:00+02:00", "2025-01-06T05:00:00.000-0500", " 2025-01-06T10:00:00.000+00:00 ", "2025-01-06T10:00:00"]
    df = spark.createDataFrame([(s,) for s in [*same, None, "", "soon", "2025-01-06"]], "s string")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in df.select(F.unix_micros(instant(F.col("s")))).collect()]
        assert got[:6] == [1736157600000000] * 6 and got[6:9] == [None] * 3 and got[9] == 1736121600000000
    spark.conf.set("spark.sql.session.timeZone", "UTC")


CHANGE = "sync_id string, at long, rev int, change_id long, gone boolean, bucket string"


def test_bucket_table_in_any_order_and_in_batches(spark, tmp_path):
    r = random.Random(4)
    feed = [(f"k{r.randint(1, 40)}", r.randint(1, 30), r.randint(1, 3), i, r.random() < 0.2, "own column") for i in range(300)]
    feed += feed[:50]
    want = {}
    for k, at, rev, cid, gone, _ in feed:
        if k not in want or (at, rev, cid) > want[k][:3]:
            want[k] = (at, rev, cid, gone)
    for batches in (1, 3):
        mixed = feed[:]
        r.shuffle(mixed)
        df = spark.createDataFrame(mixed, CHANGE).withColumnRenamed("bucket", "note")
        t = BucketTable(spark, f"file://{tmp_path}/t{batches}", "sync_id", ["at", "rev", "change_id"], buckets=8)
        for b in range(batches):
            t.apply(df.filter(F.pmod("change_id", F.lit(batches)) == b))
        got = {x["sync_id"]: (x["at"], x["rev"], x["change_id"], x["gone"]) for x in t.history().collect()}
        assert got == want
    assert t.versions() == [1, 2, 3]
    assert t.history(1).count() <= t.history().count()
    t.vacuum()
    assert t.versions() == [3] and t.history().count() == len(want)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "sync_id", ["at"], buckets=16)
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "sync_id string, at long")
    t.apply(df)
    before = t.manifest()["files"]
    assert t.apply(df.filter("sync_id = 'k7'").withColumn("at", F.lit(1000).cast("long"))) == 2
    after = t.manifest()["files"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert t.apply(df.limit(0)) == 2  # nothing to commit
    assert t.apply(df.withColumn("sync_id", F.lit(None).cast("string"))) == 2


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    from lorekeep.operators import cdc

    monkeypatch.setattr(cdc, "BUCKET_ROWS", 10)
    t = BucketTable(spark, f"file://{tmp_path}/t", "sync_id", ["at"])
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("sync_id"), F.col("id").alias("at"))
    t.apply(df.filter("at < 80"))
    assert t.manifest()["buckets"] == 8 and t.manifest()["keys"] == 80
    t.apply(df.filter("at >= 80"))
    assert t.manifest()["buckets"] == 256 and t.manifest()["keys"] == 2000
    assert t.apply(df.filter("sync_id = 'k5'").withColumn("at", F.lit(5000).cast("long"))) == 3
    assert len(set(t.manifest()["files"].values()) & set(t.manifest(2)["files"].values())) == len(t.manifest(2)["files"]) - 1
    assert rows(t.history(), "sync_id", "at") == sorted((f"k{i}", 5000 if i == 5 else i) for i in range(2000))


def test_lost_race_is_refused(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "sync_id", ["at"], buckets=4)
    t.apply(spark.createDataFrame([("a", 1)], "sync_id string, at long"))
    try:
        t._commit({"version": 1, "files": {}, "schema": None})
        raise AssertionError("a second commit of the version went through")
    except RuntimeError:
        pass


def feed(spark, recs):
    base = dt.datetime(2025, 1, 1)
    full = [(i, c, "p", s, op, at, de, rev, "t", "c", base) for i, (c, s, op, at, de, rev) in enumerate(recs)]
    return spark.createDataFrame(full, "feed_pos long, change_id long, project string, sync_id string, op string, updated_at string, deleted_at string, revision_count int, title string, content string, received_at timestamp_ntz")


def test_current_state_rules(spark):
    f = feed(spark, [
        (1, "a", "insert", "2025-01-01T00:00:00Z", None, 1), (2, "a", "update", "2025-01-01 00:00:00", None, 2), (1, "a", "insert", "2025-01-01T01:00:00+01:00", None, 1),
        (3, "b", "delete", "2025-01-02T00:00:00Z", None, 1), (4, "b", "insert", "2025-01-01T00:00:00Z", None, 9), (5, "c", "delete", "2025-01-01T00:00:00Z", None, 1), (6, "c", "update", "2025-01-03T00:00:00Z", None, 1),
        (7, "d", "update", "2025-01-03T00:00:00Z", "2025-01-03T00:00:00Z", 1), (8, None, "insert", "2025-01-03T00:00:00Z", None, 1), (9, "e", "insert", None, None, None),
    ])
    for n, mixed in ((1, False), (2, True), (3, False), (4, False)):
        assert rows(current_state(spark, f, n, mixed), "sync_id", "change_id") == [("a", 2), ("c", 6), ("e", 9)]
    assert current_state(spark, f.limit(0)).count() == 0


def test_runs_and_orphans(spark):
    parents = spark.createDataFrame([(k, dt.datetime(2025, 1, 1 + k % 5)) for k in [1, 2, 3, 7, 8, 64, 65, 500, -3, -2, 2]], "key long, since timestamp_ntz")
    runs = [(x["start"], x["end"]) for r in contiguous_runs(parents).collect() for x in r["runs"]]
    assert sorted(runs) == [(-3, -2), (1, 3), (7, 8), (64, 65), (500, 500)]
    late, early = dt.datetime(2026, 1, 1), dt.datetime(2024, 1, 1)
    refs = [(1, late), (4, late), (7, early), (65, late), (66, late), (None, late), (-3, late), (-4, late), (2, None)] + [(9, late)] * 3 + [(3, late)] * 1500
    df = spark.createDataFrame([("p", t, a, "x") for t, a in refs], "parent string, target long, at timestamp_ntz, block string").drop("block")
    got = rows(orphans(df, {"p": parents}), "target", "reason")
    assert got == sorted([(4, "missing"), (7, "later"), (66, "missing"), (-4, "missing"), (9, "missing"), (9, "missing"), (9, "missing")])
    assert orphans(df.limit(0), {"p": parents}).count() == 0
    assert orphans(df, {"p": parents.limit(0)}).count() == len(refs) - 1


def test_prefix_sum_over_blocks(spark):
    r = random.Random(1)
    data = [("hot" if i % 3 else None, i, r.randint(0, 5), "own") for i in range(2000)]
    df = spark.createDataFrame(data, "g string, k long, v long, note string")
    got = block_prefix_sum(df, ["g"], F.floor(F.col("k") / 50), [F.col("k")], F.col("v"), "before")
    want, total = [], {}
    for g, k, v, n in data:
        want.append((k, total.get(g, 0)))
        total[g] = total.get(g, 0) + v
    assert rows(got, "k", "before") == want


def test_lookup_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(3000)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 3000, 3)] + [(1, 7)], "k long, y long")
    assert rows(lookup(left, right, ["k"])) == rows(left.join(right, "k", "left"))
    assert rows(lookup(left, right, ["k"], "inner")) == rows(left.join(right, "k"))
