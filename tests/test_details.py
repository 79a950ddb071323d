import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.times import inferred_range
from lorekeep.operators import memory
from lorekeep.operators.dense import max_pool
from lorekeep.operators.relational import keyset_page, latest, near_keys, where_all


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()[0]


ANCHORS = [
    ("src/a.rs", ("src/a.rs", None, None, None), "src/a.rs"), ("src/a.rs::run", ("src/a.rs", "run", None, None), "src/a.rs::run"), ("src/a.rs::run::12", ("src/a.rs", "run", 12, 12), "src/a.rs::run::12"),
    (" src\\a.rs:12-40 ", ("src/a.rs", None, 12, 40), "src/a.rs:12-40"), ("src/a.rs::", ("src/a.rs", None, None, None), "src/a.rs"), ("src/a.rs:12", ("src/a.rs:12", None, None, None), "src/a.rs:12"),
]


@pytest.mark.parametrize(("text", "want", "canonical"), ANCHORS)
def test_anchor_forms(spark, text, want, canonical):
    assert tuple(one(spark, tx.anchor(F.col("t")), text)) == want
    assert one(spark, tx.anchor_text(tx.anchor(F.col("t"))), text) == canonical
    assert one(spark, tx.anchor(F.col("t")), "  ") is None


def test_symbols_and_digests(spark):
    import hashlib

    code = "import x\r\ndef run_all():\r\n    pass\r\n\r\ndef run():\r\n    a = 1\r\n    if a:\r\n        b()\r\nend = 2\r\n"
    at = lambda name: one(spark, tx.symbol_lines(F.col("t"), F.lit(name)), code)
    assert tuple(at("run")) == (5, 8) and tuple(at("run_all")) == (2, 4) and tuple(at("end")) == (9, 9) and at("nothing") is None
    lines = code.replace("\r\n", "\n").split("\n")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = lambda a: one(spark, tx.slice_digest(F.col("t"), tx.anchor(F.lit(a))), code)
    assert digest("f:2-3") == sha("\n".join(lines[1:3])) and digest("f::run") == sha("\n".join(lines[4:8])) and digest("f") == sha("\n".join(lines)) and digest("f::no") == sha("\n".join(lines))


def test_parsers(spark):
    assert one(spark, tx.sub_questions(F.col("t")), "1. Where is it?\n2) no\n3. Who owns the lane?\nWhat?") == ["Where is it?", "Who owns the lane?"]
    assert tuple(one(spark, tx.fact_line(F.col("t")), "lane - owns - the budget - all")) == ("lane", "owns", "the budget - all")
    assert tuple(one(spark, tx.fact_line(F.col("t")), "nothing here")) == (None, None, None)
    assert one(spark, tx.project_name(F.col("t")), "  My_Project / One! ") == "my-project--one"
    assert [one(spark, tx.project_name(F.col("t")), x) for x in (".hidden", "a..b", "???", "-A-")] == [None, None, None, "-a-"]
    assert [one(spark, tx.family(F.col("t")), x) for x in ("note", "learning", "bugfix", None)] == ["note", "learning", "general", "general"]
    assert one(spark, tx.state_of(F.greatest(*[tx.state_rank(F.lit(x)) for x in ("stale", "unprovable", "invalidated")])), "") == "unprovable"
    assert one(spark, tx.tokens(F.col("t")), "Café CAFE\u0301 naïve") == ["cafe", "cafe", "naive"]
    assert one(spark, tx.gold_rank(F.split("t", ","), F.lit("B")), "a,xbx,b") == 2
    assert one(spark, tx.gold_rank(F.split("t", ","), F.lit("q")), "a,b") is None
    assert one(spark, tx.preview(F.col("t"), 2, 5), "ab\ncde\nf") == "ab cd"
    got = one(spark, tx.tolerant_array(F.col("t"), "a int"), 'here: [{"a": 1}, {"a": 2}, {"a": 3')
    assert [r["a"] for r in got] == [1, 2]
    assert one(spark, tx.tolerant_array(F.col("t"), "a int"), None) == []


NOW = dt.datetime(2026, 1, 1, 9, 30)  # a Thursday
RANGES = [
    ("done yesterday", (dt.datetime(2025, 12, 31), dt.datetime(2025, 12, 31, 23, 59, 59))), ("today", (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 23, 59, 59))), ("last weekend", (dt.datetime(2025, 12, 27), dt.datetime(2025, 12, 28, 23, 59, 59))),
    ("last week, not 2025-03-04", (NOW - dt.timedelta(14), NOW)), ("this week", (NOW - dt.timedelta(7), NOW)), ("last year", (NOW - dt.timedelta(730), NOW)), ("on 2025-02-30 or 2025-03-04", (dt.datetime(2025, 3, 4), dt.datetime(2025, 3, 4, 23, 59, 59))),
    ("in 2024 then", (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 59, 59))), ("two days ago", (NOW - dt.timedelta(90), NOW)), ("recently", None), ("2025-02", None), (None, None),
]


@pytest.mark.parametrize(("text", "want"), RANGES)
def test_inferred_ranges(spark, text, want):
    got = one(spark, inferred_range(F.col("t"), F.lit(NOW).cast("timestamp_ntz")), text)
    assert (got and tuple(got)) == want


TIERS = [("", "easy"), ("cold digest", "easy"), ("what is the state of it now", "normal"), ("how does it relate", "hard"), ("what changed last week", "hard"), ("`a` and `b/c.rs`", "hard"), ("see x::y", "hard"), ("`a`", "hard"), ("lane vs queue", "hard")]


@pytest.mark.parametrize(("text", "want"), TIERS)
def test_query_tiers(spark, text, want):
    temporal = inferred_range(F.col("t"), F.lit(NOW).cast("timestamp_ntz")).isNotNull()
    assert one(spark, tx.query_tier(F.col("t"), temporal), text) == want


def test_questions_on_time(spark):
    score = lambda q, hit: one(spark, tx.temporal_score(F.col("t"), F.lit(hit)), q)
    assert score("what is the latest rule", "the most recent one") == 2 and score("what is the latest rule", "the first") == 0
    assert score("before 2024", "earlier, in 2024") == 2 and score("before 2024", "earlier, in 2023") == -100 and score("which", "later") == 0
    assert one(spark, tx.query_terms(F.col("t")), "What did O'Brien's LANE do in it?") == ["o'brien's", "lane"]
    assert one(spark, tx.query_entities(F.col("t")), "`b` a/b.rs ` ` `c` x/y.py `b`") == ["b", "c", "a/b.rs"]


def test_save_outcomes(spark):
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    data = [
        (1, "a", None, "project", "h", day(0), "x"), (2, "b", None, "project", "h", day(10), "x"), (3, "a", None, "project", "z", day(11), "x"), (4, "c", "t", "team", None, day(1), "x"), (5, "d", "t", "team", "q", day(2), "x"),
        (6, "e", "t", "project", "q", day(3), "x"), (7, "f", None, "elsewhere", None, day(3), "x"), (8, "g", None, "team", None, day(3), "  "), (9, "h", None, "project", "h", day(31), "x"), (10, None, None, "project", None, day(1), "x"), (11, None, None, "project", None, day(1), "x"),
    ]
    df = spark.createDataFrame(data, "id long, sync_id string, topic_key string, scope string, normalized_hash string, created_at timestamp_ntz, content string")
    want = {1: "inserted", 2: "duplicate", 3: "repeated", 4: "inserted", 5: "topic_update", 6: "inserted", 7: "rejected", 8: "rejected", 9: "inserted", 10: "inserted", 11: "inserted"}
    assert dict(rows(memory.save_outcomes(df))) == want
    assert memory.save_outcomes(df.limit(0)).count() == 0


def test_reads(spark):
    df = spark.createDataFrame([(i, dt.datetime(2025, 1, 1 + i // 3), "s" if i % 2 else "u") for i in range(10)], "id long, t timestamp_ntz, g string")
    seen, after = [], None
    while page := keyset_page(df, F.col("t"), F.col("id"), after, 4).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["t"], page[-1]["id"])
    assert seen == list(range(9, -1, -1))
    assert rows(latest(df, ["g"], ["t", "id"]), "g", "id") == [("s", 9), ("u", 8)]
    assert where_all(df, g="s", id=None).count() == 5
    assert rows(near_keys(df, df.filter("id = 4").select("id", "g"), "id", "g", 2), "anchor", "id") == [(4, 2), (4, 4), (4, 6)]
    hits = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.2), (1, 9, 0.1)], "query long, id long, distance double")
    assert rows(max_pool(hits, spark.createDataFrame([(1, 7), (2, 7), (9, 8)], "id long, parent long"))) == [(1, 7, 0.2), (1, 8, 0.1)]


def test_greedy_pack_and_stale_answers(spark):
    from lorekeep.operators import context as cx
    from lorekeep.operators import evaluate as ev

    df = spark.createDataFrame([("p", i, i, s) for i, s in enumerate([50, 60, 40, 10, 1])], "p string, key long, rank long, size long")
    assert rows(cx.skip_pack(df, ["p"], 100), "key") == [(0,), (2,), (3,)]
    data = [(None, 1, False, False), (2, 1, False, False), (1, 2, False, True), (None, None, False, True), (None, None, True, True)]
    d = spark.createDataFrame(data, "g int, a int, gs boolean, sa boolean")
    got = [r[0] for r in d.select(ev.stale_served(F.col("g"), F.col("a"), F.col("gs"), F.col("sa"))).collect()]
    assert got == [True, True, False, True, False]


def test_queries_are_named_once_and_have_twins():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 140
    core = {k for k in q if not k.startswith("p")}
    assert not {k for k in core if k not in s}


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() > 0


def test_imports_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
