import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorekeep.functions import scores as sc
from lorekeep.functions import text as tx
from lorekeep.operators import context as cx
from lorekeep.operators import dense, fusion, graph, memory
from lorekeep.operators import evaluate as ev
from lorekeep.operators import lexical as lx
from lorekeep.operators.names import jaro_winkler
from lorekeep.sources import chunks, loaders
from lorekeep.streaming import windows as sw


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("title", "want"), [("Hello,  World!", "hello-world"), ("--", "untitled"), ("x" * 50, "x" * 40), ("a" * 39 + " b", "a" * 39)])
def test_slug(spark, title, want):
    assert one(spark, tx.slug(F.col("t")), t=title) == want


def test_text_functions(spark):
    assert one(spark, tx.normalized(F.col("t")), t="  A\t b\n C ") == "a b c"
    assert one(spark, tx.token_estimate(F.col("a"), F.col("b")), a="abc", b="defg") == 2
    assert one(spark, tx.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("b")))) == pytest.approx(2 / 3)
    assert one(spark, tx.word_chunks(F.col("t"), 4, 1), t=" a b c d e f g h ") == ["a b c d", "d e f g", "g h"]
    assert one(spark, tx.word_chunks(F.col("t"), 4, 1), t=" a  b ") == ["a  b"]
    assert one(spark, tx.object_slice(F.col("t")), t='say {"a": {"b": 1}} now') == '{"a": {"b": 1}}'
    assert one(spark, tx.ordinals(F.col("t"), 5), t="[3, 9, 1, 3]") == [3, 1]
    assert one(spark, tx.dialogue_ids(F.col("t")), t="see D12:3 and d:4") == ["D12:3", "d:4"]
    assert one(spark, tx.entity_key(F.col("t")), t="Src/Ünit::a b") == "src/ünit::ab"


def test_scores(spark):
    assert one(spark, sc.adaptive_sigmoid(F.lit(5.0), F.lit(2))) == pytest.approx(0.5)
    assert one(spark, sc.salience(F.lit("decision"), F.lit("verified"))) == pytest.approx(1.1)
    assert one(spark, sc.salience(F.lit("note"), F.lit("invalidated"))) == pytest.approx(0.3)
    assert one(spark, sc.decay(F.lit(-4.0))) == 1.0


def test_rank_fusion_golden_orders(spark):
    def fuse(a, b):
        df = spark.createDataFrame([(1, lane, i, r) for lane, ids in ((1, a), (2, b)) for r, i in enumerate(ids, 1)], "query int, lane int, id long, rank long")
        return [x["id"] for x in fusion.reciprocal_rank(df).orderBy("rank").collect()]

    assert fuse([1, 2, 3, 4, 5], [3, 2, 1, 6, 7]) == [1, 3, 2, 4, 6, 5, 7]
    assert fuse([10, 20], [30, 40]) == [10, 30, 20, 40]


def test_score_map_and_contradictions(spark):
    lex = spark.createDataFrame([(1, 1, 0.5)], "query long, id long, lexical double")
    den = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.3), (2, 9, 0.4)], "query long, id long, distance double")
    boost = spark.createDataFrame([(1, 1, 7.0)], "query long, id long, boost double")
    assert rows(fusion.score_map(lex, den, boost)) == [(1, 1, 0.5, 0.0, 1.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 0.0), (2, 9, 0.0, 1.0, 0.0)]
    f = spark.createDataFrame([(1, "p", "S ", "is", "a", 0.5), (2, "p", "s", "IS", "b", 0.5), (3, "p", "t", "is", "a", 0.9)], "id long, pr string, s string, p string, o string, w double")
    assert rows(fusion.contradictions(f, ["pr"], "s", "p", "o", "w", "id"), "id", "factor", "bonus") == [(1, 0.5, 0.25), (2, 0.5, 0.0), (3, 1.0, 0.0)]


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_block_knn_equals_brute_force(spark, monkeypatch, metric, sent):
    """Queries sent to the corpus, and pairs of blocks."""
    monkeypatch.setattr(dense, "QUERY_BYTES", sent)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    x = np.random.default_rng(0).standard_normal((150, 8))
    x[3] = 0
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vec array<double>")
    q = c.filter("id % 10 = 0").withColumnRenamed("id", "query")
    got = rows(dense.block_knn(c, q, 5, metric), "query", "rank", "id")
    want = []
    for i in range(0, 150, 10):
        d = np.round(dense.METRICS[metric](x[i : i + 1], x)[0], 9)
        want += [(i, r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(150), d))[:5])]
    assert got == sorted(want)


def test_int8_keeps_the_ten_nearest(spark):
    x = np.random.default_rng(1).standard_normal((400, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    z = c.select("id", dense.quantize(F.col("vec"), dense.scale_of(F.col("vec"))).cast("array<double>").alias("vec"))
    top = lambda d: {(a, b) for a, b in rows(dense.block_knn(d, d.filter("id < 50").withColumnRenamed("id", "query"), 10), "query", "id")}
    a, b = top(c), top(z)
    assert len(a & b) / len(a | b) >= 0.9


def test_phrases_and_bm25(spark):
    docs = spark.createDataFrame([(1, "the warm cache warm cache"), (2, "cache the warm"), (3, None), (4, "")], "id long, body string")
    q = spark.createDataFrame([(1, "Warm cache!"), (2, "the"), (3, "?")], "q long, text string")
    phrases = lx.phrase_table(q, "q", "text")
    c = lx.matched(docs, "id", {"body": 1.0}, phrases)
    hits = lx.phrase_hits(c, phrases)
    assert rows(hits, "query", "doc", "hits") == [(1, 1, 2.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert {r["query"] for r in lx.bm25(c, hits).collect()} == {1, 2}
    assert {p for _, p in rows(lx.phrase_table(spark.createDataFrame([(1, "fold the warm lane")], "q long, text string"), "q", "text", True), "query", "phrase")} == {"fold warm lane", "fold warm", "warm lane", "fold", "warm", "lane"}
    assert rows(lx.phrase_table(spark.createDataFrame([(1, "what LANE"), (2, "it")], "q long, text string"), "q", "text", True)) == [(1, "lane", 1)]
    long = " ".join(f"w{i}" for i in range(14))
    many = lx.phrase_table(spark.createDataFrame([(1, long)], "q long, text string"), "q", "text")
    one = spark.createDataFrame([(1, f"x {long} y"), (2, long[:-1])], "id long, body string")
    assert rows(lx.search(one, "id", {"body": 1.0}, many), "query", "doc") == [(1, 1)]  # phrases of any length


def test_graph_walks(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 0.9), (2, 3, 4.0, 0.5), (3, 4, 1.0, 1.0)], "src long, dst long, weight double, confidence double")
    both = graph.both_ways(e)
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.neighbourhood(both, seeds)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert rows(graph.neighbourhood(both, seeds, degree_cap=1)) == [(1, 1, 0)]
    b = {n: s for _, n, s in rows(graph.beam_walk(both, seeds))}
    assert b[2] == pytest.approx(0.65 * 0.9) and b[3] == pytest.approx(0.65 * 0.9 * 0.65 * 0.5 * 2)
    p = {n: s for n, s in rows(graph.personalized_pagerank(both.select("src", "dst", "weight"), seeds))}
    assert sum(p.values()) == pytest.approx(1) and p[1] > p[2] > p[3] > p[4]
    d = spark.createDataFrame([(1, "`Foo Bar`", "and src/a.rs `x/y` src/b.rs or SRC/A.rs", ["./src/a.rs::&run()", " "]), (2, None, None, None)], "id long, t string, c string, a array<string>")
    got = rows(graph.mine_entities(d, "id", "t", "c", "a"), "pos", "norm_name", "name", "kind", "source")
    assert got == [(0, "src/a.rs", "src/a.rs", "file", "anchor"), (1, "run", "run", "symbol", "anchor"), (2, "foobar", "Foo Bar", "concept", "backtick"), (3, "x/y", "x/y", "file", "backtick"), (5, "src/b.rs", "src/b.rs", "file", "token")]


def test_paths_never_come_back(spark):
    from lorekeep.operators import memory_graph as mg

    e = graph.both_ways(spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 3, 1.0, 1.0), (1, 3, 4.0, 0.1), (2, 4, 1.0, 0.2)], "src long, dst long, weight double, confidence double"))
    seeds = spark.createDataFrame([(1,)], "node long")
    p = {tuple(r["path"]): r["score"] for r in mg.path_walk(e, seeds, degree_cap=2).collect()}
    assert set(p) == {(1,), (1, 2), (1, 3), (1, 2, 3)}  # 2 gives its two best edges; (1, 3, 2) is too weak for 2
    assert p[(1, 2, 3)] == pytest.approx(0.65**2) and p[(1, 3)] == pytest.approx(0.65 * 0.1 * 2)
    hits = mg.traversed(e.select("src", "dst", "weight", F.lit("co_occurs").alias("relation"), F.lit(7).cast("long").alias("observation_id")), seeds)
    assert rows(hits, "hop", "weight") == [(1, 1.0), (1, 4.0), (2, 1.0), (2, 1.0)]
    assert rows(mg.boosted_rank(hits, 1.0), "observation_id", "score", "rank") == [(7, 0.5 * 0.5 * 5 + 0.25 * 0.5 * 2, 1)]
    nodes = spark.createDataFrame([("entity", "e:1", "Foo", 0.4, 1), ("entity", "e:1", "F oo", 0.2, 2)], "kind string, ref_key string, label string, confidence double, n long")
    assert rows(mg.upsert_nodes(nodes, "n")) == [("entity", "e:1", "F oo", "foo", 0.4)]


def test_rows_come_once_without_a_shuffle(spark, tmp_path):
    from lorekeep.sources.memory import once

    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (1, "a", 1.5), (3, None, 2.0), (3, None, 2.0), (3, None, 2.0), (4, "d", 0.0)], "id long, text string, first double")
    df.repartition(3).write.parquet(f"file://{tmp_path}/t")
    t = spark.read.parquet(f"file://{tmp_path}/t")
    assert rows(once(t, "id")) == [(1, "a", 1.5), (2, "b", None), (3, None, 2.0), (4, "d", 0.0)]
    assert rows(once(t.filter("text IS NOT NULL"), "id"), "id") == [(1,), (2,), (4,)]
    assert "Exchange hashpartitioning" not in once(t, "id")._jdf.queryExecution().executedPlan().toString()


def test_title_probe_and_verdicts(spark):
    from lorekeep.operators import lifecycle as lc

    day = lambda n: dt.datetime(2025, 1, n)
    data = [(1, "decision", "team", "Use the warm lane now", day(1)), (2, "decision", "team", "the WARM lane", day(2)), (3, "note", "team", "the warm lane", day(3)), (4, "decision", "team", "the warm lane", day(4)), (5, "decision", "personal", "warm lane", day(5)), (6, "decision", "team", "?", day(6)), (7, "decision", None, "the warm lane", day(7)), (8, "note", "team", "warm", day(8))]
    df = spark.createDataFrame(data, "id long, type string, scope string, title string, created_at timestamp_ntz")
    assert rows(lc.title_probe(df)) == [(2, 1, "supersede"), (4, 2, "supersede"), (8, 3, "conflicts_with")]
    assert lc.title_probe(df.limit(0)).count() == 0
    texts = ['x {"action": "KEEP_NEW", "confidence": 0.9} y', '{"action": "keep_old"}', '{"action": "keep_both"}', '{"action": "synthesize", "statement": " s "}', '{"action": "other"}', "nothing", None]
    v = spark.createDataFrame([(10 * i, 10 * i + 1, t) for i, t in enumerate(texts)], "old_id long, new_id long, t string").withColumn("v", lc.parse_verdict(F.col("t")))
    assert [(r["v"] and tuple(r["v"])) for r in v.orderBy("old_id").collect()] == [("keep_new", "", 0.9), ("keep_old", "", 0.0), ("keep_both", "", 0.0), ("synthesize", "s", 0.0), None, None, None]
    assert rows(lc.apply_verdicts(v.select("old_id", "new_id", "v.action"))) == [(0, True, 1), (11, True, 10), (30, False, None), (31, False, None)]


def test_snapshots_keep_known_rows(spark):
    from lorekeep.operators import lifecycle as lc

    target = spark.createDataFrame([(5, "a"), (9, "b")], "id long, sync_id string")
    source = spark.createDataFrame([(i, s) for i, s in enumerate(["b", "c", "a", "d", "e"])], "id long, sync_id string")
    assert rows(lc.merge_snapshot(target, source, "id", "sync_id")) == [(0, 9, "kept"), (1, 10, "added"), (2, 5, "kept"), (3, 11, "added"), (4, 12, "added")]
    assert lc.merge_snapshot(target.limit(0), source, "id", "sync_id").count() == 5 and lc.merge_snapshot(target, source.limit(0), "id", "sync_id").count() == 0


def test_cursors_read_back(spark):
    from lorekeep.plans.lifecycle import cursor_text, parse_cursor

    df = spark.createDataFrame([(7, dt.datetime(2025, 1, 2, 3, 4, 5, 678))], "id long, at timestamp_ntz").withColumn("token", cursor_text(F.col("id"), F.col("at")))
    assert tuple(df.select(parse_cursor(F.col("token"))).first()[0]) == (7, dt.datetime(2025, 1, 2, 3, 4, 5, 678))
    bad = spark.createDataFrame([("???",), ("abc",), ("eyJ2ZXJzaW9uIjoyLCJsYXN0X2lkIjoxfQ",), (None,)], "token string")
    assert [r[0] for r in bad.select(parse_cursor(F.col("token"))).collect()] == [None] * 4


def test_dedupe_window_is_anchored(spark):
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([(1, "h", day(0)), (2, "h", day(20)), (3, "h", day(40)), (4, "h", day(71)), (5, None, day(0)), (6, "g", day(1)), (7, "g", day(1))], "id long, h string, t timestamp_ntz")
    assert rows(memory.window_dedupe(df, "h", "t", "id")) == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 4, False), (5, 5, False), (6, 6, False), (7, 6, True)]


def test_write_semantics(spark):
    f = spark.createDataFrame([(1, "k", 1, "a"), (2, "k", 2, "a"), (3, "k", 3, "b"), (4, "k", 4, "b")], "id long, k string, t int, v string")
    assert rows(memory.supersede_on_change(f, ["k"], ["t"], "v", "id"), "id", "superseded_by") == [(1, 3), (2, 3), (3, None), (4, None)]
    a, b = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, t int"), spark.createDataFrame([(2, 6), (3, 5), (4, 1)], "id long, t int")
    assert rows(memory.last_writer(a, b, "id", "t")) == [(1, "local_only"), (2, "overwrite"), (3, "keep"), (4, "insert")]
    assert rows(memory.merge_ignore(a, b, "id")) == [(1, 5), (2, 5), (3, 5), (4, 1)]
    assert rows(memory.patched(a, b, "id", ["t"])) == [(1, 5), (2, 6), (3, 5)]


def test_context(spark):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([5, 5, 10, 1])], "p string, i long, s long")
    assert rows(cx.token_pack(df, ["p"], F.col("i"), [F.col("i")], F.col("s"), 12), "i") == [(0,), (1,)]
    t = spark.createDataFrame([("s", i) for i in range(8)] + [("u", 0)], "s string, i long")
    w = rows(cx.turn_windows(t, ["s"], [F.col("i")]), "s", "window", "pos")
    assert [p for s, n, p in w if s == "s" and n == 1] == [3, 4, 5, 6, 7] and max(n for s, n, _ in w if s == "s") == 1
    r = spark.createDataFrame([("q", i, i % 3, i + 1, 20) for i in range(30)], "q string, key long, slot int, rank long, size long")
    kept = rows(cx.slot_pack(r, ["q"], 100), "slot", "size")
    assert sum(s for _, s in kept) <= 100 and {k for k, _ in kept} == {0, 1, 2}


def test_overlapping_titles_supersede(spark):
    data = [
        (1, "decision", "team", 1, "h1", "Queue stale palette", "x"), (2, "decision", "team", 2, "h2", "Now queue stale palette again", "x"),  # phrase in the title
        (3, "decision", "team", 3, "h3", "Palette stale queue", "we queue stale palette, yes"),  # in the content
        (4, "decision", "project", 4, "h4", "Queue stale palette", "x"), (5, "policy", "team", 5, "h5", "Queue stale palette", "x"), (6, "decision", "team", 6, "h1", "Queue stale palette", "x"),
        (7, "decision", "team", 7, "h7", "Queue stale palette in one two three four five six", "x"),  # too long
        (8, "note", "n", 8, "h8", "Queue stale palette", "x"), (9, "note", "n", 9, "h9", "Queue stale palette", "x"), (10, "decision", "s", 10, None, "Go on", "x"), (11, "decision", "s", 11, None, "Go on", "x"),
    ]
    df = spark.createDataFrame(data, "id long, type string, scope string, created_at long, normalized_hash string, title string, content string")
    assert rows(memory.title_supersedes(df)) == [(2, 1), (3, 1), (6, 2), (6, 3)]


def test_packs_see_past_the_newest_rows(spark):
    """Old decisions, anchored rows and small rows behind 3 000 newer ones that leave them room."""
    late = [("q", i, 2, i, 2000) for i in range(1, 3001)] + [("q", 3001, 0, 3001, 30), ("q", 3002, 1, 3002, 40), ("q", 3003, 2, 3003, 5), ("q", 3004, 0, 3004, 5)]
    df = spark.createDataFrame(late, "q string, key long, slot int, rank long, size long")
    assert rows(cx.slot_pack(df, ["q"], 100), "key") == [(3001,), (3002,), (3004,)]
    assert rows(cx.skip_pack(df, ["q"], 100), "key") == [(3001,), (3002,), (3003,), (3004,)]
    mixed = [("q", i, i * 7919 % 3, i, 1 + i * 104729 % 60) for i in range(1, 2001)]
    left, want = 90, []
    for _, k, _, _, size in mixed:
        if size <= left:
            want.append((k,))
            left -= size
    df = spark.createDataFrame(mixed, "q string, key long, slot int, rank long, size long")
    assert rows(cx.skip_pack(df, ["q"], 90), "key") == want


def test_evaluation(spark):
    h = spark.createDataFrame([(1, "a", 1, False), (1, "a", 2, True), (2, "a", 1, False)], "query long, c string, rank long, relevant boolean")
    assert rows(ev.retrieval_report(h, ["c"])) == [("a", 2, 0.5, 0.25)]
    v = spark.createDataFrame([("x", float(i), i) for i in range(101)], "g string, v double, k long")
    assert rows(ev.nearest_rank(v, ["g"], "v", "k", [50, 95], F.floor("v"))) == [("x", 50, 50.0), ("x", 95, 95.0)]
    s = ev.stratified(spark.createDataFrame([("a", i) for i in range(70)] + [("b", i) for i in range(30)], "t string, i long"), "t", "i", 11)
    assert rows(s.groupBy("t").count()) == [("a", 8), ("b", 3)]


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1


def test_loaders(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"sample_id": "s", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}], "session_1_date": "x"}, "qa": [{"question": "q", "answer": "a", "category": 1, "evidence": ["D1:1"]}]}]')
    assert rows(loaders.conversation_turns(spark, str(tmp_path / "c.json"))) == [("s", "session_1", 0, "A", "D1:1", "hi")]
    assert loaders.conversation_questions(spark, str(tmp_path / "c.json")).first()["evidence"] == ["D1:1"]
    (tmp_path / "l.json").write_text('[{"question_id": "q", "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "a", "content": "y"}, {"role": "b", "content": "z"}]]}]')
    assert rows(loaders.long_memory_turns(spark, str(tmp_path / "l.json")), "session", "pos", "content") == [(0, 0, "x"), (1, 0, "y"), (1, 1, "z")]
    (tmp_path / "s.jsonl").write_text('{"id": "1", "stale_statement": "old", "current_statement": "new"}\n')
    assert rows(loaders.staleness(spark, str(tmp_path / "s.jsonl")), "version", "statement") == [(1, "old"), (2, "new")]
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1")
    (src / "b.bin").write_bytes(b"zz")
    (src / "c.py").write_bytes(b"\x00x")
    (src / "d.py").write_text("")
    assert [r["text"] for r in loaders.files(spark, f"file://{src}", [".py"]).collect()] == ["x = 1"]
    b = spark.createDataFrame([(1, "- no\n## Key Learnings:\r\n- a \ntext\n  * b\n2) c\n- a\n# I\n- no\n## key learnings\n+ d"), (2, None), (3, "- x")], "id long, t string")
    assert rows(loaders.bullets(b, "id", "t")) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]


def test_chunks_round_trip(spark, tmp_path):
    o = spark.createDataFrame([("p", i, f"s{i}") for i in range(2000)], "project string, id long, sync_id string")
    lines = o.select("project", "id", F.to_json(F.struct(F.lit("observation").alias("_kind"), "id", "sync_id")).alias("line"))
    c = chunks.chunk_ids(lines, ["project"], "id", "line")
    m = chunks.export_chunks(c, str(tmp_path / "out")).cache()
    assert m.count() == 2
    assert chunks.export_chunks(c, str(tmp_path / "none"), m).count() == 0
    back = chunks.import_chunks(spark, str(tmp_path / "out"), "_kind string, id long, sync_id string")
    assert rows(back, "id", "sync_id") == rows(o, "id", "sync_id")
    bad = spark.createDataFrame([("x", '{"id": 1}\nnot json'), ("y", '{"id": 2}')], "chunk_id string, body string")
    bad.write.json(str(tmp_path / "bad"))
    assert rows(chunks.import_chunks(spark, str(tmp_path / "bad"), "id long"), "chunk_id", "id") == [("y", 2)]


def test_streams(spark, tmp_path):
    from lorekeep.operators.cdc import BucketTable

    t0 = dt.datetime(2025, 1, 1)
    e = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=10 * i), i % 2) for i in range(20)], "k long, ts timestamp, u long")
    e.write.parquet(str(tmp_path / "events.parquet"))
    s = sw.table_stream(spark, str(tmp_path), "events")
    assert sum(n for n, in rows(sw.run_to_table(sw.windowed(s, "ts", ["u"])), "n")) == 20
    x = sw.run_to_table(sw.sessions(s, "ts", "u", gap="30 minutes"))
    assert sorted(n for n, in rows(x, "n")) == [10, 10]
    t = BucketTable(spark, f"file://{tmp_path}/target", "k", ["ts"], buckets=4)
    sw.apply_stream(s, t, str(tmp_path / "cp")).awaitTermination()
    assert t.history().count() == 20
