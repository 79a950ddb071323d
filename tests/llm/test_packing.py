import random
from collections import defaultdict

import pytest
from conftest import rows

from lorekeep.llm import packing as pk
from lorekeep.llm.mixing import mix
from lorekeep.llm.tokens import count, encoder, token_counts


def best_fit(sizes, capacity):
    """Best fit decreasing, one item at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_best_fit_item_by_item(seed):
    r = random.Random(seed)
    cap = r.choice([10, 37, 100])
    sizes = [r.randint(1, cap) for _ in range(300)]
    hist = [(s, sizes.count(s)) for s in set(sizes)]
    runs, made = pk.best_fit_runs(hist, cap)
    used = defaultdict(int)
    seen = defaultdict(int)
    for size, rank, items, first, each in runs:
        assert rank == seen[size]
        seen[size] += items
        for i in range(items):
            used[first + i // each] += size
    assert dict(seen) == dict(hist)
    assert sorted(cap - u for u in used.values()) == best_fit(sizes, cap) and len(used) == made


def frame(spark, tokens):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in tokens], "doc_id long, tokens long, piece int, rank int")


def test_pack_holds_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANK_BLOCK", 50)
    r = random.Random(9)
    docs = [(i, r.choice([7, r.randint(1, 260)])) for i in range(600)] + [(1000, 0), (1001, 1000), (None, 5)]
    got = pk.pack(frame(spark, docs + docs[:30]), 100).collect()
    room, parts = defaultdict(int), defaultdict(list)
    for x in got:
        room[x["container_id"]] += x["size"]
        parts[x["doc_id"]].append((x["start_token"], x["size"]))
    assert max(room.values()) <= 100 and set(room) == set(range(len(room)))
    for d, t in docs:
        if d is not None:
            p = sorted(parts.get(d, []))
            assert sum(s for _, s in p) == t and len(p) == -(-t // 100)
            assert [a for a, _ in p] == [100 * i for i in range(len(p))]
    assert len(room) <= 1.02 * sum(room.values()) / 100 + 1


def test_pack_edges(spark):
    assert pk.pack(frame(spark, []), 10).count() == 0
    assert pk.pack(frame(spark, [(1, 0)]), 10).count() == 0
    assert rows(pk.pack(frame(spark, [(1, 10), (2, 10)]), 10), "container_id") == [(0,), (1,)]
    with pytest.raises(ValueError, match="capacity"):
        pk.pack(frame(spark, []), 0)


def test_token_counts(spark):
    long = ("word " * 60_000) + "é​<|endoftext|> tail  end\n\n x"
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", None), (4, long, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in token_counts(df, "doc_id", "text", ["source"]).collect()}
    whole = len(encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(long))
    assert got == {1: 2, 2: 0, 3: 0, 4: whole} and count(long) == whole


TARGETS = [("big", 0.5, 1), ("mid-dle", 0.3, 2), ("Small ", 0.2, 4), ("none", 0.0, 1), ("absent", 0.0001, 1)]


def mixture(spark, n=3000, total=None):
    r = random.Random(3)
    docs = [(i, r.choice([" BIG", "big", "big", "mid_dle", "Mid-Dle"] if i % 12 else ["small", None, "other"]), r.randint(1, 50), r.randint(4, 200)) for i in range(n)]
    df = spark.createDataFrame([(*d, 9) for d in [*docs, *docs[:40]]], "doc_id long, source string, tokens long, chars long, copies int")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return docs, *mix(df, t, total)


def test_shares_repeats_and_epochs(spark):
    docs, m, rep = mixture(spark)
    m, rep = m.collect(), {r["source"]: r for r in rep.collect()}
    assert len({x["doc_id"] for x in m}) == len(m)
    for s, most in (("big", 1), ("mid_dle", 2), ("small", 4)):
        own = [x for x in m if x["source"] == s]
        assert max(x["copies"] for x in own) <= most and max(x["copies"] for x in own) - min(x["copies"] for x in own) <= 1
        if min(x["copies"] for x in own) >= 1 and len({x["copies"] for x in own}) > 1:
            assert len(own) == rep[s]["documents"]  # complete epochs come first
        assert rep[s]["actual_share"] == pytest.approx(rep[s]["target_share"], abs=0.005)
    assert rep["absent"]["used_tokens"] == 0 and "other" not in rep
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)


def test_total_that_cannot_be_reached(spark):
    _, m, rep = mixture(spark, total=10**9)
    rep = {r["source"]: r for r in rep.collect()}
    assert rep["big"]["used_tokens"] == rep["big"]["available_tokens"]
    assert rep["small"]["used_tokens"] == 4 * rep["small"]["available_tokens"]


def test_weights_prefer_quality(spark):
    docs = [(i, "big", 10, 40 if i % 2 else 2) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, chars long")
    m, _ = mix(df, spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int"), 10_000)
    odd = m.filter("doc_id % 2 = 1").count()
    assert odd > 0.8 * m.count() > 0


def test_empty_mix(spark):
    df = spark.createDataFrame([], "doc_id long, source string, tokens long, chars long")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m, rep = mix(df, t)
    assert m.count() == 0 and {r["actual_share"] for r in rep.collect()} == {0.0}
