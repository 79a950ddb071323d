import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorekeep.llm import knn, neardup

# vectors -----------------------------------------------------------------------


def truth(vectors, floor=0.8, k=10):
    keys = sorted(vectors)
    x = np.stack([np.frombuffer(vectors[i], "<f4").astype(float) for i in keys])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 7)
    np.fill_diagonal(s, -2)
    out = set()
    for i, key in enumerate(keys):
        for j in np.lexsort((np.arange(len(keys)), -s[i]))[:k]:
            if s[i, j] >= floor:
                out.add(tuple(sorted((key, keys[j]))))
    return out


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((n // 12, dim))
    x = centre[r.integers(0, len(centre), n)] + 0.35 * r.standard_normal((n, dim))
    return {f"{dim}-{i:05d}": (v * r.choice([1, 3, 0.5])).astype("<f4").tobytes() for i, v in enumerate(x)}


def frame(spark, pairs):
    return spark.createDataFrame([(k, None if p is None else bytearray(p), "f", "v") for k, p in pairs], "cache_key string, payload binary, fingerprint string, key string")


@pytest.mark.parametrize("cell, flat", [(8192, 256), (60, 256), (8192, 4), (60, 4)])
def test_neighbours_match_brute_force(spark, monkeypatch, cell, flat):
    """Whole lists and cut ones, one level of centroids and two."""
    monkeypatch.setattr(knn, "CELL", cell)
    monkeypatch.setattr(knn, "FLAT", flat)
    monkeypatch.setattr(knn, "LIST_SIZE", 60 if flat == 256 else 40)
    a, b = clustered(600, 384, 1), clustered(300, 768, 2)
    got = {tuple(r) for r in knn.similar_pairs(frame(spark, [*a.items(), *b.items(), *list(a.items())[:20]])).select("key_a", "key_b").collect()}
    want = truth(a) | truth(b)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_unusable_payloads_take_no_part(spark):
    v = np.zeros(384, "<f4")
    one, nan = v.copy(), v.copy()
    one[0], nan[3] = 1, np.nan
    tiny = (one * 1e-38).astype("<f4")
    huge = (one * 3e38).astype("<f4")
    data = [("a", one.tobytes()), ("b", one.tobytes()), ("z1", v.tobytes()), ("z2", v.tobytes()), ("n1", nan.tobytes()), ("n2", nan.tobytes()), ("s", b""), ("c", one.tobytes()[:-1]), ("d", one.tobytes()[:-4]), ("o", None), ("t", tiny.tobytes()), ("h", huge.tobytes()), (None, one.tobytes())]
    assert rows(knn.similar_pairs(frame(spark, data)), "key_a", "key_b") == [("a", "b"), ("a", "h"), ("a", "t"), ("b", "h"), ("b", "t"), ("h", "t")]
    assert knn.similar_pairs(frame(spark, [])).count() == 0


def test_many_copies_have_ten_neighbours_each(spark):
    one = np.ones(384, "<f4").tobytes()
    got = rows(knn.similar_pairs(frame(spark, [(f"k{i:03d}", one) for i in range(60)])), "key_a", "key_b")
    want = {(f"k{min(i, j):03d}", f"k{max(i, j):03d}") for i in range(60) for j in [x for x in range(60) if x != i][:10]}
    assert set(got) == want and len(got) == len(want)


def test_scan_abandons_but_does_not_lose():
    x = knn.unpack(list(clustered(900, 384, 7).values()), 384)[1] @ knn.rotation(384)
    q, c, cos = knn.scan(x[:200], x, 0.8)
    s = x[:200].astype(float) @ x.T.astype(float)
    want = {tuple(p) for p in np.argwhere(s >= 0.8)}
    got = set(zip(q.tolist(), c.tolist()))
    assert len(got & want) >= 0.995 * len(want) and not got - {tuple(p) for p in np.argwhere(s >= 0.7999)}


def test_lists_follow_the_vectors():
    x = knn.unpack(list(clustered(3000, 384, 4).values()), 384)[1]
    tree = knn.fit_tree(x, 400)
    assert 380 <= len(tree.leaves) <= 420 and len(tree.branches) == 20 and tree.sampled.sum() == 3000 and tree.starts[-1] == len(tree.leaves)
    near = knn.nearest_lists(x, tree, 2)
    flat = np.argsort(-(x @ tree.leaves.T), axis=1)[:, :1]
    assert (near[:, :1] == flat).mean() > 0.95 and (near[:, 0] != near[:, 1]).all()
    assert len(knn.fit_tree(x[:3], 400).leaves) == 1


# texts -------------------------------------------------------------------------


def brute(texts, least=0.6):
    import re

    sets = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None:
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return sorted((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([4, 6, 12, 40, 90]))]
        out.append((i := i + 1, " ".join(base)))
        for _ in range(r.randint(0, 3)):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                k = r.randrange(len(w))
                x = r.random()
                w[k : k + 1] = [r.choice(vocab)] if x < 0.4 else [] if x < 0.7 else [w[k], r.choice(vocab)]
            if r.random() < 0.2 and len(w) > 20:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            out.append((i := i + 1, " ".join(w) if r.random() < 0.7 else ", ".join(w).upper()))
    return out


def near(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "id long, body string, key string, text string")
    return neardup.NearDuplicates(df, "id", F.col("body"))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_match_brute_force(spark, seed):
    texts = corpus(seed)
    got, want = set(rows(near(spark, texts + texts[:25]).record_pairs())), set(brute(texts))
    assert not got - want and len(got) >= 0.985 * len(want)


def test_pasted_and_moved_passages_are_found(spark):
    texts, want = [], set()
    for i in range(60):
        t = [f"p{i}x{j}" for j in range(62)]  # 60 k-mers
        # twice pasted, then five and eight times; halves changed over; a few against many k-mers at the threshold
        for k, w in enumerate([t, t * 2, t * 5, t * 8, t[31:] + t[:31]]):
            texts.append((10 * i + k, " ".join(w)))
        texts += [(10 * i + 5, " ".join(f"s{i}x{j}" for j in range(5))), (10 * i + 6, " ".join(f"s{i}x{j}" for j in range(7)))]
        want |= {(10 * i + a, 10 * i + b) for a in range(5) for b in range(a + 1, 5)} | {(10 * i + 5, 10 * i + 6)}
    assert want == set(brute(texts))
    got = set(rows(near(spark, texts).record_pairs()))
    assert not got - want and len(got) >= 0.995 * len(want)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "one two three"), (6, "One, two: three!"), (7, long), (8, long + " end"), (None, "one two three"), (9, "—"), (10, "a b c d e f g"), (11, "a b c d e f g")]
    n = near(spark, texts)
    assert rows(n.record_pairs()) == [(5, 6), (7, 8), (10, 11)]
    assert rows(n.class_links(), "key", "copies", "links") == [(5, 0, 1), (6, 0, 1), (7, 0, 1), (8, 0, 1), (10, 1, 0), (11, 1, 0)]
    assert near(spark, []).record_pairs().count() == 0


def test_banded_alignment():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    r = np.random.default_rng(0)
    a = [r.integers(0, 6, r.integers(0, 30)) for _ in range(80)]
    b = [np.delete(x, r.integers(0, len(x), 2)) if len(x) > 3 and i % 2 else r.integers(0, 6, r.integers(0, 30)) for i, x in enumerate(a)]
    want = np.array([plain(x, y) for x, y in zip(a, b)])
    assert (neardup.edit_distance(a, b, band=40) == want).all()
    got = neardup.edit_distance(a, b, band=5)
    cut = np.array([len(x) > 3 and i % 2 == 1 for i, x in enumerate(a)])  # two words taken out: the path stays in the band
    assert (got >= want).all() and (got[cut] == want[cut]).all()


def test_sketches_keep_order():
    w = [np.arange(50, dtype=np.int64), np.arange(50, dtype=np.int64)[::-1].copy(), np.arange(50, dtype=np.int64)]
    h, o = neardup.kmers(w)
    v, who = neardup.sketch(h, o, 3, 3, 8, 0)
    s = [set(v[who == i].tolist()) for i in range(3)]
    assert s[0] == s[2] and not s[0] & s[1]
    # halves changed over: ordered sketches that span them differ, plain ones do not but for the seam
    w = [np.arange(50, dtype=np.int64), np.r_[np.arange(25, 50), np.arange(25)]]
    h, o = neardup.kmers(w)
    common = []
    for rounds in ((200, 0), (0, 200)):
        v, who = neardup.sketch(h, o, 2, 3, *rounds)
        common.append(len(set(v[who == 0].tolist()) & set(v[who == 1].tolist())))
    assert 0 < common[0] < 0.5 * common[1]


def test_labels_tell_occurrences_apart():
    w = [np.array([1, 2, 3, 1, 2, 3, 1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 3])]
    h, o = neardup.kmers(w)
    assert neardup.occurrences(h, o).tolist() == [0, 0, 0, 1, 1, 1, 2, 0, 0]
    # pasting changes ordered sketches, not plain ones, and records of like sets agree whatever shares their matrix
    v, who = neardup.sketch(h, o, 3, 3, 0, 5)
    alone, _ = neardup.sketch(*neardup.kmers(w[2:]), 1, 3, 0, 5)
    assert v[who == 2].tolist() == alone.tolist()


def test_prefix_filter_misses_nothing(spark):
    r = random.Random(9)
    texts = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(3, 12)))) for i in range(150)]
    df = spark.createDataFrame(texts, "id long, body string")
    assert rows(neardup.NearDuplicates(df, "id", F.col("body"), exact=True).record_pairs()) == brute(texts)


def test_alignment_settles_small_edits():
    r = np.random.default_rng(3)
    a = [r.integers(0, 10**6, 80) for _ in range(40)]
    b = [np.delete(x, 7) if i % 2 else np.r_[x[40:], x[:40]] for i, x in enumerate(a)]
    n = np.array([78] * 40)
    ok, edit, proven = neardup.verify(a, b, n, np.array([len(x) - 2 for x in b]), 0.6)
    assert ok.all() and proven[1::2].all() and not proven[::2].any() and (edit[1::2] == 1 - 1 / 80).all()
