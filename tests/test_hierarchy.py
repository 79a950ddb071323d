import random

import pytest
from conftest import rows

from lorekeep.operators.hierarchy import descendants, hierarchy

SCHEMA = "id long, up long, node_id long, ptr string"


def brute(links):
    """node -> (root, depth) by walking; links: node -> pointer."""
    nodes = {n for n in links}
    up = {n: p for n, p in links.items() if p in nodes}
    part = {n for n, p in links.items() if p is not None} | set(up.values())
    out = {}
    for n in part:
        seen, x = [], n
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        if x in seen:
            ring, y = {x}, up[x]
            while y != x:
                ring.add(y)
                y = up[y]
            out[n] = (min(ring), -1)
        else:
            out[n] = (x, len(seen))
    return out


def frame(spark, links):
    return spark.createDataFrame([(n, p, 7, "x") for n, p in links], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_match_a_walk(spark, seed):
    r = random.Random(seed)
    links = {n: r.choice([None, *range(1, 70)]) if r.random() < 0.8 else None for n in range(1, 60)}
    t = hierarchy(frame(spark, [*links.items()] * 2), "id", "up")
    got = {a: (b, c) for a, b, c in rows(t, "node_id", "root_id", "depth")}
    assert got == brute(links)


def test_long_chain_ranges_and_paths(spark):
    links = {n: n + 1 for n in range(1, 300)} | {300: None, 301: 300, 400: 1}
    t = hierarchy(frame(spark, links.items()), "id", "up", with_path=True)
    by = {r["node_id"]: r for r in t.collect()}
    assert by[1]["depth"] == 299 and by[1]["root_id"] == 300 and len(by[1]["path"]) == 300
    assert by[400]["path"][:2] == [400, 1] and by[300]["subtree_size"] == 302
    assert sorted(r["pre"] for r in by.values()) == list(range(302))
    pairs = {(a, b) for a, b, _ in rows(descendants(t))}
    want = {(a, n) for n in by for a in by[n]["path"][1:]}
    assert pairs == want


def test_circles_missing_targets_and_self_pointers(spark):
    t = hierarchy(frame(spark, [(1, 2), (2, 3), (3, 2), (4, 1), (5, 5), (6, 99), (7, None), (None, 1), (8, 6)]), "id", "up")
    assert rows(t, "node_id", "root_id", "depth") == [(1, 2, -1), (2, 2, -1), (3, 2, -1), (4, 2, -1), (5, 5, -1), (6, 6, 0), (8, 6, 1)]
    assert {r["is_cycle"] for r in t.filter("depth < 0").collect()} == {True}


def test_hot_parent_spreads_over_blocks(spark):
    links = [(0, None)] + [(n, 0) for n in range(1, 40_001, 1)]
    t = hierarchy(frame(spark, links), "id", "up")
    assert t.filter("depth = 1").count() == 40_000
    assert t.select("pre").distinct().count() == 40_001


def test_empty_table(spark):
    assert hierarchy(frame(spark, []), "id", "up").count() == 0
    assert descendants(hierarchy(frame(spark, [(1, None)]), "id", "up")).count() == 0
