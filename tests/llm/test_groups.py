import random

import pytest
from conftest import rows

from lorekeep.llm import components as comp


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(up))


def groups(spark, pairs):
    df = spark.createDataFrame([(a, b, 5, "v") for a, b in pairs], "l long, r long, record_id int, group_id string")
    return rows(comp.components(df, "l", "r"), "record_id", "group_id")


@pytest.mark.parametrize("seed", range(2))
def test_random_pairs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(1, 150), r.randint(1, 150)) for _ in range(90)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:10] + [(None, 7), (8, None), (9, 9), (None, None)]
    assert groups(spark, pairs) == brute(pairs)


def test_long_chain_and_hub(spark):
    ids = list(range(100, 400))
    random.Random(2).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    hub = [(5000, 6000 + i) for i in range(500)]
    assert groups(spark, chain + hub) == brute(chain + hub)
    joined = chain + hub + [(ids[-1], 6001)]  # the search from the hub is cut short on the chain
    assert groups(spark, joined) == brute(joined)


def test_nothing_to_link(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, None), (None, 2), (3, 3)]) == [(1, 1), (2, 2), (3, 3)]
