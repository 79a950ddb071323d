"""Column expressions for scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Midpoint and steepness by number of query tokens (up to 3, 7, 15, more).
SIGMOID = ((3, 5.0, 0.7), (7, 8.0, 0.6), (15, 10.0, 0.55), (None, 12.0, 0.5))
# Base salience by type, factor by verify state.
TYPE_SALIENCE = {"decision": 1.0, "policy": 1.0, "fix": 0.85, "pattern": 0.85, "preference": 0.75, "fact": 0.7}
STATE_FACTOR = {"verified": 1.1, "stale": 0.7, "invalidated": 0.5, "unprovable": 0.5}


def lookup(values: dict[str, float], key: Column, other: float) -> Column:
    chain = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), values.items(), F)
    return chain.otherwise(other)


def adaptive_sigmoid(score: Column, query_tokens: Column) -> Column:
    """A score in (0, 1); ``score`` is larger for better hits."""
    mid = steep = F
    for most, m, s in SIGMOID[:-1]:
        mid, steep = mid.when(query_tokens <= most, m), steep.when(query_tokens <= most, s)
    mid, steep = mid.otherwise(SIGMOID[-1][1]), steep.otherwise(SIGMOID[-1][2])
    return 1 / (1 + F.exp(-steep * (score - mid)))


def min_max(value: Column, by: list[str]) -> Column:
    """Value on a 0..1 scale within its group; 0 if all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)


def salience(kind: Column, state: Column) -> Column:
    return F.least(F.lit(1.2), F.greatest(F.lit(0.3), lookup(TYPE_SALIENCE, kind, 0.6) * lookup(STATE_FACTOR, state, 1.0)))


def decay(age_days: Column, rate: float = 0.005) -> Column:
    """exp(-rate * age), 1 without a rate; a negative age counts as 0."""
    return F.exp(-rate * F.greatest(age_days, F.lit(0.0))) if rate > 0 else F.lit(1.0)


def rerank_features(title_cover: Column, body_cover: Column, body_bytes: Column) -> Column:
    """Share of query tokens in title and body, and a small bonus for short bodies."""
    return 3.0 * title_cover + 1.5 * body_cover + 0.15 / (1 + F.log1p(body_bytes / 2000.0))
