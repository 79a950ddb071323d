"""Similar names by Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common beginning of up to four characters (if above 0.7)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits_a.append(c)
                break
    m = len(hits_a)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(hits_a, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


def similar_names(names: DataFrame, name: str, least: float, blocks: int = 8) -> DataFrame:
    """(name_a, name_b, similarity), name_a < name_b, at or above ``least``, by pairs of blocks.

    Each pair of blocks is compared in one task; null names take no part.
    """
    n = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("n"), F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("b"))
    left = n.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("n", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y")).distinct()

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        own = sorted(g["n"])
        rows = [(a, b, jaro_winkler(a, b)) for i, a in enumerate(own) for b in own[i + 1 :]]
        return pd.DataFrame([(a, b, round(s, 6)) for a, b, s in rows if round(s, 9) >= least], columns=["name_a", "name_b", "similarity"])

    return left.groupBy("x", "y").applyInPandas(compare, "name_a string, name_b string, similarity double").distinct()
