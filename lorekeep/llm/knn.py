"""Most similar vectors for every vector.

Adaptive dimension scan over inverted lists: vectors are brought to length 1 and
rotated, a tree of centroids is fitted on a bounded sample, and every vector is sent to
the lists of its nearest centroids. The number of lists follows the number of vectors,
so a list stays as long as it was, and a list that the sample shows to be long is cut
by its own size. Inside a list, partial distances are computed column block by column
block, and a hypothesis test abandons a candidate as soon as the distance seen so far
rules it out; the rest get their exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.scratch import Scratch

#: Vectors that centroids are fitted on, in one task: eight a list, within these bounds, chosen by a hash of their key.
#: At two sampled vectors a list the sample is used up, at 16.8 million vectors of a dimension; lists grow longer beyond.
LEAST_SAMPLE, SAMPLE = 8192, 65_536
#: Vectors a list should hold, and lists that a vector is compared with.
LIST_SIZE, PROBES = 512, 2
#: Up to so many lists their centroids are compared one by one, else by way of the nearest few of about as many branches as a branch has lists.
FLAT, BRANCHES = 256, 4
#: A set of keys of up to this many rows is broadcast rather than shuffled.
FEW = 100_000
#: A list with more than about so many queries is compared in cells of a part of its candidates and a part of its queries.
CELL = 8192
#: Ends of the column blocks, as parts of the dimension.
BLOCKS = (1 / 12, 1 / 6, 1 / 3, 2 / 3, 1)
#: Strength of the abandoning test: a true neighbour is lost with a chance of about exp(-EPSILON^2).
EPSILON = 2.6


def unpack(payloads: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of usable payloads, their vectors as float32 of length 1)."""
    keep = [i for i, b in enumerate(payloads) if b is not None and len(b) == 4 * dim]
    if not keep:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    x = np.frombuffer(b"".join(bytes(payloads[i]) for i in keep), "<f4").reshape(-1, dim).astype(np.float64)
    with np.errstate(all="ignore"):
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        x = x[ok]
        x /= np.abs(x).max(1, keepdims=True)  # else squares may overflow or vanish
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.array(keep, np.int64)[ok], x.astype(np.float32)


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an empty list takes over a sample vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        spare = x[rng.integers(0, len(x), len(c))]
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), spare).astype(np.float32)
    return c


class Tree(NamedTuple):
    """Centroids of lists, those of a branch side by side, and how many vectors of the sample are nearest to each."""

    branches: np.ndarray
    starts: np.ndarray
    leaves: np.ndarray
    sampled: np.ndarray


def fit_tree(x: np.ndarray, lists: int) -> Tree:
    lists = max(1, min(lists, len(x) // 2))
    if lists <= FLAT:
        branches, parts = x[:0], [fit_centroids(x, lists)]
    else:
        branches = fit_centroids(x, round(lists**0.5))
        at = (x @ branches.T).argmax(1)
        parts = []
        for b in range(len(branches)):
            own = x[at == b]
            n = min(max(1, round(lists * len(own) / len(x))), len(own))
            parts.append(fit_centroids(own, n) if n else branches[b : b + 1])
    starts = np.cumsum([0, *map(len, parts)])
    tree = Tree(branches, starts, np.concatenate(parts), np.zeros(0, np.int64))
    return tree._replace(sampled=np.bincount(nearest_lists(x, tree, 1)[:, 0], minlength=len(tree.leaves)))


def nearest_lists(v: np.ndarray, tree: Tree, probes: int) -> np.ndarray:
    """The ``probes`` nearest lists of each vector, by way of its nearest branches."""
    if not len(tree.branches):
        return np.argsort(-(v @ tree.leaves.T), axis=1, kind="stable")[:, :probes]
    few = min(BRANCHES, len(tree.branches))
    near = np.argsort(-(v @ tree.branches.T), axis=1, kind="stable")[:, :few]
    best = np.full((len(v), few * probes), -2.0, np.float32)
    which = np.zeros((len(v), few * probes), np.int64)
    for b in np.unique(near):
        row, rank = np.nonzero(near == b)
        lo, hi = tree.starts[b], tree.starts[b + 1]
        cos = v[row] @ tree.leaves[lo:hi].T
        n = min(probes, hi - lo)
        top = np.argsort(-cos, axis=1, kind="stable")[:, :n]
        col = rank[:, None] * probes + np.arange(n)
        best[row[:, None], col] = np.take_along_axis(cos, top, 1)
        which[row[:, None], col] = top + lo
    return np.take_along_axis(which, np.argsort(-best, axis=1, kind="stable")[:, :probes], 1)


def scan(q: np.ndarray, c: np.ndarray, floor: float, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, cosine) of all pairs that reach ``floor``, by adaptive dimensions."""
    dim = q.shape[1]
    ends = sorted({max(1, round(dim * b)) for b in BLOCKS})
    far = 2 - 2 * floor  # squared distance at the floor
    out: tuple[list, list, list] = ([], [], [])
    c1 = np.ascontiguousarray(c[:, : ends[0]])
    cn = (c1**2).sum(1)
    limit = lambda d: far * (1 + epsilon / np.sqrt(d)) ** 2 * d / dim if d < dim else far
    for start in range(0, len(q), 512):
        part = q[start : start + 512]
        q1 = np.ascontiguousarray(part[:, : ends[0]])
        near = (q1**2).sum(1)[:, None] + cn - 2 * (q1 @ c1.T)
        qi, ci = np.nonzero(near <= limit(ends[0]))
        d2 = near[qi, ci]
        for lo, hi in zip(ends, ends[1:]):
            for s in range(0, len(qi), 65536):  # bounded memory
                e = slice(s, s + 65536)
                diff = part[qi[e], lo:hi] - c[ci[e], lo:hi]
                d2[e] += np.einsum("ij,ij->i", diff, diff)
            if hi < dim:
                keep = d2 <= limit(hi)
                qi, ci, d2 = qi[keep], ci[keep], d2[keep]
        for s in range(0, len(qi), 65536):
            e = slice(s, s + 65536)
            cos = np.einsum("ij,ij->i", part[qi[e]].astype(np.float64), c[ci[e]].astype(np.float64))
            ok = cos >= floor
            out[0].append(qi[e][ok] + start)
            out[1].append(ci[e][ok])
            out[2].append(cos[ok])
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def top(qi: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best entries of each query: by cosine, then by id."""
    order = np.lexsort((ids, -cos, qi))
    if not len(order):
        return order
    s = qi[order]
    first = np.r_[True, s[1:] != s[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - begin < k]


def _sent(at: np.ndarray, part: np.ndarray, cells: np.ndarray, home: bool, keys: np.ndarray, raw: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows that take vectors to their list, ``home`` to be found there too: one row a vector, but one a cell and role in a list that is cut."""
    whole = cells == 1
    if whole.any():
        zero = np.zeros(int(whole.sum()), np.int32)
        yield pd.DataFrame({"list": at[whole].astype(np.int32), "cp": zero, "qp": zero, "home": home, "asks": True, "key": keys[whole], "vec": raw[whole]})
    cut = np.nonzero(~whole)[0]
    if len(cut):
        i = np.repeat(cut, cells[cut])
        other = np.concatenate([np.arange(c) for c in cells[cut]])
        for asks in (False, True) if home else (True,):
            cp, qp = (other, part[i]) if asks else (part[i], other)
            yield pd.DataFrame({"list": at[i].astype(np.int32), "cp": cp.astype(np.int32), "qp": qp.astype(np.int32), "home": not asks, "asks": asks, "key": keys[i], "vec": raw[i]})


def neighbours(rows: DataFrame, key: str, payload: str, dim: int, k: int = 10, floor: float = 0.8, probes: int = PROBES) -> DataFrame:
    """(key, other, cosine): up to k most similar others of each usable vector, all at or above ``floor``.

    One row per direction. Vectors of equal payload are found by ``copies``; here
    keys must be unique. Payloads of another length, null, with values that are not
    finite or all zero take no part.
    """
    spark = rows.sparkSession
    base = rows.filter(F.octet_length(payload) == 4 * dim).select(F.col(key).alias("key"), F.col(payload).alias("payload"))
    n = base.count()
    empty = spark.createDataFrame([], "key string, other string, cosine double")
    if not n:
        return empty
    lists = max(1, n // LIST_SIZE)
    most = min(max(LEAST_SAMPLE, 8 * lists), SAMPLE)
    few = base.select("payload")
    if n > most:
        # twice the share that is needed, then the smallest hashes
        h = F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("h")
        few = base.select("payload", h).filter(F.col("h") < min(2 * most / n, 1.0) * (1 << 30)).orderBy("h").limit(most).select("payload")
    turn = rotation(dim)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.concatenate([np.zeros((0, dim), np.float32), *(unpack(list(p["payload"]), dim)[1] for p in parts)])
        if len(x):
            t = fit_tree(x @ turn, lists)
            yield pd.DataFrame({"branches": [t.branches.tobytes()], "starts": [t.starts.astype(np.int64).tobytes()], "leaves": [t.leaves.tobytes()], "sampled": [t.sampled.tobytes()]})

    # the sample stays in its task; the centroids, four to eight times fewer, come to the driver and go to every task
    fitted = few.coalesce(1).mapInPandas(fit, "branches binary, starts binary, leaves binary, sampled binary").collect()
    if not fitted:
        return empty
    tree = Tree(*[np.frombuffer(bytes(fitted[0][c]), t) for c, t in (("branches", np.float32), ("starts", np.int64), ("leaves", np.float32), ("sampled", np.int64))])
    tree = tree._replace(branches=tree.branches.reshape(-1, dim), leaves=tree.leaves.reshape(-1, dim))
    probes = min(probes, len(tree.leaves))
    # queries a list will have, by its share of the sample; parts it is cut into
    cells = np.maximum(1, -(-(tree.sampled * (n * probes)) // (max(int(tree.sampled.sum()), 1) * CELL))).astype(np.int64)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep, v = unpack(list(p["payload"]), dim)
            v = v @ turn
            near = nearest_lists(v, tree, probes)
            raw = np.array([r.tobytes() for r in v], dtype=object)
            keys, h = p["key"].to_numpy()[keep], p["h"].to_numpy()[keep]
            for j in range(probes):
                at = near[:, j]
                yield from _sent(at, h % cells[at], cells[at], j == 0, keys, raw)

    sent = base.select("key", "payload", F.xxhash64("key").alias("h")).mapInPandas(route, "list int, cp int, qp int, home boolean, asks boolean, key string, vec binary")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(g["vec"]), np.float32).reshape(-1, dim)
        keys = g["key"].to_numpy()
        ask, cand = np.nonzero(g["asks"].to_numpy())[0], np.nonzero(g["home"].to_numpy())[0]
        if not len(ask) or not len(cand):
            return pd.DataFrame({"key": [], "other": [], "cosine": []})
        qi, ci, cos = scan(v[ask], v[cand], floor)
        a, b = keys[ask][qi], keys[cand][ci]
        other = a != b
        qi, a, b, cos = qi[other], a[other], b[other], cos[other]
        # a pair met from one side counts for both, so it is enough that one of the two probes the other's list
        best, back = top(qi, b.astype(str), cos, k), top(ci[other], a.astype(str), cos, k)
        return pd.DataFrame({"key": np.r_[a[best], b[back]], "other": np.r_[b[best], a[back]], "cosine": np.r_[cos[best], cos[back]]})

    found = sent.groupBy("list", "cp", "qp").applyInPandas(compare, "key string, other string, cosine double")
    found = found.groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def similar_pairs(cache: DataFrame, dims: tuple[int, ...] = (384, 768), k: int = 10, floor: float = 0.8, key: str = "cache_key", payload: str = "payload") -> DataFrame:
    """(key_a, key_b, cosine), key_a < key_b: pairs at or above ``floor`` of which one is among the k most similar of the other.

    Defined cases: only payloads of exactly ``dim`` finite 32-bit floats, not all
    zero, take part; a key counts once (of several payloads that with the smallest
    hash); equal similarities are ranked by key. Keys with the same payload are
    searched once, by their smallest key: with a third of all rows being copies of
    one vector, each still has only its k nearest.
    """
    s = Scratch(cache.sparkSession, "neighbours")
    lengths = [4 * d for d in dims]
    sized = cache.filter(F.octet_length(payload).isin(lengths) & F.col(key).isNotNull())
    rows = sized.select(F.col(key).alias("key"), F.col(payload).alias("payload"), F.xxhash64(payload).alias("h1"), F.xxhash64(F.lit(1), payload).alias("h2"))
    # hashes only: which keys come more than once, which payloads have several keys
    ids = rows.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("h"), F.count(F.lit(1)).alias("rows")).select("key", "h.*", "rows")
    ids = s.save(ids)
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df  # noqa: E731  a checked size; else both sides are shuffled
    groups = ids.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "rep")
    copies = s.save(ids.join(groups, ["h1", "h2"]).select("key", "rep"))
    skip = few(copies.filter("key <> rep").select("key"))
    again = ids.filter("rows > 1").select("key", "h1", "h2")
    once = rows.join(few(again.select("key")), "key", "left_anti")
    several = rows.join(few(again), ["key", "h1", "h2"], "left_semi").dropDuplicates(["key"])
    base = once.unionByName(several.select(*once.columns)).join(skip, "key", "left_anti").select("key", "payload")
    found = None
    for d in dims:
        part = neighbours(base, "key", "payload", d, k, floor)
        found = part if found is None else found.unionByName(part)
    found = s.save(found)

    def usable(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for d in dims:
                keep, _ = unpack(list(p["payload"]), d)
                yield pd.DataFrame({"rep": p["key"].to_numpy()[keep]})

    # copies of an unusable payload are no neighbours; one payload a group is looked at
    reps = base.join(few(copies.select(F.col("rep").alias("key")).distinct()), "key", "left_semi").mapInPandas(usable, "rep string")
    return _with_copies(s, found, s.save(copies.join(reps, "rep", "left_semi")), k)


def _with_copies(s: Scratch, found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Give copies of a vector the neighbours of their representative, and each other."""
    def undirected(df: DataFrame) -> DataFrame:
        return df.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"), "cosine").groupBy("key_a", "key_b").agg(F.max("cosine").alias("cosine"))

    # k + 1 smallest keys of each group of copies stand in for it: no one needs more
    first = Window.partitionBy("rep").orderBy("key")
    lead = s.save(copies.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("key", "rep"))
    hit = found.join(lead.select(F.col("rep").alias("other"), F.col("key").alias("member")), "other", "left")
    seen = hit.select("key", F.coalesce("member", "other").alias("other"), "cosine")
    # every copy asks like its representative, and meets its own group at cosine 1
    asked = seen.join(copies.select(F.col("rep").alias("key"), F.col("key").alias("own")), "key", "left").select(F.coalesce("own", "key").alias("key"), "other", "cosine")
    own = copies.select("key", "rep").join(lead.select(F.col("key").alias("other"), "rep"), "rep").select("key", "other", F.lit(1.0).alias("cosine"))
    rows = asked.unionByName(own).filter("key <> other")
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return undirected(rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
