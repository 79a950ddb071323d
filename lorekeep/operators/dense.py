"""Exact vector search, block by block, and int8 quantization."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the corpus and of the queries in one cell of the block plan.
CORPUS_BLOCK, QUERY_BLOCK = 20_000, 2_000
#: Query sets up to this size travel to the corpus, which then stays where it is read.
QUERY_BYTES = 32 << 20


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    qn, cn = q / np.where(nq > 0, nq, 1)[:, None], c / np.where(nc > 0, nc, 1)[:, None]
    return 1 - qn @ cn.T


def _l2(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (q**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (q @ c.T)
    return np.sqrt(np.maximum(d, 0))


METRICS = {"cosine": _cosine, "l2": _l2}


def nearest(d: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest distances of each row, ties to the smaller key."""
    k = min(k, d.shape[1])
    row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((keys[col], d[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(d.shape[0]))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]


def block_knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", group: str | None = None) -> DataFrame:
    """(query, id, distance, rank): the k nearest of every query, exactly.

    ``corpus`` has id and vec, ``queries`` query and vec. A query set of at most
    ``QUERY_BYTES`` goes to every task of the corpus, which keeps the k best of each
    query of its batch; of a larger one, both sides are cut into blocks by a hash and
    each pair of blocks is one matrix product in one task. The k best are merged; no
    pair row is made. With ``group`` (a column of the corpus) the k nearest are found
    within each group. Null vectors and those of another length than the queries' take
    no part; distances are rounded to 9 digits before ranks, ties go to the smaller id.
    A zero vector has cosine distance 1 to everything.
    """
    n_q, dim = queries.filter("vec IS NOT NULL").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    extra = [group] if group else []
    c = corpus.filter(F.size("vec") == dim).select(F.col("id").cast("long").alias("key"), "vec", (F.col(group).cast("string") if group else F.lit("")).alias("g"))
    q = queries.filter(F.size("vec") == dim).select(F.col("query").cast("long").alias("key"), "vec")
    found = _resident(c, q, k, dim, METRICS[metric]) if n_q * dim * 8 <= QUERY_BYTES else _cells(c, q, n_q, k, METRICS[metric])
    w = Window.partitionBy("query", "g").orderBy("distance", "id")
    found = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return found.select("query", "id", "distance", "rank", *[F.col("g").alias(x) for x in extra])


_FOUND = "query long, id long, distance double, g string"


def _best(qk: np.ndarray, qv: np.ndarray, ck: np.ndarray, cv: np.ndarray, cg: np.ndarray, k: int, dist: Callable) -> Iterator[pd.DataFrame]:
    for name in np.unique(cg):
        m = cg == name
        d = np.round(dist(qv, cv[m]), 9)
        row, col = nearest(d, ck[m], k)
        yield pd.DataFrame({"query": qk[row], "id": ck[m][col], "distance": d[row, col], "g": name})


def _resident(c: DataFrame, q: DataFrame, k: int, dim: int, dist: Callable) -> DataFrame:
    rows = q.collect()  # a checked size
    qk = np.array([r["key"] for r in rows], np.int64)
    qv = np.array([r["vec"] for r in rows], np.float64).reshape(-1, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(qk):
                ck = b.column("key").to_numpy(zero_copy_only=False)
                cv = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                cg = b.column("g").to_numpy(zero_copy_only=False).astype(str)
                for out in _best(qk, qv, ck, cv, cg, k, dist):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return c.mapInArrow(scan, _FOUND)


def _cells(c: DataFrame, q: DataFrame, n_q: int, k: int, dist: Callable) -> DataFrame:
    bc, bq = max(1, -(-c.count() // CORPUS_BLOCK)), max(1, -(-n_q // QUERY_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.select("key", "vec", "g", own(bc).alias("bc"), every(bq).alias("bq"), F.lit(False).alias("asks"))
    q = q.select("key", "vec", F.lit("").alias("g"), every(bc).alias("bc"), own(bq).alias("bq"), F.lit(True).alias("asks"))

    def cell(p: pd.DataFrame) -> pd.DataFrame:
        asks = p["asks"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"query": [], "id": [], "distance": [], "g": []})
        keys, (qv, cv) = p["key"].to_numpy(), (np.stack([np.asarray(x, np.float64) for x in p["vec"][m]]) for m in (asks, ~asks))
        return pd.concat(_best(keys[asks], qv, keys[~asks], cv, p["g"].to_numpy()[~asks].astype(str), k, dist))

    return c.unionByName(q).groupBy("bc", "bq").applyInPandas(cell, _FOUND)


def quantize(vec: Column, scale: Column) -> Column:
    """int8 values: round(x * 127 / scale), half away from zero, within -128..127."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x.cast("double") * 127 / scale).cast("int"))))


def scale_of(vec: Column) -> Column:
    """Largest magnitude, at least 1e-9."""
    return F.greatest(F.lit(1e-9), F.aggregate(vec, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))


def dequantize(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda x: x * scale / 127)


def max_pool(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunk hits to the smallest distance per parent."""
    return hits.join(parents, "id").groupBy("query", "parent").agg(F.min("distance").alias("distance"))


def float_vectors(df: DataFrame, key: str, blob: str, dim: int) -> DataFrame:
    """(key, vec) from little-endian 32-bit floats; blobs of another length, with values that are not finite or all zero are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.frombuffer(b"".join(map(bytes, p[blob])), "<f4").reshape(-1, dim).astype("f8")
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pd.DataFrame({key: p[key][ok], "vec": list(x[ok])})

    rows = df.filter(F.octet_length(blob) == 4 * dim).select(key, blob)
    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vec array<double>")


def int8_vectors(df: DataFrame, key: str, blob: str, scale: str) -> DataFrame:
    """(key, vec) from int8 codes and their scale; null blobs and scales are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "vec": [np.frombuffer(bytes(b), "i1").astype("f8") * s / 127 for b, s in zip(p[blob], p[scale])]})

    rows = df.filter(F.col(blob).isNotNull() & F.col(scale).isNotNull()).select(key, blob, scale)
    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vec array<double>")
