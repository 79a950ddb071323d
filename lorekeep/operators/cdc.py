"""A table kept current from a feed of inserts, updates and deletes.

Bucketed copy-on-write: the base is hashed by key into buckets, a batch of changes
is routed to them, only touched buckets are merged and rewritten, and a new
manifest is committed by one rename. Readers see the old or the new version whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a bucket should hold; at four times as many the table is hashed into more buckets.
BUCKET_ROWS = 500_000


@contextmanager
def shuffled_into(spark: SparkSession, n: int) -> Iterator[None]:
    """Plans made inside shuffle into ``n`` partitions."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


class BucketTable:
    """``key`` -> its newest change, with tombstones, under ``path``.

    ``order`` names the columns that decide which of two changes of a key is the
    newer (the first decides, later ones break ties; null is oldest). The columns
    must make changes that differ in content comparable; whole ties keep either
    copy.

    A bucket is a partition of Spark's own hash of the key, so what comes out of the
    shuffle by key is already routed: each side of a merge moves once, and a bucket
    is written by one task. Without ``buckets`` their number follows the number of
    keys, and the table is hashed anew when it has outgrown them. It bounds what a
    commit collects to the driver: at most that many bucket numbers.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int | None = None):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # manifests -----------------------------------------------------------------
    def _p(self, path: str):
        p = self._fs.Path(path)
        return p.getFileSystem(self._conf), p

    def versions(self) -> list[int]:
        fs, p = self._p(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "files": {}, "schema": None}
        fs, p = self._p(f"{self.path}/manifests/v{version or found[-1]}.json")
        src = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
        finally:
            src.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        name = f"v{manifest['version']}.json"
        fs, tmp = self._p(f"{self.path}/manifests/.{name}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()
        _, to = self._p(f"{self.path}/manifests/{name}")
        if fs.exists(to) or not fs.rename(tmp, to):
            raise RuntimeError(f"another writer committed {name} first; apply the changes again")

    # reads ---------------------------------------------------------------------
    def _bucket(self, n: int) -> Column:
        return F.pmod(F.hash(self.key), F.lit(n))  # the partition of a shuffle by key

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        paths = [p for b, p in manifest["files"].items() if only is None or int(b) in only]
        if manifest["schema"] is None or (only is not None and not paths):
            return None
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def history(self, version: int | None = None) -> DataFrame | None:
        """Every key with its newest change, deleted ones too."""
        return self._read(self.manifest(version))

    # writes --------------------------------------------------------------------
    def newest(self, changes: DataFrame) -> DataFrame:
        """One row a key; equal keys meet map-side first, so a hot key costs a row a task."""
        rest = [c for c in changes.columns if c != self.key]
        ordering = F.struct(*[F.col(c) for c in self.order], F.xxhash64(*rest).alias("__tie"))
        return changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), ordering).alias("__r")).select(self.key, "__r.*")

    def _wanted(self, keys: int) -> int:
        n = 8
        while n * BUCKET_ROWS < keys:
            n *= 2
        return n

    def _write(self, rows: DataFrame, folder: str, n: int) -> dict[str, str]:
        out = rows.withColumn("bucket", self._bucket(n))
        with shuffled_into(self.spark, n):
            out.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {str(b): f"{folder}/bucket={b}" for b in self._listed(f"{self.path}/{folder}")}

    def apply(self, changes: DataFrame) -> int:
        """Merge a batch, in any order and with repetitions; the new version number.

        Rows with a null key are left out. An empty batch commits nothing.
        """
        old = self.manifest()
        changes = changes.filter(F.col(self.key).isNotNull())
        version, schema = old["version"] + 1, changes.schema.jsonValue()
        folder, staged = f"data/v{version}", f"staged/v{version}"
        n = old.get("buckets") or self.buckets or self._wanted(changes.count())
        batch = self.newest(changes)
        if not old["files"]:
            files, keys = self._write(batch, folder, n), None
            if not files:
                return old["version"]
        else:
            # the batch is routed; only buckets that it reaches are read, merged and replaced
            touched = self._write(batch, staged, n)
            if not touched:
                return old["version"]
            keys = old["keys"] + self._read({"files": touched, "schema": schema}).count()
            kept = {b: p for b, p in old["files"].items() if b not in touched}
            if not self.buckets and keys > 4 * n * BUCKET_ROWS:
                n, kept = self._wanted(keys), {}
            base = self._read(old, None if not kept else {int(b) for b in touched})
            batch = self._read({"files": touched, "schema": schema})
            if base is not None:
                batch = self._merge(base.select(*changes.columns), batch)
            else:
                batch = batch.repartition(n, self.key)
            files = kept | self._write(batch, folder, n)
        if keys is None or base is not None:
            keys = self._read({"files": files, "schema": schema}).count()  # read from the files' footers
        self._commit({"version": version, "files": files, "schema": schema, "buckets": n, "keys": keys})
        fs, p = self._p(f"{self.path}/staged")
        fs.delete(p, True)
        return version

    def _merge(self, base: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c != self.key]
        b = base.select(self.key, F.struct(*rest).alias("__b"), F.struct(*self.order, F.xxhash64(*rest)).alias("__bo"))
        n = batch.select(self.key, F.struct(*rest).alias("__n"), F.struct(*self.order, F.xxhash64(*rest)).alias("__no"))
        both = b.join(n.hint("merge"), self.key, "full")
        newer = F.col("__bo").isNull() | (F.col("__no").isNotNull() & (F.col("__no") > F.col("__bo")))
        return both.select(self.key, F.when(newer, F.col("__n")).otherwise(F.col("__b")).alias("__r")).select(self.key, "__r.*")

    def _listed(self, path: str) -> list[int]:
        fs, p = self._p(path)
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket="))

    def vacuum(self, keep: int = 1) -> None:
        """Delete data folders that none of the newest ``keep`` manifests names."""
        found = self.versions()
        used = {p.rsplit("/", 1)[0] for v in found[-keep:] for p in self.manifest(v)["files"].values()}
        fs, data = self._p(f"{self.path}/data")
        for f in fs.listStatus(data) if fs.exists(data) else []:
            if f"data/{f.getPath().getName()}" not in used:
                fs.delete(f.getPath(), True)
        for v in found[:-keep]:
            fs.delete(self._p(f"{self.path}/manifests/v{v}.json")[1], False)
