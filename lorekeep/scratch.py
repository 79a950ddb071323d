"""Intermediate tables that cut lineage.

Iterative operators write each round's table to the folder that the cluster
names in ``spark.checkpoint.dir`` and read it back, so the plan stays short, a
lost executor costs one round at most, and the optimizer sees real sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode without a setting."""
    global _local_dir
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        holder = tempfile.TemporaryDirectory(prefix="lorekeep-")
        atexit.register(holder.cleanup)
        _local_dir = holder.name
    return _local_dir


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Folders of this process that are still there, with the configuration that reaches them.
_open: dict[str, tuple] = {}


def clean() -> int:
    """Delete all intermediate tables of this process; results that were not written or collected before are lost.

    Runs at the end of the process. A long-lived driver calls it between jobs, once their results are written.
    """
    n = 0
    for root, (jvm, conf) in list(_open.items()):
        try:
            p = jvm.org.apache.hadoop.fs.Path(root)
            n += bool(p.getFileSystem(conf).delete(p, True))
        except Exception:  # noqa: BLE001  the gateway may be gone already
            pass
        _open.pop(root, None)
    return n


class Scratch:
    """Named tables of one operator run, in a folder of their own, which ``clean`` removes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not _open:
            atexit.register(clean)
        _open[self.root] = (spark._jvm, spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lorekeep_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = getattr(t, "_lorekeep_path", None)
            if path:
                delete(self.spark, path)

    def drop_all(self) -> None:
        delete(self.spark, self.root)
        _open.pop(self.root, None)
