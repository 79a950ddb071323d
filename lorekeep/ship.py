"""The library's own code on the executors."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; Python workers then import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    holder = tempfile.TemporaryDirectory(prefix="lorekeep-code-")
    atexit.register(holder.cleanup)
    root = Path(__file__).resolve().parent
    target = Path(holder.name) / "lorekeep_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
