"""All queries outside the ``llm`` sub-package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans import composed, details, graphs, lifecycle, memgraph, search, tables, upkeep, writes
from lorekeep.plans.registry import Registry

R = Registry()
for part in (upkeep.R, tables.R, search.R, composed.R, graphs.R, memgraph.R, writes.R, lifecycle.R, details.R):
    for name, f in part.queries.items():
        R.add(name, part.sql.get(name))(f)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return R.queries["weighted_bm25_topk"](spark, folder)
