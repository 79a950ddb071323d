"""Named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.functions.text import FOLD_FROM, FOLD_TO

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: SQL of the search tokens of a text.
TOKENS = f"regexp_extract_all(translate(lower(coalesce({{0}}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
