"""Content-addressed chunks of tagged JSON lines, with an append-only manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that agree above these low bits share a chunk, which bounds a chunk's lines.
CHUNK_BITS = 10


def chunk_ids(rows: DataFrame, by: list[str], key: str, line: str, bits: int = CHUNK_BITS) -> DataFrame:
    """(by, part, lines, chunk_id, body): lines in key order, addressed by the first 16 hex digits of their SHA-256."""
    g = rows.groupBy(*by, F.shiftright(key, bits).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.sort_array(F.collect_list(F.struct(key, line))).alias("x"))
    g = g.withColumn("body", F.array_join(F.transform("x", lambda r: r[line]), "\n"))
    return g.select(*by, "part", "lines", F.substring(F.sha2("body", 256), 1, 16).alias("chunk_id"), "body")


def tagged(kind: str, df: DataFrame) -> DataFrame:
    """One JSON line a row, tagged with its kind."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("_kind"), *df.columns)).alias("line"))


def export_chunks(chunks: DataFrame, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Write the chunks that the manifest lacks, gzip-compressed; the rows to append to the manifest."""
    new = chunks if manifest is None else chunks.join(manifest.select("chunk_id"), "chunk_id", "left_anti")
    new.select("chunk_id", "body").write.mode("append").option("compression", "gzip").json(path)
    return new.select("chunk_id", "lines")


def import_chunks(spark: SparkSession, path: str, schema: str, seen: DataFrame | None = None) -> DataFrame:
    """(chunk_id, row): parsed lines of the chunks not seen before; one bad line rejects its whole chunk."""
    c = spark.read.schema("chunk_id string, body string").json(path)
    if seen is not None:
        c = c.join(seen.select("chunk_id"), "chunk_id", "left_anti")
    lines = c.select("chunk_id", F.explode(F.split("body", "\n")).alias("line"))
    parsed = lines.select("chunk_id", F.from_json("line", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row"))
    bad = parsed.filter("row IS NULL OR row._corrupt_record IS NOT NULL").select("chunk_id").distinct()
    return parsed.join(bad, "chunk_id", "left_anti").select("chunk_id", "row.*").drop("_corrupt_record")
