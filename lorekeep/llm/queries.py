"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.components import components
from lorekeep.llm.knn import similar_pairs
from lorekeep.llm.mixing import mix
from lorekeep.llm.neardup import NearDuplicates
from lorekeep.llm.packing import pack
from lorekeep.llm.pii import find_personal, redact_personal
from lorekeep.llm.skeleton import look_alike_classes, look_alike_pairs, skeletons
from lorekeep.llm.tokens import token_counts
from lorekeep.plans.registry import Registry, table
from lorekeep.scratch import Scratch
from lorekeep.sources.memory import once

R = Registry()

_GROUPS = """
WITH RECURSIVE e AS (
  SELECT keep_id AS a, drop_id AS b FROM dream_proposals WHERE keep_id <> drop_id
  UNION SELECT drop_id, keep_id FROM dream_proposals WHERE keep_id <> drop_id),
v AS (SELECT DISTINCT unnest([keep_id, drop_id]) AS id FROM dream_proposals),
reach AS (
  SELECT id, id AS other FROM v WHERE id IS NOT NULL
  UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
g AS (SELECT id AS record_id, min(other) AS group_id FROM reach GROUP BY id)
"""


@R.add("p3_found", _GROUPS + "SELECT record_id, group_id FROM g")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "dream_proposals"), "keep_id", "drop_id")


@R.add("p3_sizes", _GROUPS + ", s AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1) SELECT n AS group_size, count(*) AS n_groups FROM s GROUP BY 1")
def p3_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups there are of each size."""
    g = components(table(spark, folder, "dream_proposals"), "keep_id", "drop_id")
    return g.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


@R.add("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_pairs(table(spark, folder, "documents"))


@R.add("p10_classes")
def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a look-alike class with the class and its number of different partners."""
    c = look_alike_classes(table(spark, folder, "documents")).distinct()
    texts = c.groupBy("class_id", "text_hash").agg(F.count(F.lit(1)).alias("same"))
    sizes = texts.groupBy("class_id").agg(F.sum("same").alias("members"))
    out = c.join(texts, ["class_id", "text_hash"]).join(sizes, "class_id")
    return out.select("doc_id", "class_id", (F.col("members") - F.col("same")).alias("links"))


@R.add("p10_forms")
def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that is not blank in its one consistent form; texts that look alike have the same."""
    return skeletons(table(spark, folder, "documents")).select("doc_id", F.col("skeleton").alias("form"))


def sized_documents(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """doc_id, source, tokens, chars of all documents, counted once and written."""
    counted = token_counts(table(spark, folder, "documents"), "doc_id", "text", ["source"])
    return Scratch(spark, label).save(counted)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = sized_documents(spark, folder, "sizes")
    out = None
    for b in table(spark, folder, "token_budgets").collect():  # a fixed table of three rows
        part = pack(docs, b["capacity_tokens"]).select(F.lit(b["budget_name"]).alias("budget_name"), F.lit(b["capacity_tokens"]).cast("long").alias("capacity"), "container_id", "doc_id", "piece", "start_token", F.col("size").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("p8_pack")
def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one above the capacity, with its container, for each budget."""
    return _packed(spark, folder).drop("capacity")


@R.add("p8_report")
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least number possible by total size, and the share filled."""
    p = _packed(spark, folder)
    c = p.groupBy("budget_name", "capacity", "container_id").agg(F.sum("tokens").alias("used"))
    r = c.groupBy("budget_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return r.select("budget_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))


@R.add("p9_mix")
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mix(sized_documents(spark, folder, "sizes"), table(spark, folder, "source_targets"))[0]


@R.add("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix(sized_documents(spark, folder, "sizes"), table(spark, folder, "source_targets"))[1]


# little-endian floats read from hex digits, every pair compared
_CLOSE = """
WITH hx AS (SELECT cache_key, octet_length(payload) // 4 AS dim, any_value(hex(payload)) AS h FROM embedding_cache WHERE octet_length(payload) IN (1536, 3072) GROUP BY 1, 2),
bits AS (SELECT cache_key, dim, list_transform(range(0, dim), lambda i: ('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::UBIGINT::BIGINT) AS w FROM hx),
v AS (SELECT cache_key AS k, dim, list_transform(w, lambda b: (CASE WHEN b >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (8388608 + b % 8388608) * pow(2.0::DOUBLE, (b // 8388608) % 256 - 150)) AS vec FROM bits
 WHERE len(list_filter(w, lambda b: (b // 8388608) % 256 = 255)) = 0 AND len(list_filter(w, lambda b: b % 2147483648 <> 0)) > 0),
d AS (SELECT a.k AS x, b.k AS y, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine FROM v a JOIN v b ON a.dim = b.dim AND a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS rank FROM d WHERE cosine >= 0.8),
near AS (SELECT DISTINCT least(x, y) AS key_a, greatest(x, y) AS key_b, cosine FROM r WHERE rank <= 10)
"""


@R.add("p5_found", _CLOSE + "SELECT DISTINCT key_a, key_b FROM near")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "embedding_cache")).select("key_a", "key_b")


@R.add("p5_degrees")  # no twin: similarities of 32-bit vectors differ from SQL's in the sixth digit
def p5_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector that has similar others: how many, and the highest similarity."""
    p = similar_pairs(table(spark, folder, "embedding_cache"))
    both = p.select(F.col("key_a").alias("cache_key"), "cosine").unionByName(p.select(F.col("key_b").alias("cache_key"), "cosine"))
    return both.groupBy("cache_key").agg(F.count(F.lit(1)).alias("links"), F.round(F.max("cosine"), 6).alias("nearest"))


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return NearDuplicates(table(spark, folder, "observations"), "id", text, least=0.6)


_SIMILAR = """
WITH o AS (SELECT DISTINCT id, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS t FROM observations), w AS (SELECT id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM o),
k AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS both_n FROM k a JOIN k b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE both_n >= 0.6 * (x.n + y.n - both_n))
"""


@R.add("p6_found", _SIMILAR + "SELECT id_a, id_b FROM near")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).record_pairs()


@R.add("p6_classes", _SIMILAR + """
, m AS (SELECT o.id, min(o.id) OVER (PARTITION BY t) AS class_key, count(*) OVER (PARTITION BY t) - 1 AS copies, coalesce(n.n, 0) AS n FROM o LEFT JOIN n ON n.id = o.id),
e AS (SELECT DISTINCT a.class_key AS x, b.class_key AS y FROM near JOIN m a ON a.id = id_a JOIN m b ON b.id = id_b WHERE a.class_key <> b.class_key), l AS (SELECT v, count(*) AS links FROM (SELECT x AS v, y AS u FROM e UNION SELECT y, x FROM e) GROUP BY 1)
SELECT m.id, m.class_key, m.copies, coalesce(l.links, 0) AS links FROM m LEFT JOIN l ON l.v = m.class_key WHERE m.n > 0 AND (m.copies > 0 OR l.links > 0)
""")  # fmt: skip
def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each near-duplicate observation with its class of copies and its number of similar classes."""
    return _near(spark, folder).class_links().withColumnRenamed("key", "id")


@R.add("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(once(table(spark, folder, "observations"), "id"), table(spark, folder, "name_lexicon"))


@R.add("p2_redacted")
def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every note with typed placeholders in place of personal information."""
    return redact_personal(once(table(spark, folder, "observations"), "id"), table(spark, folder, "name_lexicon"))
