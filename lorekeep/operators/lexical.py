"""Phrase and bag-of-words retrieval scored by BM25.

One pass over the corpus keeps, for each document, its size and what follows at the few
positions where a phrase may begin; that table is written, and hits, document
frequencies and statistics are read from it. Phrases meet positions by an equality join
on their first word. Texts are never shuffled, and counts are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import query_terms, tokens
from lorekeep.scratch import Scratch

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Up to so many first words are looked up inside a document's words, before positions become rows.
FEW_HEADS = 20_000
#: A query set of up to so many phrases is broadcast.
FEW_PHRASES = 200_000


def _phrase(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def phrase_table(queries: DataFrame, query: str, text: str, tiered: bool = False) -> DataFrame:
    """(query, phrase, words): the whole text as one phrase.

    ``tiered`` takes the query's terms instead: all of them as one phrase, each two
    neighbours, and each alone; of a single term just itself.
    """
    if not tiered:
        out = queries.select(F.col(query).alias("query"), _phrase(F.col(text)).alias("phrase"))
    else:
        q = queries.select(F.col(query).alias("query"), query_terms(F.col(text)).alias("t"))
        pairs = F.when(F.size("t") >= 2, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.array_join(F.slice("t", i, 2), " ")))
        whole = F.when(F.size("t") >= 2, F.array(F.array_join("t", " ")))
        none = F.array().cast("array<string>")
        out = q.select("query", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(pairs, none), "t")).alias("phrase")).select("query", _phrase(F.col("phrase")).alias("phrase"))
    return out.filter("phrase <> ''").withColumn("words", F.size(F.split("phrase", " "))).distinct()


def matched(df: DataFrame, key: str, columns: dict[str, float], phrases: DataFrame) -> DataFrame:
    """(doc, size, tails): size is the number of tokens in all columns; tails has (tail, weight) for each position where a phrase may begin, as many words as the longest phrase."""
    n, most = phrases.agg(F.count(F.lit(1)), F.coalesce(F.max("words"), F.lit(1))).first()
    heads = None
    if n <= FEW_PHRASES:
        first = phrases.select(F.substring_index("phrase", " ", 1).alias("head")).distinct().limit(FEW_HEADS + 1).collect()
        heads = [r["head"] for r in first] if len(first) <= FEW_HEADS else None

    def tails(c: str, weight: float) -> Column:
        at = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(F.array().cast("array<int>"))
        if heads is not None:
            at = F.filter(at, lambda i: F.element_at(c, i).isin(heads))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(c, i, most), " ").alias("tail"), F.lit(float(weight)).alias("weight")))

    t = df.select(F.col(key).alias("doc"), *[tokens(F.col(c)).alias(c) for c in columns])
    size = sum(F.size(c) for c in columns).cast("double")
    return Scratch(df.sparkSession, "phrases").save(t.select("doc", size.alias("size"), F.concat(*[tails(c, w) for c, w in columns.items()]).alias("tails")))


def phrase_hits(corpus: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query, phrase, doc, size, hits): weighted counts of each phrase in the documents of ``matched``."""
    tails = corpus.select("doc", "size", F.explode("tails").alias("x")).select("doc", "size", "x.tail", "x.weight")
    tails = tails.withColumn("head", F.substring_index("tail", " ", 1))
    wanted = phrases.select("query", "phrase", F.substring_index("phrase", " ", 1).alias("head"))
    small = phrases.count() <= FEW_PHRASES  # a checked size; larger query sets are shuffled by first word
    found = tails.join(F.broadcast(wanted) if small else wanted, "head")
    found = found.filter(F.startswith(F.concat("tail", F.lit(" ")), F.concat("phrase", F.lit(" "))))
    return found.groupBy("query", "phrase", "doc", "size").agg(F.sum("weight").alias("hits"))


def bm25(corpus: DataFrame, hits: DataFrame, bag: bool = False) -> DataFrame:
    """(query, doc, score): higher is better. ``bag`` adds met, the number of the query's phrases that a document has."""
    n = corpus.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("size").alias("avg_size"))
    df = hits.groupBy("phrase").agg(F.countDistinct("doc").cast("double").alias("n_hit"))
    s = hits.join(df, "phrase").crossJoin(F.broadcast(n))  # one row of statistics
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5)))
    part = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    out = s.groupBy("query", "doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("met"))
    return out if bag else out.drop("met")


def search(df: DataFrame, key: str, columns: dict[str, float], phrases: DataFrame, bag: bool = False) -> DataFrame:
    """(query, doc, score) of all documents that meet a phrase of the query."""
    corpus = matched(df, key, columns, phrases)
    return bm25(corpus, phrase_hits(corpus, phrases), bag)


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
