"""Sources mixed to target weights.

Efraimidis-Spirakis sampling: each document gets an exponential key scaled by its
quality weight, documents are sorted by key within their source, and the prefix sums
of their tokens are cut at the source's budget. Complete epochs of a source come
before the fractional selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.prefix import block_prefix_sum
from lorekeep.scratch import Scratch

#: Rows that a prefix-sum window may hold on average.
SUM_BLOCK = 50_000


def source_name(c: Column) -> Column:
    """One spelling of a source: outer spaces, case and ``-`` for ``_`` do not count."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def quality(chars: Column, tokens: Column) -> Column:
    """A weight in [0.1, 1]: characters a token against 4; noise needs many tokens a character."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), chars / (4 * tokens)))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``docs``: doc_id, source, tokens, chars. ``targets``: source, target_share,
    max_repeats (a small table, one row a source). Without ``total_tokens`` the
    mixture is as large as it can be with every share held: the least of
    ``max_repeats * tokens / target_share`` over the sources that have documents.
    With it, a source that cannot reach its budget gives all it may.

    Mixture: doc_id, source, tokens, copies, used_tokens; only documents that are
    used. Report: source, target_share, max_repeats, documents, available_tokens,
    budget_tokens, used_tokens, actual_share.

    Defined cases: documents of unlisted or null sources, without tokens or with a
    null id are left out; of repeated ids one row holds; a source without documents
    has actual_share 0; ties of keys are settled by id; the document across the
    edge of a budget is used if that brings the source nearer to it.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "mixing")
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).filter("target_share > 0 AND max_repeats > 0").dropDuplicates(["source"])
    d = docs.withColumn("source", source_name(F.col("source"))).filter("doc_id IS NOT NULL AND tokens > 0")
    d = d.groupBy("doc_id").agg(F.max(F.struct("source", "tokens", "chars")).alias("r")).select("doc_id", "r.*").join(F.broadcast(t.select("source")), "source")
    d = s.save(d)
    have = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"))
    rows = t.join(have, "source", "left").na.fill(0, ["documents", "available_tokens"]).collect()  # one row a listed source
    size = total_tokens or int(min((r["max_repeats"] * r["available_tokens"] / r["target_share"] for r in rows if r["available_tokens"]), default=0))
    plan = []
    for r in rows:
        have_t, most = r["available_tokens"], r["max_repeats"]
        budget = int(r["target_share"] * size)
        epochs = min(budget // have_t, most) if have_t else 0
        plan.append((r["source"], r["target_share"], most, r["documents"], have_t, budget, epochs, 0 if epochs == most else budget - epochs * have_t))
    schema = "source string, target_share double, max_repeats long, documents long, available_tokens long, budget_tokens long, epochs long, part_tokens long"
    plan_df = spark.createDataFrame(plan, schema)

    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    k = d.withColumn("key", -F.log(u) / quality(F.col("chars"), F.col("tokens")))
    blocks = sum(r[3] for r in plan) // SUM_BLOCK + 1
    block = F.least(F.floor(F.lit(blocks) * (1 - F.exp(-F.col("key")))), F.lit(blocks - 1))  # rises with the key
    k = block_prefix_sum(k, ["source"], block, [F.col("key"), F.col("doc_id")], F.col("tokens"), "before")
    k = k.join(F.broadcast(plan_df.select("source", "epochs", "part_tokens")), "source")
    after = F.col("before") + F.col("tokens")
    part = (after <= F.col("part_tokens")) | ((F.col("before") < F.col("part_tokens")) & (after - F.col("part_tokens") < F.col("part_tokens") - F.col("before")))
    k = k.withColumn("copies", F.col("epochs") + F.when(part, 1).otherwise(0)).filter("copies > 0")
    mixture = s.save(k.select("doc_id", "source", "tokens", "copies", (F.col("copies") * F.col("tokens")).alias("used_tokens")))

    used = mixture.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"))
    total = mixture.agg(F.greatest(F.sum("used_tokens"), F.lit(1)).alias("all_tokens"))
    report = plan_df.join(used, "source", "left").na.fill(0, ["used_tokens"]).join(F.broadcast(total))
    report = report.select("source", "target_share", "max_repeats", "documents", "available_tokens", "budget_tokens", "used_tokens", F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    return mixture, report
