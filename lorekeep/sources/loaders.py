"""Readers of conversation and evaluation files, generators, captured bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATION = "sample_id string, conversation map<string, string>, qa array<struct<question: string, answer: string, category: int, evidence: array<string>>>"
_TURNS = "array<struct<speaker: string, dia_id: string, text: string>>"


def conversation_turns(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, session, pos, speaker, dia_id, text) of conversations keyed session_N."""
    c = spark.read.schema(CONVERSATION).json(path, multiLine=True)
    s = c.select("sample_id", F.explode("conversation").alias("session", "body")).filter(F.col("session").rlike(r"^session_\d+$"))
    t = s.select("sample_id", "session", F.posexplode(F.from_json("body", _TURNS)).alias("pos", "t"))
    return t.select("sample_id", "session", F.col("pos").cast("long").alias("pos"), "t.*")


def conversation_questions(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.schema(CONVERSATION).json(path, multiLine=True)
    return c.select("sample_id", F.posexplode("qa").alias("pos", "q")).select("sample_id", F.col("pos").cast("long").alias("pos"), "q.*")


def long_memory_turns(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, session, pos, role, content) of arrays of sessions of turns."""
    q = spark.read.schema("question_id string, question_type string, question string, answer string, haystack_sessions array<array<struct<role: string, content: string>>>").json(path, multiLine=True)
    s = q.select("question_id", F.posexplode("haystack_sessions").alias("session", "turns"))
    t = s.select("question_id", F.col("session").cast("long").alias("session"), F.posexplode("turns").alias("pos", "t"))
    return t.select("question_id", "session", F.col("pos").cast("long").alias("pos"), "t.*")


def staleness(spark: SparkSession, path: str) -> DataFrame:
    """Two memories a transition, the stale one first: (id, version, statement, question, gold_answer, anti_answer)."""
    t = spark.read.schema("id string, stale_statement string, current_statement string, question string, gold_answer string, anti_answer string, topic_key string").json(path)
    v = F.explode(F.array(F.struct(F.lit(1).alias("version"), F.col("stale_statement").alias("statement")), F.struct(F.lit(2).alias("version"), F.col("current_statement").alias("statement"))))
    return t.select("id", v.alias("v"), "question", "gold_answer", "anti_answer", "topic_key").select("id", "v.*", "question", "gold_answer", "anti_answer", "topic_key")


def beam(spark: SparkSession, rows: int, persons: int = 20, properties: int = 4, values: int = 10) -> DataFrame:
    """A synthetic corpus of (n, person, property, value, content) by arithmetic on row numbers."""
    n = F.col("id")
    r = spark.range(rows).select(n.alias("n"), F.pmod(n * 7, F.lit(persons)).alias("person"), F.pmod(F.floor(n / persons), F.lit(properties)).alias("property"), F.pmod(n * 13 + 5, F.lit(values)).alias("value"))
    return r.withColumn("content", F.concat(F.lit("person "), "person", F.lit(" has property "), "property", F.lit(" of value "), "value"))


def bullets(docs: DataFrame, key: str, text: str, heading: str = "key learnings") -> DataFrame:
    """(key, pos, bullet): list items below ``## heading``, in any case and with or without a colon, up to the next heading of any level.

    Items begin with -, *, + or a number, at any indentation; equal ones of a document
    count once. ``heading`` is a regular expression. Lines are folded in place, so a
    text never leaves its row. Null texts have no items.
    """
    lines = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")
    opens = lambda x: F.rlike(F.lower(F.rtrim(x)), F.lit(rf"^\s*## \s*({heading})\s*:*$"))
    closes = lambda x: F.rlike(x, F.lit(r"^\s*#{1,6} "))
    item = lambda x: F.trim(F.regexp_extract(x, r"^\s*(?:[-*+] |[0-9]+[.)] )(.*)$", 1))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("items"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.when(opens(x), True).when(closes(x), False).otherwise(acc["inside"])
        found = inside & ~closes(x) & (item(x) != "")
        return F.struct(inside.alias("inside"), F.when(found, F.concat(acc["items"], F.array(item(x)))).otherwise(acc["items"]).alias("items"))

    # only texts that have such a heading are folded
    d = docs.filter(F.lower(text).rlike(rf"(?m)^\s*## \s*({heading})\s*:*\s*$"))
    items = F.array_distinct(F.aggregate(lines, start, step, lambda acc: acc["items"]))
    return d.select(key, F.posexplode(items).alias("pos", "bullet")).withColumn("pos", F.col("pos").cast("long"))


def files(spark: SparkSession, path: str, endings: list[str], most_bytes: int = 262_144, most_chars: int = 50_000) -> DataFrame:
    """(path, text, sync_id) of text files of the given endings: not empty, no NUL byte, at most ``most_bytes`` long."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.filter((F.col("length") > 0) & (F.col("length") <= most_bytes) & F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    f = f.filter(~F.contains(F.col("content").cast("string"), F.lit("\x00")))
    return f.select("path", F.substring(F.col("content").cast("string"), 1, most_chars).alias("text"), F.substring(F.sha2(F.concat_ws("|", "path", F.sha2("content", 256)), 256), 1, 32).alias("sync_id"))
