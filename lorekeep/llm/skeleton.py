"""One consistent form for texts that look alike.

Confusables skeleton: compatibility decomposition, every character replaced by the
prototype of its look-alike class, decomposition again; texts with equal skeletons
form a group. Letter case, digits and accents keep their difference, which is why the
published classes (they put l, 1 and I together) give prototypes only to letters of
other alphabets, and only the plain letter of the same case.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.scratch import Scratch

# Letters of other scripts and the Latin letter that readers see, and punctuation; they go before the published classes.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F", "Ӏ": "l", "Һ": "h", "Ѵ": "V",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ԍ": "g",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin letters
    "Տ": "S", "Օ": "O", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "զ": "q",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "Y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ǃ": "!",
    # punctuation
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹘": "-", "’": "'", "‘": "'", "‛": "'", "′": "'", "ʼ": "'", "ʹ": "'",
    "“": '"', "”": '"', "‟": '"', "″": '"', "∶": ":", "ː": ":", "։": ":", "⁄": "/", "∕": "/", "‚": ",", "∗": "*", "⁎": "*",
}


#: Compatibility forms that readers tell from the plain characters: raised, lowered, circled and squared ones, fractions.
APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")


def published_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters outside ASCII and their plain letter, from the look-alike data of the Unicode library that Spark brings along.

    A letter takes the ASCII letter of its class that has its case (one without case
    takes the capital, else the small letter); classes without such a letter, digits
    and signs give nothing. One call to the driver's JVM for all letters.
    """
    kinds = {c: unicodedata.category(c) for c in map(chr, range(0x80, 0x20000))}
    # ideographs and syllables look like no Latin letter; what can be decomposed is, before prototypes are looked up
    letters = [c for c, k in kinds.items() if k in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and not "\u3400" <= c < "\ua000" and not "\uac00" <= c < "\ud7a4"]
    plain = [chr(c) for c in range(33, 127)]
    classes = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(plain + letters)).split("\n")
    members: dict[str, list[str]] = {}
    for c, k in zip(plain, classes):
        if c.isalpha():
            members.setdefault(k, []).append(c)
    out = {}
    for c, k in zip(letters, classes[len(plain) :]):
        upper, lower = ([m for m in members.get(k, []) if m.isupper() == big] for big in (True, False))
        fits = {"Lu": upper, "Ll": lower, "Lo": upper or lower}[kinds[c]]
        if fits:
            out[c] = fits[0]
    return out | LOOK_ALIKES


class Prototypes(dict):
    """Code point -> prototypes of its decomposition, filled as characters are met."""

    def __init__(self, look_alikes: dict[str, str] = LOOK_ALIKES):
        super().__init__()
        self.look_alikes = look_alikes

    def prototype(self, c: str) -> str:
        """The prototype of one character that cannot be decomposed."""
        cp, kind = ord(c), unicodedata.category(c)
        if c in self.look_alikes:
            return self.look_alikes[c]
        if kind == "Zs":
            return " "
        if kind == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF:
            return ""  # format characters, fillers and variation selectors
        return c

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        apart = unicodedata.decomposition(c).startswith(APART)
        parts = c if apart or c in self.look_alikes else unicodedata.normalize("NFKD", c)
        out = "".join(self.prototype(x) for x in parts)
        self[cp] = out
        return out


_FIXED = Prototypes()


def skeleton(text: str, table: Prototypes = _FIXED) -> str:
    """The skeleton of one text; equal for texts that read the same."""
    if text.isascii():
        return text
    out = text.translate(table)
    return out if out.isascii() else unicodedata.normalize("NFD", out)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def skeletons(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, skeleton, text_hash, skeleton_hash) of every text that is not null or blank.

    Blank means nothing but spaces and invisible characters. Repeated rows are
    kept; other columns are dropped.
    """

    known = published_look_alikes(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        protos = Prototypes(known)
        for p in parts:
            sk = [skeleton(t, protos) for t in p[text]]
            yield pd.DataFrame({key: p[key], "skeleton": sk, "text_hash": [_digest(t) for t in p[text]], "skeleton_hash": [_digest(x) for x in sk]})

    rows = docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text)
    out = rows.mapInPandas(run, f"{key} long, skeleton string, text_hash binary, skeleton_hash binary")
    return out.filter(F.trim(F.regexp_replace("skeleton", r"\s", "")) != "")


def look_alike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, class_id): documents whose text reads like another, different text.

    class_id is the smallest key of the class. Only digests are shuffled. Exact
    copies stay in the result but do not make a class by themselves.
    """
    h = Scratch(docs.sparkSession, "skeleton").save(_digests(docs, key, text))
    c = h.groupBy("skeleton_hash").agg(F.min(key).alias("class_id"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
    c = c.filter("lo <> hi").select("skeleton_hash", "class_id")
    return h.join(c, "skeleton_hash").select(key, "text_hash", "class_id")


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, skeleton_hash) without the texts."""

    known = published_look_alikes(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        protos = Prototypes(known)
        for p in parts:
            own, like, keys = [], [], []
            for k, t in zip(p[key], p[text]):
                sk = skeleton(t, protos)
                if not sk or sk.isspace():
                    continue
                keys.append(k)
                own.append(_digest(t))
                like.append(own[-1] if sk is t else _digest(sk))
            yield pd.DataFrame({key: pd.Series(keys, dtype="int64"), "text_hash": own, "skeleton_hash": like})

    rows = docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text)
    return rows.mapInPandas(run, f"{key} long, text_hash binary, skeleton_hash binary")


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): every two documents with different texts of one class, a < b.

    Repeated rows count once; the work beyond the classes is the size of the result.
    """
    c = look_alike_classes(docs, key, text).distinct()
    a = c.select("class_id", F.col(key).alias("doc_id_a"), F.col("text_hash").alias("ha"))
    b = c.select("class_id", F.col(key).alias("doc_id_b"), F.col("text_hash").alias("hb"))
    return a.join(b, "class_id").filter("doc_id_a < doc_id_b AND ha <> hb").select("doc_id_a", "doc_id_b").distinct()
