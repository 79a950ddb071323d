"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor; a parameter of all that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts above this many characters are counted in parts cut where the pattern always cuts.
LONG = 200_000
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"lorekeep:{vocabulary}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(text: str, vocabulary: str = VOCABULARY) -> int:
    enc = encoder(vocabulary)
    if len(text) <= LONG:
        return len(enc.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):
        cut = _CUT.search(text, start + LONG)
        end = cut.start() if cut else len(text)
        total += len(enc.encode_ordinary(text[start:end]))
        start = end
    return total


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., tokens, chars), one row a row; a null text has no tokens. Texts do not leave the scan's task."""
    keep = keep or []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["tokens"] = [0 if t is None else count(t, vocabulary) for t in p[text]]
            p["chars"] = [0 if t is None else len(t) for t in p[text]]
            yield p.drop(columns=[text])

    rows = docs.select(F.col(key).cast("long").alias(key), *keep, text).filter(F.col(key).isNotNull())
    fields = [f"`{c}` {t}" for c, t in rows.drop(text).dtypes]
    return rows.mapInPandas(run, ", ".join([*fields, "tokens long", "chars long"]))
