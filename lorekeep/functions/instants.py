"""Timestamps written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An offset at the end of the text: Z, +hh, +hhmm or +hh:mm.
OFFSET = r"([Zz]|[+-]\d{2}(:?\d{2})?)$"


def instant(text: Column) -> Column:
    """The instant that ``text`` names, as a timestamp.

    Accepts ``T`` or a space between date and time, an optional fraction and an
    optional offset; a text without offset is UTC whatever the session's zone.
    Anything else, blank and null give null.
    """
    t = F.trim(text)
    # a date alone ends in something like an offset (2025-01-06), so the time part is what decides
    zoned = F.when(F.substring(t, 11, 100).rlike(OFFSET), t).when(F.length(t) > 10, F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(t != "", zoned)
    return zoned.try_cast("timestamp")

