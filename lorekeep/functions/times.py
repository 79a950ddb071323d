"""Time ranges named in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What shows that a text names a time, and how many days relative phrases reach back.
CUES = ["yesterday", "last week", "last weekend", "last month", "last year", "today", "this week", "this month", "ago", "in 20", "before ", "after ", "on 20"]
REACH = {"this week": 7, "last week": 14, "this month": 31, "last month": 62, "last year": 730}
#: Days that a text reaches back which names a time that cannot be read.
UNREAD = 90


def named_day(low: Column) -> Column:
    """The first ISO date of a text in lower case, else the first day of the year of ``in 20..``; null without one."""
    valid = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"(?=(\d{4}-\d{2}-\d{2}))"), F.lit(1)), lambda x: x.try_cast("date")), lambda x: x.isNotNull())
    year = F.regexp_extract(low, r"in (20.{2})", 1)
    return F.coalesce(F.get(valid, F.lit(0)), F.when(year.rlike(r"^\d{4}$"), F.concat(year, F.lit("-01-01"))).try_cast("date"))


def inferred_range(text: Column, now: Column) -> Column:
    """(start, end) that a text names, as timestamps, null without a cue or a date.

    Relative phrases win over dates; a cue that leads to neither means the last 90 days.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    cued = t.rlike("|".join(CUES))
    day = named_day(t)
    today = now.cast("date")
    sunday = F.date_sub(today, F.weekday(today) + 1)
    back = lambda days: F.struct((now - F.make_dt_interval(F.lit(days))).alias("start"), now.alias("end"))
    last = F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))
    days = lambda lo, hi: F.struct(lo.cast("timestamp_ntz").alias("start"), (hi.cast("timestamp_ntz") + last).alias("end"))
    has = lambda phrase: F.contains(t, F.lit(phrase))
    out = F.when(~cued & day.isNull(), None).when(has("yesterday"), days(F.date_sub(today, 1), F.date_sub(today, 1))).when(has("today"), days(today, today))
    out = out.when(has("last weekend"), days(F.date_sub(sunday, 1), sunday))
    for phrase, reach in REACH.items():
        out = out.when(has(phrase), back(reach))
    return out.when(day.isNotNull(), days(day, day)).otherwise(back(UNREAD))
