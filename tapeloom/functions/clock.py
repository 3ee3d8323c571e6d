"""Clock texts and freshness flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """`HH:MM[:SS]` to seconds of the day."""
    part = F.split(text, ":")
    seconds = F.coalesce(F.try_element_at(part, F.lit(3)).cast("int"), F.lit(0))
    return F.element_at(part, 1).cast("int") * 3600 + F.element_at(part, 2).cast("int") * 60 + seconds


def decision_time(text: Column) -> Column:
    """`945.0` or `945` to `0945`."""
    return F.lpad(F.regexp_replace(text, r"\.0$", ""), 4, "0")


def freshness(today: Column, source: Column, max_age: int, *, same_day_ok: bool) -> Column:
    """`fresh`, `future`, `same_day` or `stale` by calendar-day age."""
    age = F.datediff(today, source)
    out = F.when(age < 0, F.lit("future"))
    if not same_day_ok:
        out = out.when(age == 0, F.lit("same_day"))
    return out.when(age > max_age, F.lit("stale")).otherwise(F.lit("fresh"))
