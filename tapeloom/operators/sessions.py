"""Session calendars: next session, shifts, label dates and schedules.

A calendar has one row per distinct date, so at most a few tens of thousands of
rows whatever the size of the panel. That proven bound is why its windows may
run unpartitioned and why it is the one table broadcast outright.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(dates: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct sorted sessions `(dt, session_no)`, optionally clipped."""
    kept = dates.select(F.col("dt").cast("date").alias("dt")).where("dt is not null")
    if start:
        kept = kept.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        kept = kept.where(F.col("dt") <= F.lit(end).cast("date"))
    return kept.distinct().withColumn("session_no", F.row_number().over(Window.orderBy("dt")).cast("long"))


def with_session_no(df: DataFrame, cal: DataFrame, on: str = "dt") -> DataFrame:
    return df.join(F.broadcast(cal.select(F.col("dt").alias(on), "session_no")), on)


def next_session_map(cal: DataFrame) -> DataFrame:
    """Every session but the last with the one after it."""
    nxt = F.lead("dt").over(Window.orderBy("dt"))
    return cal.select("dt", nxt.alias("next_dt")).where("next_dt is not null")


def shift_sessions(df: DataFrame, cal: DataFrame, n: int, *, on: str = "dt", out: str = "shifted", past_end: str = "null") -> DataFrame:
    """The n-th session strictly after each date.

    `past_end`: `null`, `keep` (the date itself) or `error`.
    """
    days = df.select(F.col(on).alias("_d")).distinct()
    at = Window.orderBy("_d", "_is_query").rowsBetween(Window.unboundedPreceding, 0)
    marks = cal.select(F.col("dt").alias("_d"), "session_no", F.lit(0).alias("_is_query")).unionByName(
        days.select("_d", F.lit(None).cast("long").alias("session_no"), F.lit(1).alias("_is_query")))
    seen = marks.withColumn("_no", F.coalesce(F.max("session_no").over(at), F.lit(0))).where("_is_query = 1")
    target = cal.select(F.col("session_no").alias("_no2"), F.col("dt").alias("_to"))
    found = seen.withColumn("_no2", F.col("_no") + n).join(F.broadcast(target), "_no2", "left").select("_d", "_to")
    joined = df.join(F.broadcast(found), df[on] == found["_d"], "left").drop("_d")
    if past_end == "keep":
        to: Column = F.coalesce("_to", F.col(on))
    elif past_end == "error":
        to = F.coalesce("_to", F.raise_error(F.lit("shift goes past the last session")).cast("date"))
    else:
        to = F.col("_to")
    return joined.withColumn(out, to).drop("_to")


def label_calendar(cal: DataFrame, horizon: int) -> DataFrame:
    """Signal date, entry session (+1) and availability session (+h+1)."""
    w = Window.orderBy("dt")
    out = cal.select(
        F.col("dt").alias("signal_dt"), F.lead("dt", 1).over(w).alias("entry_dt"),
        F.lead("dt", horizon + 1).over(w).alias("available_dt"))
    return out.where("available_dt is not null")


def schedule_flags(cal: DataFrame, every: int, last: DataFrame | None = None) -> DataFrame:
    """Rebalance sessions: by modulus, and by distance from the last event.

    `last` holds event dates `(dt)`; a session is due when at least `every`
    sessions have passed since the latest earlier event (or there was none).
    """
    out = cal.withColumn("by_modulus", (F.col("session_no") - 1) % every == 0)
    if last is None:
        return out
    events = last.select("dt").distinct().withColumn("_e", F.lit(1))
    before = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(F.broadcast(events), "dt", "left").withColumn(
        "_last", F.max(F.when(F.col("_e") == 1, F.col("session_no"))).over(before))
    due = F.col("_last").isNull() | (F.col("session_no") - F.col("_last") >= every)
    return out.withColumn("due", due).drop("_e", "_last")
