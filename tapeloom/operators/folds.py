"""Walk-forward folds and causal gates over the session calendar.

Calendars, folds and per-date series are small by construction (one row per
session or fold), so their windows need no partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import trailing
from tapeloom.operators.asof import asof_join

FOLD_DATES = ["train_start", "train_end", "valid_start", "valid_end", "test_start", "test_end"]


def walk_forward_folds(cal: DataFrame, *, train: int, valid: int, test: int, step: int, purge: int, embargo: int) -> DataFrame:
    """Expanding train, purge, validation, purge + embargo, test; one row per fold."""
    if min(train, valid, test, step) <= 0 or min(purge, embargo) < 0:
        raise ValueError("window lengths must be positive, gaps not negative")
    lead = train + purge + valid + purge + embargo + test
    total = cal.agg(F.max("session_no").alias("n"))
    number = F.explode(F.when(F.col("n") >= lead, F.sequence(F.lit(0), F.floor((F.col("n") - lead) / step))))
    vs = F.lit(train + purge + 1) + F.col("k") * step
    numbered = total.withColumn("k", number).select(
        (F.col("k") + 1).alias("fold"), F.lit(1).alias("train_start"), (vs - purge - 1).alias("train_end"),
        vs.alias("valid_start"), (vs + valid - 1).alias("valid_end"),
        (vs + valid + purge + embargo).alias("test_start"), (vs + valid + purge + embargo + test - 1).alias("test_end"))
    long = numbered.unpivot(["fold"], FOLD_DATES, "edge", "session_no")
    dated = long.join(F.broadcast(cal), "session_no")
    return dated.groupBy("fold").pivot("edge", FOLD_DATES).agg(F.first("dt"))


def fold_ranges(starts: DataFrame, last: str) -> DataFrame:
    """Fold number, start and end from start dates (the end is the day before the next)."""
    w = Window.orderBy("start_dt")
    end = F.coalesce(F.date_sub(F.lead("start_dt").over(w), 1), F.lit(last).cast("date"))
    return starts.select("start_dt").distinct().select(F.row_number().over(w).alias("fold"), "start_dt", end.alias("end_dt"))


def assign_folds(df: DataFrame, folds: DataFrame, cal: DataFrame, on: str = "dt") -> DataFrame:
    """Fold of each row by date; rows outside every fold are dropped.

    The ranges are resolved on the calendar, so the large side sees one
    broadcast equi join on the date. A date in several ranges takes the last.
    """
    hit = F.broadcast(folds.select("fold", "start_dt", "end_dt"))
    days = cal.select("dt").join(hit, F.col("dt").between(F.col("start_dt"), F.col("end_dt")))
    days = days.groupBy("dt").agg(F.max("fold").alias("fold"))
    return df.join(F.broadcast(days.withColumnRenamed("dt", on)), on)


def anchored_split(cal: DataFrame, test_start: str, *, purge: int, valid_fraction: float, min_valid: int,
                   calib_fraction: float = 0.0, min_calib: int = 0) -> DataFrame:
    """Role of each session before the test: fit, valid, calib or purged."""
    before = cal.where(F.col("dt") < F.lit(test_start).cast("date"))
    back = before.withColumn("_back", F.row_number().over(Window.orderBy(F.col("dt").desc())))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - purge
    back = back.withColumn("_n", n)
    calib = F.greatest(F.lit(min_calib), F.ceil(F.col("_n") * calib_fraction)) if calib_fraction or min_calib else F.lit(0)
    valid = F.greatest(F.lit(min_valid), F.ceil((F.col("_n") - calib) * valid_fraction))
    pos = F.col("_back") - purge
    short = valid >= F.col("_n") - calib - 5
    role = (
        F.when(short, F.raise_error(F.lit("not enough sessions before the test")).cast("string"))
        .when(pos <= 0, "purged").when(pos <= calib, "calib").when(pos <= calib + valid, "valid").otherwise("fit")
    )
    return back.select("dt", role.alias("role"))


def causal_health(daily_ic: DataFrame, decisions: DataFrame, *, window: int, min_obs: int, below: float) -> DataFrame:
    """Mean of the last `window` coefficients already available at each decision.

    Input: signal_dt, available_dt, ic. Availability rises with the signal date,
    so the trailing mean is attached to each coefficient and looked up as-of the
    decision; a later label can never be seen.
    """
    f = trailing(Window.orderBy("signal_dt"), window)
    known = daily_ic.where("ic is not null").withColumn("health", F.avg("ic").over(f)).withColumn("known", F.count("ic").over(f))
    known = known.groupBy("available_dt").agg(F.max_by(F.struct("health", "known"), "signal_dt").alias("h"))
    known = known.select("available_dt", "h.health", "h.known")
    out = asof_join(decisions.select("dt").distinct(), known, [], "dt", "available_dt", ["health", "known"])
    enough = F.coalesce((F.col("known") >= min_obs) & (F.col("health") < below), F.lit(False))
    return out.withColumn("known", F.coalesce("known", F.lit(0))).withColumn("trigger", enough)


def trailing_quantile_gate(daily: DataFrame, folds: DataFrame, score: str, *, lookback: int, quantile: float) -> DataFrame:
    """Per fold the quantile of the last `lookback` earlier dates; gate the test dates.

    Input `daily`: dt and the score; `folds`: fold, start_dt, end_dt.
    """
    w = Window.orderBy("dt")
    days = daily.withColumn("_no", F.row_number().over(w))
    before = days.join(F.broadcast(folds), F.col("dt") < F.col("start_dt")).withColumn(
        "_back", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("dt").desc())))
    limits = before.where(F.col("_back") <= lookback).groupBy("fold").agg(
        F.percentile(score, F.lit(quantile)).alias("threshold"), F.count(F.lit(1)).alias("history"))
    tests = days.join(F.broadcast(folds), F.col("dt").between(F.col("start_dt"), F.col("end_dt")))
    out = tests.join(F.broadcast(limits), "fold").withColumn("margin", F.col(score) - F.col("threshold"))
    return out.withColumn("enabled", F.col("margin") >= 0).drop("_no", "start_dt", "end_dt")
