"""Composed flows over several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import evaluation, rolling, sessions


def daily_ic_slice(bars: DataFrame, dates: DataFrame, *, horizon: int = 5, min_names: int = 3) -> DataFrame:
    """Bars to eligibility, momentum score, forward label and the daily rank
    coefficient, dated by the session at which the label is known."""
    panel = rolling.pit_eligibility(bars, min_days=30, min_amount=10_000)
    panel = panel.withColumn("score", rolling.past_return(5)).withColumn("label", rolling.forward_return(horizon))
    ic = evaluation.daily_ic(panel.where("eligible"), "score", "label", min_names=min_names)
    cal = sessions.calendar(dates)
    known = sessions.label_calendar(cal, horizon).select(F.col("signal_dt").alias("dt"), "available_dt")
    return ic.join(F.broadcast(known), "dt", "left")
