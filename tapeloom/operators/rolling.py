"""Per-instrument windows: eligibility, forward returns, streaks, intervals.

Input panels have one row per (instrument, dt), so a window partition is never
longer than the calendar. Date-level frames (one row per session) use an
unpartitioned window for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, by_instrument, guarded, ratio, trailing
from tapeloom.session import stage
from tapeloom.skew import quantiles


def pit_eligibility(panel: DataFrame, *, min_days: int, min_amount: float, window: int = 20, max_suspend: float = 0.2,
                    board_ok: Column | None = None) -> DataFrame:
    """Listing days, trailing amount, zero-volume share and `eligible`."""
    w = by_instrument()
    f = trailing(w, window)
    zero = (F.col("volume") == 0).cast("double")
    out = panel.withColumns({
        "listing_days": F.row_number().over(w).cast("long"),
        "avg_amount": guarded(F.avg("amount"), F.col("amount"), f, window),
        "suspend_ratio": F.when(F.count(F.lit(1)).over(f) >= window, F.avg(F.coalesce(zero, F.lit(0.0))).over(f)),
    })
    ok = (
        (F.col("listing_days") >= min_days) & (F.col("avg_amount") >= min_amount) & (F.col("suspend_ratio") <= max_suspend)
        & (F.col("open") > 0) & (F.col("close") > 0)
    )
    if board_ok is not None:
        ok = ok & board_ok
    return out.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def forward_return(steps: int, close: str = "close") -> Column:
    """close[t+steps+1] / close[t+1] - 1 (entry at the next close)."""
    w = by_instrument()
    return ratio(F.lead(close, steps + 1).over(w), F.lead(close, 1).over(w)) - 1.0


def forward_paths(panel: DataFrame, steps: int) -> DataFrame:
    """Cumulative forward return for every step 1..steps."""
    return panel.withColumns({f"cumret_{k}": forward_return(k) for k in range(1, steps + 1)})


def past_return(steps: int, close: str = "close") -> Column:
    return ratio(F.col(close), F.lag(close, steps).over(by_instrument())) - 1.0


# User-named label builders; any SQL expression over the panel works as well.
LABELS = {"forward_5": lambda: forward_return(5), "forward_20": lambda: forward_return(20), "past_5": lambda: past_return(5)}


def add_label(panel: DataFrame, label: str, out: str = "label") -> DataFrame:
    """A registered label by name, or a SQL expression with its own window."""
    expr = LABELS[label]() if label in LABELS else F.expr(label)
    return panel.withColumn(out, expr)


def regime_features(daily: DataFrame) -> DataFrame:
    """Rolling market features over one row per date.

    Input: dt, ret, breadth, dispersion, amount, n. The compounded returns are
    null when any return of the window is missing.
    """
    w = Window.orderBy("dt")
    out: dict[str, Column] = {}
    for n, m in ((5, 3), (10, 5), (20, 10)):
        f = trailing(w, n)
        whole = F.count("ret").over(f) == F.count(F.lit(1)).over(f)
        out[f"ret_{n}"] = F.when((F.count("ret").over(f) >= m) & whole, F.product(1.0 + F.col("ret")).over(f) - 1.0)
    for n, m in ((5, 3), (20, 10)):
        out[f"vol_{n}"] = guarded(F.stddev_samp("ret"), F.col("ret"), trailing(w, n), m)
    f20, f60 = trailing(w, 20), trailing(w, 60)
    out["breadth_5"] = guarded(F.avg("breadth"), F.col("breadth"), trailing(w, 5), 3)
    out["dispersion_20"] = guarded(F.avg("dispersion"), F.col("dispersion"), f20, 10)
    out["amount_20"] = guarded(F.avg("amount"), F.col("amount"), f20, 10)
    mean, std = (guarded(a("n"), F.col("n"), f60, 20) for a in (F.avg, F.stddev_samp))
    out["count_z60"] = ratio(F.col("n") - mean, F.nullif(std, F.lit(0.0)))
    return daily.withColumns(out).withColumn("amount_chg_20", ratio(F.col("amount"), F.lag("amount_20").over(w)) - 1.0)


def rolling_drawdown(df: DataFrame, ret: str, window: int, keys: list[str]) -> DataFrame:
    """Max drawdown of the compounded path and downside volatility per window."""
    w = Window.partitionBy(*keys).orderBy("dt") if keys else Window.orderBy("dt")
    f = trailing(w, window)
    m = max(5, window // 2)
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(state: Column, r: Column) -> Column:
        nav = state["nav"] * (1.0 + r)
        peak = F.greatest(state["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.greatest(state["dd"], 1.0 - nav / peak).alias("dd"))

    path = F.collect_list(F.coalesce(F.col(ret), F.lit(0.0))).over(f)
    neg = F.when(F.col(ret) < 0, F.col(ret))
    down = F.when(F.count(neg).over(f) > 1, F.stddev_samp(neg).over(f)).otherwise(F.lit(0.0))
    return df.withColumn("_path", path).withColumn(
        "mdd", F.when(F.size("_path") >= m, F.aggregate("_path", start, step, lambda s: s["dd"]))
    ).withColumn("downside_vol", F.when(F.count(ret).over(f) >= m, down)).drop("_path")


def rolling_z_with_gap_reset(daily: DataFrame, value: str, window: int, max_gap_days: int) -> DataFrame:
    """Rolling z of a date-level series; the window restarts after a long gap."""
    w = Window.orderBy("dt")
    gap = F.datediff("dt", F.lag("dt").over(w)) > max_gap_days
    seg = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = daily.withColumn("segment", seg)
    f = trailing(Window.partitionBy("segment").orderBy("dt"), window)
    m = max(10, window // 2)
    mean, std = (guarded(a(value), F.col(value), f, m) for a in (F.avg, F.stddev_samp))
    return out.withColumn("z", F.coalesce(ratio(F.col(value) - mean, F.nullif(std, F.lit(0.0))), F.lit(0.0)))


def risk_thresholds(scores: DataFrame, *, window: int, gap_days: int, base: float, slope: float, low: float, high: float,
                    q_low: float, q_high: float) -> DataFrame:
    """Per date: median outer score to a clipped risk budget, inner quantiles.

    Input: dt, instrument, outer, inner, eligible. Only eligible names enter the
    median; medians and quantiles are exact for cross-sections of any size. The
    scores are written first, as several passes read them.
    """
    scores = stage(scores.select("dt", "outer", "inner", "eligible"), "scores")
    med = quantiles(scores.where("eligible"), ["dt"], "outer", {"outer_median": 0.5})
    inner = quantiles(scores, ["dt"], "inner", {"inner_low": q_low, "inner_high": q_high})
    days = scores.select("dt").distinct().join(med, "dt", "left")
    z = rolling_z_with_gap_reset(days, "outer_median", window, gap_days)
    budget = F.least(F.lit(high), F.greatest(F.lit(low), F.lit(base) + F.lit(slope) * F.col("z")))
    return z.withColumn("risk_budget", budget).join(inner, "dt", "left")


def compress_intervals(daily: DataFrame, attrs: list[str], fill_to: str | None = None) -> DataFrame:
    """Runs of equal attributes per instrument as (start_dt, end_dt) intervals."""
    w = by_instrument()
    changed = F.lit(False)
    for a in attrs:
        changed = changed | ~F.col(a).eqNullSafe(F.lag(a).over(w))
    first = F.row_number().over(w) == 1
    island = F.sum((changed | first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = daily.withColumn("_i", island).groupBy("instrument", "_i", *attrs).agg(
        F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count(F.lit(1)).alias("days"))
    if fill_to:
        is_last = F.lead("_i").over(Window.partitionBy("instrument").orderBy("_i")).isNull()
        out = out.withColumn("end_dt", F.when(is_last, F.greatest("end_dt", F.lit(fill_to).cast("date"))).otherwise(F.col("end_dt")))
    return out.drop("_i")


def holding_streaks(held: DataFrame, max_gap_days: int = 10) -> DataFrame:
    """Age, entry price, unrealised and one-day return of unbroken holdings."""
    w = by_instrument()
    fresh = (F.datediff("dt", F.lag("dt").over(w)) > max_gap_days) | ~F.col("shares").eqNullSafe(F.lag("shares").over(w))
    streak = F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = held.withColumn("_prev", F.lag("mark_price").over(w)).withColumn("streak", streak)
    s = Window.partitionBy("instrument", "streak").orderBy("dt")
    return out.withColumns({
        "held_age": F.row_number().over(s).cast("long"),
        "entry_price": F.first("mark_price").over(s.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumns({
        "unrealized_ret": F.col("mark_price") / (F.col("entry_price") + EPS) - 1.0,
        "prev_day_ret": F.col("mark_price") / (F.col("_prev") + EPS) - 1.0,
    }).drop("_prev")


def drawdown(nav: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """1 - nav / running max of each series."""
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("drawdown", 1.0 - ratio(F.col(value), F.max(value).over(w)))


def session_decay_weights(df: DataFrame, cal: DataFrame, half_life: float) -> DataFrame:
    """exp(-ln2 * age / half_life), age in sessions from the last one."""
    last = cal.agg(F.max("session_no")).scalar()
    ages = cal.select("dt", (last - F.col("session_no")).alias("age"))
    weight = F.exp(-F.log(F.lit(2.0)) * F.col("age") / half_life) if half_life else F.lit(1.0)
    return df.join(F.broadcast(ages), "dt").withColumn("weight", weight)
