"""Session factors, window prices and features from minute bars.

Input: `instrument, dt, minute_of_day, open, high, low, close, volume, amount`
with one row per minute, so a session has at most 1,440 rows and its windows
and lists stay small however many ticks made the bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, pair_corr, ratio
from tapeloom.functions.trading import Costs, rescale_above_tenfold, rescale_price, round_trip_edge

KEYS = ["instrument", "dt"]


@dataclass(frozen=True)
class Clock:
    """Minute windows of a session, inclusive (fixed values of a 09:30-15:00 day)."""

    open_t: tuple[int, int] = (571, 575)
    open15: tuple[int, int] = (571, 585)
    open_stable: tuple[int, int] = (571, 600)
    mid: tuple[int, int] = (600, 690)
    morning: tuple[int, int] = (0, 689)
    afternoon: tuple[int, int] = (780, 1439)
    late_anchor: tuple[int, int] = (780, 859)
    close_stable: tuple[int, int] = (860, 890)
    close_t: tuple[int, int] = (885, 890)
    first30: tuple[int, int] = (0, 599)
    last30: tuple[int, int] = (870, 1439)
    open_minute: int = 570
    unit: int = 1


# The same windows on a 24-hour clock, for instruments that trade all day.
ROUND_THE_CLOCK = Clock(
    open_t=(0, 60), open15=(0, 120), open_stable=(0, 180), mid=(180, 690), morning=(0, 719), afternoon=(780, 1439),
    late_anchor=(780, 1079), close_stable=(1080, 1380), close_t=(1320, 1380), first30=(0, 179), last30=(1260, 1439),
    open_minute=60, unit=12,
)

def inside(window: tuple[int, int]) -> Column:
    return F.col("minute_of_day").between(*window)


def _first(value: str, mask: Column) -> Column:
    return F.min_by(value, F.when(mask, F.col("minute_of_day")))


def _last(value: str, mask: Column) -> Column:
    return F.max_by(value, F.when(mask, F.col("minute_of_day")))


def price_at(minute: int | Column) -> Column:
    """Aggregate: last close at or before a minute."""
    return _last("close", F.col("minute_of_day") <= minute)


def return_between(start: Column, end: Column) -> Column:
    return F.when(start > 0, ratio(end, start) - 1.0)


def window_vwap(window: tuple[int, int], rescale: str | None = None) -> Column:
    """Aggregate: sum(amount) / (sum(volume) + eps); null without volume.

    `rescale` undoes a factor-100 slip against the `first` or `last` close.
    """
    mask = inside(window)
    volume = F.sum(F.when(mask, F.col("volume")))
    value = F.when(volume > 0, F.sum(F.when(mask, F.col("amount"))) / (volume + EPS))
    if rescale is None:
        return value
    return rescale_price(value, _first("close", mask) if rescale == "first" else _last("close", mask))


def visible_cutoff(bars: DataFrame, cut: int) -> DataFrame:
    """Bars visible at the cut-off per session, with the previous session's close."""
    seen = F.col("minute_of_day") <= cut
    day = bars.groupBy(*KEYS).agg(
        F.count_if(seen).alias("bars"), F.max(F.when(seen, F.col("minute_of_day"))).alias("last_minute"),
        _last("close", seen).alias("last_close"), F.max_by("close", "minute_of_day").alias("session_close"))
    w = Window.partitionBy("instrument").orderBy("dt")
    return day.withColumn("prev_close", F.lag("session_close").over(w)).drop("session_close").where("bars > 0")


def normalize_volume_unit(bars: DataFrame) -> DataFrame:
    """Scale volume to lots by the inferred unit of each session."""
    good = (F.col("volume") > 0) & (F.col("amount") > 0) & (F.col("close") > 0)
    unit = F.sum("amount") / (F.sum("volume") * F.max_by("close", "minute_of_day") + EPS)
    units = bars.where(good).groupBy(*KEYS).agg(unit.alias("unit"))
    scale = F.when(F.col("unit").between(0.2, 5.0), 0.01).when(F.col("unit").between(20.0, 200.0), 1.0)
    out = bars.join(units, KEYS, "left").withColumn("scale", scale)
    return out.withColumn("valid", F.col("scale").isNotNull()).withColumn("volume", F.col("volume") * F.col("scale"))


def _session_columns(bars: DataFrame) -> DataFrame:
    """Per-minute columns shared by the factors: log returns and VWAP crosses."""
    w = Window.partitionBy(*KEYS).orderBy("minute_of_day")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy(*KEYS)
    out = (
        bars.withColumn("lr", F.log(F.col("close") + EPS) - F.lag(F.log(F.col("close") + EPS)).over(w))
        .withColumn("cv", F.sum("amount").over(so_far) / (F.sum("volume").over(so_far) + EPS))
        .withColumn("o0", F.first("open").over(so_far))
    )
    share = F.percentile(F.col("cv") / (F.col("o0") + EPS), F.lit(0.5)).over(day)
    return (
        out.withColumn("lr1", F.lag("lr").over(w))
        .withColumn("share", share)
        .withColumn("cv", F.when(F.col("share") > 20, F.col("cv") / 100.0).when(F.col("share") < 0.05, F.col("cv") * 100.0)
                    .otherwise(F.col("cv")))
        .withColumn("sgn", F.nullif(F.signum(F.col("close") - F.col("cv")), F.lit(0.0)))
        .withColumn("sgn1", F.last("sgn", ignorenulls=True).over(earlier))
        .withColumn("logv", F.log(F.col("volume") + 1.0))
    )


def session_factors(bars: DataFrame, clock: Clock = Clock(), min_bars: int = 30) -> DataFrame:
    """28 factors and 2 labels per session, one aggregate after one sort.

    The window columns and the aggregate share the hash layout on
    (instrument, dt), so the bars are shuffled once.
    """
    always = F.lit(True)
    am, pm = inside(clock.morning), inside(clock.afternoon)
    neg, pos = F.when(F.col("lr") < 0, F.col("lr")), F.when(F.col("lr") > 0, F.col("lr"))
    vwaps = {n: window_vwap(getattr(clock, n), "first").alias(f"v_{n}") for n in (
        "open_t", "open15", "open_stable", "mid", "morning", "afternoon", "late_anchor", "close_stable", "close_t")}

    def vol(mask: Column) -> Column:
        return F.sum(F.when(mask, F.col("volume")))

    def hi(mask: Column) -> Column:
        return F.max(F.when(mask, F.col("high")))

    def lo(mask: Column) -> Column:
        return F.min(F.when(mask, F.col("low")))

    first30, last30 = inside(clock.first30), inside(clock.last30)
    agg = _session_columns(bars).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("bars"), F.count("lr").alias("n_lr"),
        _first("open", always).alias("o0"), _last("close", always).alias("cn"),
        F.sum("volume").alias("vol"), F.sum("amount").alias("amt"), F.max("volume").alias("vmax"),
        F.max("high").alias("hi"), F.min("low").alias("lo"), F.stddev_pop("close").alias("sdc"),
        F.stddev_pop("lr").alias("sdr"), pair_corr(F.col("lr"), F.col("logv")).alias("pv"),
        pair_corr(F.col("lr"), F.col("lr1"), 6).alias("ac"),
        pair_corr(F.when(am, F.col("lr")), F.col("logv"), 6).alias("pv_am"),
        pair_corr(F.when(pm, F.col("lr")), F.col("logv"), 6).alias("pv_pm"),
        F.count(neg).alias("n_neg"), F.count(pos).alias("n_pos"),
        F.stddev_pop(neg).alias("sd_neg"), F.stddev_pop(pos).alias("sd_pos"), F.sum(F.abs("lr")).alias("path"),
        _last("close", first30).alias("c_f30"), _first("close", last30).alias("c_l30"),
        vol(first30).alias("vol_f30"), hi(first30).alias("hi_f30"), lo(first30).alias("lo_f30"),
        _first("open", am).alias("o_am"), _last("close", am).alias("c_am"),
        hi(am).alias("hi_am"), lo(am).alias("lo_am"), vol(am).alias("vol_am"),
        _first("open", pm).alias("o_pm"), _last("close", pm).alias("c_pm"),
        hi(pm).alias("hi_pm"), lo(pm).alias("lo_pm"), vol(pm).alias("vol_pm"),
        F.slice(F.sort_array(F.collect_list("volume"), asc=False), 1, 5).alias("top5"),
        F.count("sgn").alias("n_sgn"), F.count_if(F.col("sgn") != F.col("sgn1")).alias("crosses"),
        *vwaps.values(),
    ).where(F.col("bars") >= min_bars)

    def c(name: str) -> Column:
        return F.col(name)

    def rel(a: str, b: str) -> Column:
        return F.when(c(b) > 0, ratio(c(a), c(b) + EPS) - 1.0)

    def to_open(a: str) -> Column:
        return ratio(c(a), c("o0") + EPS) - 1.0

    def position(close: str, high: str, low: str) -> Column:
        return ratio(c(close) - c(low), c(high) - c(low) + EPS)

    traded = c("vol") > 0
    vwap = F.when(traded, rescale_price(c("amt") / (c("vol") + EPS), c("o0")))
    out = {
        "first30m_ret": to_open("c_f30"),
        "last30m_ret": ratio(c("cn"), c("c_l30") + EPS) - 1.0,
        "intra_mom_diff": ratio(c("c_am"), c("o_am") + EPS) - ratio(c("c_pm"), c("o_pm") + EPS),
        "min_vol_std": F.when(c("n_lr") > 5, c("sdr") * F.sqrt(F.lit(240.0))),
        "vwap_dev": ratio(c("cn") - vwap, vwap + EPS),
        "max_min_vol_ratio": F.when(traded, ratio(c("vmax"), c("vol") / c("bars") + EPS)),
        "price_vol_corr_min": F.when(c("n_lr") > 5, c("pv")),
        "vwap_revert": F.when(c("sdc") > 1e-8, ratio(c("cn") - vwap, c("sdc"))),
        "t_open30_ret": rel("v_open_stable", "v_open_t"),
        "t_mid_ret": rel("v_mid", "v_open_stable"),
        "t_vwap_slope": rel("v_afternoon", "v_morning"),
        "t_range_pos": position("cn", "hi", "lo"),
        "t_vol_conc": F.when(traded, ratio(c("vol_f30"), c("vol") + EPS)),
        "t_late_mom": rel("v_close_stable", "v_late_anchor"),
        "open15_ret": to_open("v_open15"),
        "open30_range": ratio(c("hi_f30") - c("lo_f30"), c("o0") + EPS),
        "open30_vwap_dev": to_open("v_open_stable"),
        "am_range_pos": position("c_am", "hi_am", "lo_am"),
        "pm_range_pos": position("c_pm", "hi_pm", "lo_pm"),
        "am_pm_vol_ratio": F.when(c("vol_pm") > 0, ratio(c("vol_am"), c("vol_pm") + EPS)),
        "top5_vol_conc": F.when(traded, ratio(F.aggregate("top5", F.lit(0.0), lambda a, x: a + x), c("vol") + EPS)),
        "vwap_cross_count": F.when(c("n_sgn") > 1, c("crosses").cast("double")),
        "ret_autocorr_min": F.when(c("n_lr") > 6, c("ac")),
        "downside_vol_ratio": F.when((c("n_neg") > 3) & (c("n_pos") > 3), ratio(c("sd_neg"), c("sd_pos") + EPS)),
        "am_price_vol_corr": c("pv_am"),
        "pm_price_vol_corr": c("pv_pm"),
        "illiquidity_min": F.when((c("n_lr") > 5) & (c("amt") > 0), ratio(c("path"), c("amt") + EPS)),
        "close_pullup": ratio(c("cn"), c("v_close_stable") + EPS) - 1.0,
        "intraday_t_ret": rel("v_close_t", "v_open_t"),
        "intraday_t_ret_stable": rel("v_close_stable", "v_open_stable"),
    }
    return agg.select(*KEYS, "bars", *[e.alias(n) for n, e in out.items()])


def window_prices(bars: DataFrame, windows: dict[str, tuple[int, int]], rescale: str | None = "last") -> DataFrame:
    """One VWAP column per named window; sessions with none are dropped."""
    out = bars.groupBy(*KEYS).agg(*[window_vwap(w, rescale).alias(n) for n, w in windows.items()])
    return out.where(F.coalesce(*[F.col(n) for n in windows]).isNotNull())


def execution_windows(bars: DataFrame, open_window=(571, 575), close_window=(885, 890)) -> DataFrame:
    """Open VWAP, close VWAP and last close of each session."""
    out = bars.groupBy(*KEYS).agg(
        window_vwap(open_window).alias("open_exec"), window_vwap(close_window).alias("close_exec"),
        F.max_by("close", "minute_of_day").alias("mark_close"))
    return out.withColumns({c: rescale_above_tenfold(F.col(c), F.col("mark_close")) for c in ("open_exec", "close_exec")})


def bucket_round_trip_labels(bars: DataFrame, buckets: list[tuple[int, int]], costs: Costs) -> DataFrame:
    """Round trips between six bucket VWAPs: fixed pairs, best, best-two mean, hit share."""
    names = ["b0", "b1", "b2", "b3", "b4", "b5"]
    prices = window_prices(bars, dict(zip(names, buckets)), rescale=None)

    def rt(sell: int, buy: int) -> Column:
        return round_trip_edge(F.col(f"b{sell}"), F.col(f"b{buy}"), costs)

    pairs = F.filter(F.array(*[rt(i, j) for i in range(5) for j in range(i + 1, 6)]), lambda x: x.isNotNull())
    top = F.slice(F.sort_array(F.col("pairs"), asc=False), 1, 2)
    mean_top = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    some = F.size("pairs") > 0
    return prices.withColumn("pairs", pairs).select(
        *KEYS,
        (ratio(F.col("b5"), F.col("b0") + EPS) - 1.0).alias("exec_ret"),
        rt(5, 0).alias("exec_net_ret"), rt(0, 5).alias("reverse_net_ret"),
        rt(0, 2).alias("open_am_net_ret"), rt(0, 4).alias("open_pm_net_ret"),
        rt(1, 4).alias("am_pm_net_ret"), rt(1, 5).alias("am_close_net_ret"),
        F.when(some, F.array_max("pairs")).alias("best_net_ret"),
        F.when(some, mean_top / F.size(top)).alias("best2_mean_net_ret"),
        F.when(some, F.size(F.filter("pairs", lambda x: x > 0)) / F.size("pairs")).alias("hit_ratio"),
    )


def visible_features(
    bars: DataFrame, decisions: dict[str, int], marks: DataFrame, clock: Clock = Clock(), window_end: int | None = None,
    buybacks: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """28 features of the bars visible at each decision minute.

    `marks` holds `instrument, dt, mark_price`. Each bar is copied to the few
    decisions it belongs to (a fixed list), then one aggregate per
    (instrument, dt, decision). With `window_end` the later low/high/count up to
    that minute are added as label fields, and each `buybacks` window adds its
    VWAP, all in the same aggregate.
    """
    w = Window.partitionBy(*KEYS).orderBy("minute_of_day")
    lr = F.log(F.col("close") + EPS) - F.lag(F.log(F.col("close") + EPS)).over(w)
    grid = F.array(*[F.struct(F.lit(n).alias("decision"), F.lit(m).alias("cut")) for n, m in decisions.items()])
    base = (
        bars.withColumn("lr", lr)
        .withColumn("lr1", F.lag("lr").over(w))
        .withColumn("sv", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
        .withColumn("lrv", F.when(F.col("lr").isNotNull(), F.log(F.col("volume") + 1.0)))
        .withColumn("g", F.explode(grid))
        .select("*", "g.*")
    )
    m, cut = F.col("minute_of_day"), F.col("cut")
    seen = m <= cut
    u, start = clock.unit, clock.open_minute

    def v(name: str) -> Column:
        return F.when(seen, F.col(name))

    def at(minute: Column | int) -> Column:
        return _last("close", seen & (m <= minute))

    anchors = {"c_open": at(start), "c_d5": at(cut - 5 * u), "c_d10": at(cut - 10 * u), "c_d15": at(cut - 15 * u)}
    anchors |= {f"c_f{k}": at(F.least(cut, F.lit(start + k * u))) for k in (5, 10, 15, 30)}
    extra = []
    if window_end is not None:
        later = (m > cut) & (m <= window_end)
        extra = [F.min(F.when(later, F.col("low"))).alias("window_low"), F.max(F.when(later, F.col("high"))).alias("window_high"),
                 F.count_if(later).alias("window_minutes")]
    names = list(buybacks or {})
    extra += [window_vwap(win, "last").alias(f"buyback_{n}") for n, win in (buybacks or {}).items()]
    agg = base.groupBy(*KEYS, "decision", "cut").agg(
        F.count_if(seen).alias("bars"), F.count(v("lr")).alias("n_lr"),
        _first("open", seen).alias("o0"), _last("close", seen).alias("last"),
        F.max(v("high")).alias("hi"), F.min(v("low")).alias("lo"), F.sum(v("volume")).alias("vol"),
        F.sum(v("amount")).alias("amt"), F.stddev_pop(v("lr")).alias("sdr"),
        pair_corr(v("lr"), F.col("lr1")).alias("ac"), pair_corr(v("lr"), F.col("lrv")).alias("pv"),
        F.regr_slope(F.when(seen, F.log(F.col("close") + EPS)), F.when(seen, m.cast("double"))).alias("slope"),
        F.avg(F.when(seen & F.col("lr").isNotNull(), (F.col("lr") > 0).cast("double"))).alias("up"),
        F.sum(v("sv")).alias("sv"), F.sum(F.when(seen & (m > cut - 5 * u), F.col("volume"))).alias("v5"),
        F.sum(F.when(seen & (m > cut - 10 * u), F.col("volume"))).alias("v10"),
        *[e.alias(n) for n, e in anchors.items()], *extra,
    ).where("bars > 0").join(marks.select(*KEYS, "mark_price"), KEYS, "left")

    def c(name: str) -> Column:
        return F.col(name)

    def rel(a: str, b: str) -> Column:
        return ratio(c(a), c(b) + EPS) - 1.0

    vwap = F.when(c("vol") > 0, rescale_price(c("amt") / (c("vol") + EPS), c("last")))
    recent5 = return_between(c("c_d5"), c("last"))
    out = {
        "ret_from_open": rel("last", "o0"), "gap_vs_mark": rel("o0", "mark_price"), "last_vs_mark": rel("last", "mark_price"),
        "day_range": rel("hi", "lo"), "range_pos": ratio(c("last") - c("lo"), c("hi") - c("lo") + EPS),
        "vwap_dev": ratio(c("last"), vwap + EPS) - 1.0, "visible_volume": c("vol"), "visible_amount": c("amt"),
        "minute_vol": F.when(c("n_lr") > 3, c("sdr") * F.sqrt(F.lit(240.0))),
        "ret_autocorr": F.when(c("n_lr") > 3, c("ac")), "price_vol_corr": F.when(c("n_lr") > 3, c("pv")),
        **{f"first_{k}m_ret": return_between(c("c_open"), c(f"c_f{k}")) for k in (5, 10, 15, 30)},
        "recent_5m_ret": recent5, "recent_10m_ret": return_between(c("c_d10"), c("last")),
        "recent_15m_ret": return_between(c("c_d15"), c("last")),
        "momentum_accel": recent5 - return_between(c("c_d10"), c("c_d5")),
        "trend_slope": F.when(c("bars") >= 4, c("slope") * F.greatest(c("cut") - start, F.lit(1))),
        "drawdown_from_high": rel("last", "hi"), "rebound_from_low": rel("last", "lo"), "up_ratio": c("up"),
        "signed_volume_ratio": ratio(c("sv"), c("vol") + EPS),
        "recent_5m_vol_share": ratio(F.coalesce(c("v5"), F.lit(0.0)), c("vol") + EPS),
        "recent_10m_vol_share": ratio(F.coalesce(c("v10"), F.lit(0.0)), c("vol") + EPS),
        "log_volume": F.log1p(F.greatest(c("vol"), F.lit(0.0))), "log_amount": F.log1p(F.greatest(c("amt"), F.lit(0.0))),
    }
    keep = ["window_low", "window_high", "window_minutes"] if window_end is not None else []
    return agg.select(*KEYS, "decision", "cut", "mark_price", c("last").alias("decision_price"), *keep,
                      *[f"buyback_{n}" for n in names], *[e.alias(n) for n, e in out.items()])


def forward_extrema(bars: DataFrame, decisions: dict[str, int], window_end: int) -> DataFrame:
    """Low, high and bar count after each decision minute up to a cut-off."""
    grid = F.array(*[F.struct(F.lit(n).alias("decision"), F.lit(m).alias("cut")) for n, m in decisions.items()])
    later = (F.col("minute_of_day") > F.col("cut")) & (F.col("minute_of_day") <= window_end)
    return bars.withColumn("g", F.explode(grid)).select("*", "g.*").where(later).groupBy(*KEYS, "decision").agg(
        F.min("low").alias("window_low"), F.max("high").alias("window_high"), F.count(F.lit(1)).alias("window_minutes"))


def minute_return(bars: DataFrame, start: int, end: int) -> DataFrame:
    """As-of prices at two minutes and the return between them."""
    out = bars.groupBy(*KEYS).agg(price_at(start).alias("start_price"), price_at(end).alias("end_price"))
    return out.withColumn("ret", return_between(F.col("start_price"), F.col("end_price")))
