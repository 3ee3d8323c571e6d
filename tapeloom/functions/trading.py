"""Costs, lots, decisions and scores as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, finite_or_null, ratio


@dataclass(frozen=True)
class Costs:
    name: str
    buy: float
    sell: float
    slippage: float
    min_fee: float = 5.0


# The two named cost scenarios.
BASE_COSTS = Costs("base", 0.0005, 0.0015, 0.0002)
STRESS_COSTS = Costs("stress", 0.0010, 0.0025, 0.0005)


def round_lot(value: Column, lot: Column, minimum: Column | None = None) -> Column:
    """floor(value / lot) * lot; 0 when not finite or below the minimum."""
    number = finite_or_null(value)
    shares = F.floor(number / lot) * lot
    return F.when(number.isNull() | (shares < (lot if minimum is None else minimum)), F.lit(0.0)).otherwise(shares)


def first_positive(*values: Column) -> Column:
    """First finite positive value, else 0."""
    kept = [F.when(finite_or_null(v) > 0, finite_or_null(v)) for v in values]
    return F.coalesce(*kept, F.lit(0.0))


def trade_cost(value: Column, rate: float, min_fee: float = 5.0) -> Column:
    return F.when(value > 0, F.greatest(value * F.lit(rate), F.lit(min_fee))).otherwise(F.lit(0.0))


def round_trip_edge(sell: Column, buy: Column, costs: Costs) -> Column:
    """Net return of selling at one price and buying back at another."""
    edge = ratio(sell * (1.0 - costs.sell - costs.slippage), buy * (1.0 + costs.buy + costs.slippage) + EPS) - 1.0
    return F.when((sell > 0) & (buy > 0), edge)


def rescale_price(value: Column, reference: Column) -> Column:
    """Undo a factor-100 unit slip of a VWAP against a reference price."""
    share = ratio(value, reference + EPS)
    return F.when((reference > 0) & (share > 20), value / 100.0).when(
        (reference > 0) & (share < 0.05), value * 100.0
    ).otherwise(value)


def rescale_above_tenfold(value: Column, reference: Column) -> Column:
    """The window-table rule: a price above ten times the close is in hundredths."""
    return F.when((reference > 0) & (value > reference * 10), value / 100.0).otherwise(value)


def bin_label(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, F.lit(0)).when(value < high, F.lit(1)).otherwise(F.lit(2))


def classify_state(score: Column, upper: float, lower: float) -> Column:
    """Three states with strict limits."""
    return F.when(score > upper, F.lit("UP")).when(score < lower, F.lit("DOWN")).otherwise(F.lit("RANGE"))


@dataclass(frozen=True)
class SwingRules:
    buy_above: float = 0.2
    sell_below: float = -0.2
    inner_buy_above: float = 0.1
    inner_sell_below: float = -0.1
    wave_buy: float = 0.3
    wave_sell: float = 0.5
    range_swing: float = 0.2
    intraday: float = 0.1


def _act(action: str, fraction: float) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(float(fraction)).alias("fraction"))


def decide_swing(regime: Column, middle: Column, inner: Column, r: SwingRules) -> Column:
    """Swing decision: regime x middle score, probe buys in a falling regime."""
    up, down = regime == "UP", regime == "DOWN"
    buy, sell = middle > r.buy_above, middle < r.sell_below
    return (
        F.when(up & buy, _act("BUY", r.wave_buy))
        .when((up | down) & sell, _act("SELL", r.wave_sell))
        .when(down & buy, _act("BUY", r.wave_buy * 0.5))
        .when(down & (inner > r.inner_buy_above), _act("PROBE_BUY", r.wave_buy * 0.25))
        .when(~up & ~down & buy, _act("BUY", r.range_swing))
        .when(~up & ~down & sell, _act("SELL", r.range_swing))
        .otherwise(_act("HOLD", 0.0))
    )


def decide_intraday(regime: Column, state: Column, inner: Column, r: SwingRules) -> Column:
    """Intraday direction: the inner score, bounded by regime and middle state."""
    rise, fall = inner > r.inner_buy_above, inner < r.inner_sell_below
    long_leg, short_leg, none = "BUY_THEN_SELL", "SELL_THEN_BUY", _act("NONE", 0.0)
    half, full = r.intraday * 0.5, r.intraday
    ranging = (
        F.when((state == "UP") & ~fall, _act(long_leg, full))
        .when((state == "DOWN") & ~rise, _act(short_leg, full))
        .when((state == "RANGE") & rise, _act(long_leg, full))
        .when((state == "RANGE") & fall, _act(short_leg, full))
        .otherwise(none)
    )
    return (
        F.when((regime == "UP") & rise, _act(long_leg, half))
        .when((regime != "RANGE") & fall, _act(short_leg, half))
        .when(regime == "RANGE", ranging)
        .otherwise(none)
    )


def size_order(
    price: Column, cash: Column, nav: Column, held: Column, size: float, *,
    reserve: float, max_position: float, unit: int, min_lots: int, max_volume: Column | None = None,
) -> Column:
    """Shares to buy under cash reserve, position cap and lot rules."""
    free = F.greatest(F.lit(0.0), cash - reserve)
    room = F.greatest(F.lit(0.0), nav * max_position - held * price)
    budget = F.least(free * size, room, free)
    shares = F.floor(F.try_divide(budget, price) / unit) * unit
    if max_volume is not None:
        shares = F.least(shares, F.when(max_volume > 0, F.floor(max_volume / unit) * unit).otherwise(0))
    blocked = (price <= 0) | F.lit(size <= 0) | (budget < price * unit * min_lots)
    return F.when(blocked, F.lit(0)).otherwise(shares)


def linear_gate_score(values: list[Column], mean, scale, coef, intercept: float) -> Column:
    """Standardised linear score with stored coefficients."""
    if not len(values) == len(mean) == len(scale) == len(coef) or min(scale) <= 0:
        raise ValueError("gate coefficients do not fit the features")
    total = F.lit(float(intercept))
    for value, m, s, c in zip(values, mean, scale, coef):
        total = total + (value - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(c))
    return total


def expected_value(p: Column, positive_mean: Column, negative_mean: Column) -> Column:
    return p * positive_mean + (1.0 - p) * negative_mean


def interpolate(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear map over a fixed knot list, clipped at both ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        slope = (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])
        out = F.when(score < xs[i + 1], F.lit(float(ys[i])) + (score - xs[i]) * slope).otherwise(out)
    return F.when(score.isNull(), F.lit(None)).when(score <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def price_gate(side: Column, price: Column, reference: Column, force: Column, buy_bps: float, sell_bps: float) -> Column:
    """(allowed, reason) of one tick.

    Basis points are added before the division: 1 + 30/10000 is a little below 1.003
    as a double, which would refuse a price at its limit.
    """

    def verdict(allowed, reason: str) -> Column:
        flag = allowed if isinstance(allowed, Column) else F.lit(allowed)
        return F.struct(flag.alias("allowed"), F.lit(reason).alias("reason"))

    return (
        F.when(force, verdict(True, "force_window"))
        .when(price.isNull(), verdict(False, "await_market_price"))
        .when(reference <= 0, verdict(True, "no_price_gate"))
        .when(side == "BUY", verdict(price <= reference * (10000.0 + buy_bps) / 10000.0, "buy_limit"))
        .otherwise(verdict(price >= reference * (10000.0 - sell_bps) / 10000.0, "sell_limit"))
    )


def child_size(remaining: Column, lot: Column, force: Column, fraction: float) -> Column:
    """Size of one child order: a clipped fraction in whole lots."""
    left = F.abs(remaining)
    raw = F.when(force, left).otherwise(F.greatest(lot, F.floor(left * max(0.01, fraction))))
    return F.when(left <= 0, F.lit(0)).otherwise(F.least(left, F.greatest(lot, F.floor(raw / lot) * lot)))


def vwap_proxy(mode: str) -> Column:
    """Daily VWAP by mode over open/high/low/close/volume/amount columns."""
    volume = F.nullif(F.col("volume"), F.lit(0.0))
    modes = {
        "amount_div_volume": lambda: F.col("amount") / volume,
        "amount_div_volume100": lambda: F.col("amount") / (volume * 100.0),
        "close": lambda: F.col("close"),
        "ohlc4": lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4.0,
    }
    if mode not in modes:
        raise ValueError(f"unknown vwap mode {mode!r}")
    return modes[mode]()


def invalid_ohlc(o: Column, h: Column, low: Column, c: Column) -> Column:
    """True when a price is missing or not positive, or the range is broken."""
    missing = o.isNull() | h.isNull() | low.isNull() | c.isNull()
    broken = (F.least(o, h, low, c) <= 0) | (h < F.greatest(o, c, low)) | (low > F.least(o, c, h))
    return F.coalesce(missing | broken, F.lit(True))


def classification_target(label: Column, edge: Column, edge_above: float | None = None) -> Column:
    hit = (edge > edge_above) if edge_above is not None else (label > 0.5)
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))
