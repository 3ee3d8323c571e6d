"""Features and labels of held rows (position, board, execution, trigger)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, ratio
from tapeloom.functions.symbols import board, board_limit_ratio, min_lot
from tapeloom.functions.trading import Costs


def position_features(df: DataFrame, costs: Costs) -> DataFrame:
    """Market value, lots, volume to position and sized fee drag."""
    shares, price = F.col("shares"), F.col("decision_price")
    value = shares * F.col("mark_price")
    cols = {
        "held_value": value,
        "held_log_value": F.log1p(F.greatest(value, F.lit(0.0))),
        "held_lots": shares / 100.0,
        "volume_to_held": F.when(shares > 0, ratio(F.col("visible_volume"), shares)),
        "amount_to_position": F.when(value > 0, ratio(F.col("visible_amount"), value)),
    }
    for pct in (10, 20, 30):
        volume = F.floor(shares * (pct / 100.0) / 100.0) * 100.0
        traded = volume * price
        fees = F.greatest(traded * costs.sell, F.lit(costs.min_fee)) + F.greatest(traded * costs.buy, F.lit(costs.min_fee))
        cols[f"volume_{pct}pct"] = F.greatest(volume, F.lit(0.0))
        cols[f"fee_drag_{pct}pct"] = F.when((volume > 0) & (price > 0), ratio(fees, traded))
    return df.withColumns(cols)


def board_limit_features(df: DataFrame) -> DataFrame:
    """Board one-hots and the room left to the daily price limits."""
    name, limit = board(F.col("code")), board_limit_ratio(F.col("code"))
    prev, price = F.col("mark_price"), F.col("decision_price")
    upper, lower = prev * (1.0 + limit), prev * (1.0 - limit)
    ok = (prev > 0) & (price > 0)
    return df.withColumns({
        "limit_ratio": limit,
        "is_chinext": (name == "chinext").cast("double"),
        "is_star": (name == "star").cast("double"),
        "is_beijing": (name == "beijing").cast("double"),
        "is_main": (name == "main").cast("double"),
        "to_limit_up": F.when(ok, ratio(upper, price + EPS) - 1.0),
        "from_limit_down": F.when(ok, ratio(price, lower + EPS) - 1.0),
        "up_room": F.when(ok, ratio(upper - price, prev * limit + EPS)),
        "down_room": F.when(ok, ratio(price - lower, prev * limit + EPS)),
    })


def _leg_pnl(volume: Column, sell: Column, buy: Column, costs: Costs, slip_sell: float, slip_buy: float) -> Column:
    sold, bought = volume * sell * (1.0 - slip_sell), volume * buy * (1.0 + slip_buy)
    fees = F.greatest(sold * costs.sell, F.lit(costs.min_fee)) + F.greatest(bought * costs.buy, F.lit(costs.min_fee))
    return sold - bought - fees


def execution_labels(df: DataFrame, windows: dict[str, str], costs: Costs) -> DataFrame:
    """Long form: one row per sizing, buy-back window and direction.

    `windows` maps a window name to its price column. The grid has 4 sizings,
    2 directions and the given windows, so each row grows by that fixed factor.
    """
    shares, lot, price = F.col("shares"), F.col("_lot"), F.col("decision_price")
    sizings = [("10pct", 0.1), ("20pct", 0.2), ("30pct", 0.3), ("one_lot", None)]
    # The grid is a constant; what it is made of is worked out once per row, not once per cell.
    grid = F.array(*[
        F.struct(F.lit(s).alias("sizing"), F.lit(f).cast("double").alias("_f"), F.lit(w).alias("window"), F.lit(k).alias("_w"), F.lit(d).alias("direction"))
        for s, f in sizings for k, w in enumerate(windows) for d in ("sell_first", "buy_first")
    ])
    one = df.withColumn("_lot", min_lot(F.col("code")).cast("double"))
    cells = one.withColumn("g", F.explode(grid)).select(*one.columns, "g.*")
    part = F.col("_f")
    cells = cells.withColumn("volume", F.when(part.isNull(), lot).otherwise(F.floor(shares * part / lot) * lot))
    volume = F.col("volume")
    fits = F.when(part.isNull(), (shares >= lot) & (lot <= shares * 0.5)).otherwise((volume >= lot) & (volume <= shares))
    buyback = F.coalesce(*[F.when(F.col("_w") == k, F.col(c)) for k, c in enumerate(windows.values())])
    out = cells.withColumns({"tradeable": fits, "_buyback": buyback})
    valid = F.col("tradeable") & (price > 0) & (F.col("_buyback") > 0)
    sell_first = F.col("direction") == "sell_first"
    pnl = _leg_pnl(
        volume, F.when(sell_first, price).otherwise(F.col("_buyback")),
        F.when(sell_first, F.col("_buyback")).otherwise(price), costs, costs.slippage, costs.slippage,
    )
    return (
        out.withColumn("pnl", F.when(valid, pnl))
        .withColumn("edge", ratio(F.col("pnl"), volume * price + EPS))
        .withColumn("hit", (F.col("pnl") > 0).cast("double"))
        .withColumn("volume", F.when(F.col("tradeable"), volume).otherwise(0.0))
        .select(*df.columns, "sizing", "volume", "tradeable", "window", "direction", "pnl", "edge", "hit")
    )


def trigger_labels(
    df: DataFrame, distances: dict[str, float], buffers: tuple[float, ...], costs: Costs
) -> DataFrame:
    """Limit-touch labels, long form by direction and touch buffer."""
    shares, lot, price = F.col("shares"), min_lot(F.col("code")), F.col("decision_price")
    exit_ref = F.col("exit_price")
    grid = F.array(*[
        F.struct(F.lit(d).alias("direction"), F.lit(float(dist)).alias("distance"), F.lit(float(b)).alias("buffer"))
        for d, dist in distances.items() for b in buffers
    ])
    out = df.withColumn("g", F.explode(grid)).select(*df.columns, "g.*")
    buy_first = F.col("direction") == "buy_first"
    entry = price * F.when(buy_first, 1.0 - F.col("distance")).otherwise(1.0 + F.col("distance"))
    valid = (
        (shares >= lot) & (lot <= shares * 0.5) & (price > 0) & (entry > 0) & (exit_ref > 0)
        & F.col("window_low").isNotNull() & F.col("window_high").isNotNull()
    )
    crossed = F.when(buy_first, F.col("window_low") <= entry * (1.0 - F.col("buffer"))).otherwise(
        F.col("window_high") >= entry * (1.0 + F.col("buffer"))
    )
    pnl = F.when(buy_first, _leg_pnl(lot, exit_ref, entry, costs, costs.slippage, 0.0)).otherwise(
        _leg_pnl(lot, entry, exit_ref, costs, 0.0, costs.slippage)
    )
    return (
        out.withColumn("entry_price", F.when(valid, entry))
        .withColumn("touched", F.when(valid, F.coalesce(crossed, F.lit(False)).cast("double")))
        .withColumn("cond_pnl", F.when(F.col("touched") == 1, pnl))
        .withColumn("cond_edge", ratio(F.col("cond_pnl"), lot * entry + EPS))
        .withColumn("cond_hit", (F.col("cond_pnl") > 0).cast("double"))
        .withColumn("real_pnl", F.when(F.col("touched").isNotNull(), F.coalesce("cond_pnl", F.lit(0.0))))
        .withColumn("real_edge", F.when(F.col("touched").isNotNull(), F.coalesce("cond_edge", F.lit(0.0))))
        .withColumn("real_hit", F.when(F.col("touched").isNotNull(), F.coalesce("cond_hit", F.lit(0.0))))
    )
