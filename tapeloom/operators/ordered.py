"""Ordered folds: results that depend on their own earlier output.

Each walks the sorted rows of a key in one pass (`streamed.fold_columns`), with a
state of constant size, so a long history costs no more per row than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.streamed import fold_columns


def effective_targets(targets: DataFrame, minimum: Column) -> DataFrame:
    """A raise below the minimum order keeps the previous effective shares.

    Input: symbol, dt, shares (unique per symbol and date).
    """
    rows = targets.select("symbol", "dt", F.col("shares").cast("double").alias("shares"), minimum.cast("double").alias("_lot"))

    def step(before: float, shares: float, lot: float) -> tuple[float, tuple]:
        now = before if shares > before and shares - before < lot else shares
        return now, (now,)

    return fold_columns(rows, ["symbol"], ["dt"], ["shares", "_lot"], "effective double", float, step).drop("_lot")


def carry_blocked_targets(targets: DataFrame, blocks: DataFrame, *, retry_sells: bool = False) -> DataFrame:
    """Targets after market blocks: a blocked side keeps the current shares.

    `targets`: symbol, dt, shares; a symbol absent on a target date wants 0.
    `blocks`: symbol, dt, side. With `retry_sells` a blocked sell keeps its lower
    target for a later retry. The dense (date, symbol) grid runs over the target
    dates, from each symbol's first target on.
    """
    days = targets.select("dt").distinct()
    firsts = targets.groupBy("symbol").agg(F.min("dt").alias("_from"))
    sides = blocks.groupBy("symbol", "dt").agg(F.collect_set("side").alias("sides"))
    all_days = days.groupBy().agg(F.sort_array(F.collect_list("dt")).alias("d")).scalar()
    grid = firsts.withColumn("_days", all_days).withColumn(
        "dt", F.explode(F.filter("_days", lambda d: d >= F.col("_from")))).drop("_from", "_days")
    dense = grid.join(targets.select("symbol", "dt", F.col("shares").cast("double").alias("shares")), ["symbol", "dt"], "left").join(
        sides, ["symbol", "dt"], "left")
    rows = dense.select(
        "symbol", "dt", F.coalesce("shares", F.lit(0.0)).alias("desired"),
        *[F.coalesce(F.array_contains("sides", F.lit(s)), F.lit(False)).alias(f"_no_{s}") for s in ("BUY", "SELL")])

    def step(current: float, want: float, no_buy: bool, no_sell: bool) -> tuple[float, tuple]:
        side = "BUY" if want > current else "SELL" if want < current else "HOLD"
        stopped = no_buy if side == "BUY" else no_sell and side == "SELL"
        retry = stopped and retry_sells and side == "SELL"
        final = max(current if stopped and not retry else want, 0.0)
        reason = "retry_blocked_sell" if retry else f"blocked_{side.lower()}" if stopped else "target"
        return final, (side, current, final, reason)

    added = "side string, current double, final double, reason string"
    out = fold_columns(rows, ["symbol"], ["dt"], ["desired", "_no_BUY", "_no_SELL"], added, float, step)
    return out.where("final > 0 or current > 0").select("symbol", "dt", "side", "current", "desired", "final", "reason")


def budgeted_accept(candidates: DataFrame, *, keys: list[str], order: list[str], cost: str, limit: Column, id_col: str, max_items: int) -> DataFrame:
    """Accept in order while the budget lasts; a later smaller item may still fit.

    Only candidates with `rank` <= max_items can be accepted; those behind come
    back as not accepted, without a running sum.
    """
    rows = candidates.withColumns({"_cost": F.col(cost).cast("double"), "_limit": limit.cast("double"), "_near": F.col("rank") <= max_items})

    def step(used: float, price: float | None, most: float | None, near: bool | None) -> tuple[float, tuple]:
        if not near:
            return used, (False, None)
        fits = price is not None and most is not None and used + price <= most
        used = used + price if fits else used
        return used, (fits, used)

    added = "accepted boolean, used double"
    return fold_columns(rows, keys, [*order, id_col], ["_cost", "_limit", "_near"], added, float, step).drop("_cost", "_limit", "_near")
