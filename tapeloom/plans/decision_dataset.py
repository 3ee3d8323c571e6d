"""Held rows x decision times: features, prices, labels and cross-sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.trading import Costs, round_trip_edge
from tapeloom.operators import cross_section, intraday, labels
from tapeloom.operators.intraday import Clock


def decision_dataset(
    bars: DataFrame, held: DataFrame, decisions: dict[str, int], buybacks: dict[str, tuple[int, int]], costs: Costs, *,
    clock: Clock = Clock(), window_end: int = 880, trigger: dict[str, float] | None = None,
) -> DataFrame:
    """One row per held (instrument, dt) and decision.

    `held`: instrument, dt, code, shares, mark_price. The minute bars are
    restricted to held sessions first, shuffled once on (instrument, dt), and
    features, forward extrema and buy-back prices come from one aggregate.
    """
    seen = bars.join(held.select("instrument", "dt"), ["instrument", "dt"], "left_semi")
    rows = intraday.visible_features(seen, decisions, held, clock, window_end, buybacks)
    rows = rows.drop("mark_price").join(held, ["instrument", "dt"])
    names = list(buybacks)
    edges = {f"edge_{n}": round_trip_edge(F.col("decision_price"), F.col(f"buyback_{n}"), costs) for n in names}
    rows = rows.withColumns(edges)
    best = F.greatest(*[F.col(e) for e in edges]) if len(edges) > 1 else F.col(next(iter(edges)))
    which = reduce(lambda acc, n: acc.when(F.col(f"edge_{n}") == F.col("best_edge"), F.lit(n)), names[1:], F.when(F.col(f"edge_{names[0]}") == F.col("best_edge"), F.lit(names[0])))
    last = names[-1]
    rows = rows.withColumn("best_edge", best).withColumn("best_window", which).withColumn("buyback", F.col(f"buyback_{last}")).withColumn("edge", F.col(f"edge_{last}"))
    rows = labels.position_features(rows, costs)
    rows = labels.board_limit_features(rows)
    touch = labels.trigger_labels(rows.withColumn("exit_price", F.col("buyback")), trigger or {"buy_first": 0.006, "sell_first": 0.0075}, (0.0,), costs)
    keys = ["instrument", "dt", "decision"]
    wide = touch.groupBy(*keys).agg(*[
        F.max(F.when(F.col("direction") == d, F.col(c))).alias(f"{n}_{s}")
        for d, s in (("sell_first", "sell"), ("buy_first", "buy")) for c, n in (("touched", "touched"), ("real_pnl", "real_pnl"), ("real_edge", "real_edge"))])
    rows = rows.join(wide, keys)
    out = cross_section.cross_sectional(rows, ["dt", "decision"], ["ret_from_open"], ["ret_from_open"], "ret_from_open")
    return out.withColumnRenamed("ret_from_open_rank", "ret_rank")
