"""Score maps, cost scenarios and training targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.trading import Costs, classification_target, trade_cost
from tapeloom.session import stage
from tapeloom.skew import average_rank, value_counts


def cost_scenarios(df: DataFrame, value: str, scenarios: list[Costs], keys: list[str]) -> DataFrame:
    """Summed fees per scenario in one pass: conditional sums, then unpivot."""
    aggs = []
    for s in scenarios:
        v = F.col(value)
        aggs += [F.sum(trade_cost(v, s.buy, s.min_fee)).alias(f"{s.name}_b"), F.sum(trade_cost(v, s.sell, s.min_fee)).alias(f"{s.name}_s"),
                 F.sum(v * s.slippage).alias(f"{s.name}_x")]
    rows = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.col(f"{s.name}_b").alias("buy_fee"),
                              F.col(f"{s.name}_s").alias("sell_fee"), F.col(f"{s.name}_x").alias("slip")) for s in scenarios])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))


def instrument_thresholds(df: DataFrame, label: str, min_rows: int = 30, min_std: float = 1e-6) -> DataFrame:
    """Own +-std class limits per instrument with enough rows and spread."""
    stats = df.groupBy("instrument").agg(F.stddev_pop(label).alias("std"), F.count(label).alias("n"))
    kept = stats.where((F.col("n") >= min_rows) & (F.col("std") >= min_std))
    return kept.select("instrument", (-F.col("std")).alias("low"), F.col("std").alias("high"))


def percentile_score(scores: DataFrame, score: str, calibration: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the calibration sample at or below each score.

    Both sides are counted together by value, so neither is broadcast and a
    heavily repeated score is one counted row.
    """
    scores = stage(scores, "score")
    both = scores.select(F.col(score).alias("_v"), F.lit(0).alias("_w")).unionByName(
        calibration.select(F.col(value).alias("_v"), F.lit(1).alias("_w")))
    counts = value_counts(both, [], "_v", weight=F.col("_w"))
    share = ((F.col("below") + F.col("n")) / F.col("total")).alias(out)
    return scores.join(counts.select(F.col("_v").alias(score), share), score, "left")


def training_target(df: DataFrame, edge: str, clip: float, edge_above: float) -> DataFrame:
    """Clipped, shifted, per-date percent-rank and class targets of an edge."""
    bounded = F.least(F.lit(clip), F.greatest(F.lit(-clip), F.col(edge)))
    out = df.withColumn("clipped", bounded).withColumn("shifted", bounded + clip).withColumn(
        "cls", classification_target(F.lit(None), F.col(edge), edge_above))
    return average_rank(out, ["dt"], edge, "pct", pct=True)
