"""Cross-sections per date: ranks, distances to the median, groups, neutral scores.

Date-level statistics come from a grouped aggregate (combined map-side) joined
back on the date, not from a window over the date, so a very large date is
never collected into one task; ranks and medians use `tapeloom.skew`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.guards import ratio
from tapeloom.session import stage
from tapeloom.skew import FITS, PER_RANGE, average_rank, average_ranks, check_groups, quantiles, row_position


def rank_pct(df: DataFrame, keys: list[str], value: str, tie: str, per_range: int = PER_RANGE) -> DataFrame:
    """Average percent rank, descending min rank and first rank."""
    frame = stage(df.where(F.col(value).isNotNull()), "rank")
    limit = check_groups(frame, keys, per_range)
    out = average_rank(frame.withColumn("_neg", -F.col(value)), keys, value, "rank_pct", pct=True, per_range=limit, staged=True)
    out = average_rank(out, keys, "_neg", "_avg", per_range=limit, staged=True)
    ties = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    out = out.join(ties, [*keys, value]).withColumn("rank_min_desc", (F.col("_avg") - (F.col("_t") - 1) / 2.0).cast("long"))
    return row_position(out.drop("_neg", "_avg", "_t"), keys, value, tie, "rank_first", per_range=limit, staged=True)


def cross_sectional(df: DataFrame, keys: list[str], rank_cols: list[str], stat_cols: list[str], breadth: str,
                    per_range: int = PER_RANGE) -> DataFrame:
    """Universe size, percent ranks, distance to medians, mean/median/std, breadth."""
    frame = stage(df, "xs")
    limit = check_groups(frame, keys, per_range)
    medians = list(dict.fromkeys(rank_cols + stat_cols))
    stats = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("universe"),
        F.avg(F.coalesce((F.col(breadth) > 0).cast("double"), F.lit(0.0))).alias("positive_breadth"),
        *[F.avg(c).alias(f"{c}_mean") for c in stat_cols],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in stat_cols],
        *([F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in medians] if limit == FITS else []))
    if limit != FITS:
        for c in medians:
            stats = stats.join(quantiles(frame, keys, c, {f"{c}_median": 0.5}, per_range=limit, staged=True), keys, "left")
    out = average_ranks(frame, keys, {c: f"{c}_rank" for c in rank_cols}, pct=True, per_range=limit, staged=True).join(stats, keys)
    return out.withColumns({f"{c}_rel": F.col(c) - F.col(f"{c}_median") for c in rank_cols})


def group_snapshot(df: DataFrame, keys: list[str], means: list[str], sums: list[str], breadth: str) -> DataFrame:
    """Count, means, spread, breadth and sums per (date, group), joined back.

    Rows without a known group form a group of their own instrument.
    """
    known = ~F.coalesce(F.upper(F.trim("grp")), F.lit("")).isin("", "NAN", "NONE", "UNKNOWN", "OTHER")
    key = F.when(known, F.trim("grp")).otherwise(F.concat(F.lit("__UNKNOWN__"), F.col("instrument").cast("string")))
    frame = stage(df.withColumn("group_known", known.cast("double")).withColumn("_key", key), "groups")
    stats = frame.groupBy(*keys, "_key").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.avg(F.coalesce((F.col(breadth) > 0).cast("double"), F.lit(0.0))).alias("group_breadth"),
        F.coalesce(F.stddev_samp(breadth), F.lit(0.0)).alias(f"{breadth}_group_std"),
        *[F.avg(c).alias(f"{c}_group_mean") for c in means],
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{c}_group_sum") for c in sums])
    out = frame.join(stats, [*keys, "_key"]).drop("_key")
    return out.withColumns({f"{c}_group_rel": F.col(c) - F.col(f"{c}_group_mean") for c in means})


def neutralize(df: DataFrame, value: str, weights: list[float], min_group: int = 5) -> DataFrame:
    """Global z per date, group z where the group is large enough, and blends."""
    def spread(prefix: str) -> list[Column]:
        return [F.avg(value).alias(f"_{prefix}m"), F.nullif(F.stddev_samp(value), F.lit(0.0)).alias(f"_{prefix}s")]

    frame = stage(df, "neutral")
    by_date = frame.groupBy("dt").agg(*spread("d"))  # one row per session
    by_group = frame.groupBy("dt", "grp").agg(*spread("g"), F.count(value).alias("_gn"))
    out = frame.join(F.broadcast(by_date), "dt").join(by_group, ["dt", "grp"])
    out = out.withColumn("global_z", ratio(F.col(value) - F.col("_dm"), F.col("_ds")))
    own = F.when(F.col("_gn") >= min_group, ratio(F.col(value) - F.col("_gm"), F.col("_gs")))
    out = out.withColumn("group_z", F.coalesce(own, F.col("global_z")))
    blends = {f"neutral_{round(w * 100):03d}": (1.0 - w) * F.col("global_z") + w * F.col("group_z") for w in weights}
    return out.withColumns(blends).drop("_dm", "_ds", "_gm", "_gs", "_gn")


def broadcast_date_fields(df: DataFrame, daily: DataFrame) -> DataFrame:
    """Attach date-level fields (one row per session, so broadcast)."""
    return df.join(F.broadcast(daily), "dt", "left")


def fit_robust_scale(df: DataFrame, features: list[str], start: str, end: str, per_range: int = PER_RANGE) -> DataFrame:
    """Median and MAD per feature over a fit range: `feature, median, mad`."""
    day = F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    long = stage(df.where(day).select("dt", *features).unpivot(["dt"], features, "feature", "value").drop("dt"), "fit")
    med = quantiles(long, ["feature"], "value", {"median": 0.5}, per_range=per_range, staged=True)
    dev = long.join(F.broadcast(med), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("dev"))
    return med.join(quantiles(dev, ["feature"], "dev", {"mad": 0.5}, per_range=per_range), "feature")


def apply_robust_scale(df: DataFrame, fitted: DataFrame, features: list[str], clip: float = 3.0) -> DataFrame:
    """clip((x - median) / (1.4826 * MAD)), nulls to 0; one fitted row per feature."""
    wide = fitted.groupBy().agg(*[F.max(F.when(F.col("feature") == f, F.struct("median", "mad"))).alias(f"_{f}") for f in features])
    one = wide.select(F.struct(*wide.columns).alias("p")).scalar()
    out = df.withColumn("_p", one)
    cols = {}
    for f in features:
        z = ratio(F.col(f) - F.col("_p")[f"_{f}"]["median"], F.col("_p")[f"_{f}"]["mad"] * 1.4826)
        cols[f"{f}_z"] = F.coalesce(F.least(F.lit(clip), F.greatest(F.lit(-clip), z)), F.lit(0.0))
    return out.withColumns(cols).drop("_p")
