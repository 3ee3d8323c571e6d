"""Joins and reconciliation of signals, holdings, targets, fills and sources.

Key-for-key combinations use `groupBy().agg(max_by)` or plain equi joins, which
combine map-side or let adaptive execution split skewed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, pair_corr, ratio
from tapeloom.functions.trading import Costs, invalid_ohlc
from tapeloom.operators.asof import asof_join
from tapeloom.session import stage
from tapeloom.skew import quantiles

PRICE_COLUMNS = ["open", "high", "low", "close"]
BAR_COLUMNS = [*PRICE_COLUMNS, "volume", "amount"]


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one highest in `order` (combined map-side); equal ones by a hash of the row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_r")).select(*keys, "_r.*")


def merge_sources(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sources; the primary row wins on equal keys."""
    both = fallback.withColumn("source_no", F.lit(0)).unionByName(primary.withColumn("source_no", F.lit(1)))
    return latest_per_key(both, keys, F.col("source_no"))


def align_source_scale(primary: DataFrame, fallback: DataFrame, *, rows: int = 5, max_error: float = 0.01) -> DataFrame:
    """Scale evidence per instrument from the first overlapping closes."""
    p = primary.select("instrument", "dt", F.col("close").alias("_p"))
    f = fallback.select("instrument", "dt", F.col("close").alias("_f"))
    over = p.join(f, ["instrument", "dt"]).where((F.col("_p") > 0) & (F.col("_f") > 0)).withColumn("ratio", F.col("_p") / F.col("_f"))
    first = over.withColumn("_k", F.row_number().over(Window.partitionBy("instrument").orderBy("dt"))).where(F.col("_k") <= rows)
    head = first.groupBy("instrument").agg(F.percentile("ratio", F.lit(0.5)).alias("scale"), F.collect_list("ratio").alias("_rs"))
    head = head.withColumn("_e", F.explode("_rs")).groupBy("instrument", "scale").agg(
        F.percentile(F.abs(F.col("_e") / F.col("scale") - 1.0), F.lit(0.95)).alias("error"))
    counts = over.groupBy("instrument").agg(F.count(F.lit(1)).alias("overlap"))
    sides = primary.select("instrument").distinct().withColumn("_hp", F.lit(True)).join(
        fallback.select("instrument").distinct().withColumn("_hf", F.lit(True)), "instrument", "full")
    out = sides.join(counts, "instrument", "left").join(head, "instrument", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    short = F.col("overlap") < rows
    status = (
        F.when(F.col("_hp").isNull(), "fallback_only").when(F.col("_hf").isNull(), "primary_only").when(short, "missing_overlap")
        .when(~(F.col("scale") > 0) | (F.col("error") > max_error), "unstable_overlap").otherwise("aligned")
    )
    return out.select("instrument", status.alias("status"), F.when(~short, F.col("scale")).alias("scale"), "overlap",
                      F.when(~short, F.col("error")).alias("error"))


def apply_scale(fallback: DataFrame, evidence: DataFrame) -> DataFrame:
    """Multiply price columns by the scale of aligned instruments."""
    factor = evidence.where(F.col("status") == "aligned").select("instrument", F.col("scale").alias("_s"))
    out = fallback.join(factor, "instrument", "left")
    return out.withColumns({c: F.col(c) * F.coalesce("_s", F.lit(1.0)) for c in PRICE_COLUMNS}).drop("_s")


def signal_frame(signals: DataFrame, eligible: DataFrame, prices: DataFrame, cal_next: DataFrame) -> DataFrame:
    """Signals to their next session, with eligibility then and prices there."""
    nxt = F.broadcast(cal_next.withColumnRenamed("dt", "signal_dt").withColumnRenamed("next_dt", "trade_dt"))
    known = eligible.select(F.col("dt").alias("signal_dt"), "instrument", "eligible", "avg_amount", "listing_days")
    trade = prices.select(F.col("dt").alias("trade_dt"), "instrument", F.col("open").alias("trade_open"), F.col("close").alias("trade_close"))
    return signals.withColumnRenamed("dt", "signal_dt").join(nxt, "signal_dt").join(
        known, ["signal_dt", "instrument"], "left").join(trade, ["trade_dt", "instrument"])


def position_context(held: DataFrame, targets: DataFrame, windows: DataFrame, cal_next: DataFrame, costs: Costs) -> DataFrame:
    """Held rows with targets and the next session's execution prices.

    `held`: dt, instrument, shares, mark_price, weight. `targets`: dt,
    instrument, target_weight, target_shares, rank. `windows`: dt (execution
    session), instrument, open_exec, close_exec. Rows whose execution is not
    after the holding date raise.
    """
    w = windows.withColumnRenamed("dt", "trade_dt").join(
        F.broadcast(cal_next.withColumnRenamed("next_dt", "trade_dt")), "trade_dt")
    out = held.join(targets, ["dt", "instrument"], "left").join(w, ["dt", "instrument"], "left")
    leak = F.col("trade_dt") <= F.col("dt")
    out = out.withColumn("trade_dt", F.when(leak, F.raise_error(F.lit("execution data is not after the holding date")).cast("date")).otherwise(F.col("trade_dt")))
    out = out.withColumn("target_missing", F.col("rank").isNull().cast("int")).fillna(0.0, ["target_weight", "target_shares"])
    gap = F.col("target_weight") - F.col("weight")
    edge = ratio(F.col("open_exec") * (1.0 - costs.slippage) - F.col("close_exec") * (1.0 + costs.slippage), F.col("mark_price") + EPS) - costs.sell - costs.buy
    return out.withColumns({
        "weight_gap": gap, "abs_weight_gap": F.abs(gap), "share_gap": F.col("target_shares") - F.col("shares"),
        "share_ratio": ratio(F.col("target_shares"), F.col("shares") + EPS),
        "open_gap": ratio(F.col("open_exec"), F.col("mark_price") + EPS) - 1.0,
        "close_gap": ratio(F.col("close_exec"), F.col("mark_price") + EPS) - 1.0,
        "intraday_ret": ratio(F.col("close_exec"), F.col("open_exec") + EPS) - 1.0,
        "edge": edge, "hit": F.coalesce((edge > 0).cast("double"), F.lit(0.0)), "strong_hit": F.coalesce((edge > 0.002).cast("double"), F.lit(0.0)),
    })


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of several score tables on their keys."""
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def key_partition(new: DataFrame, old: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Shared, new-only and old-only keys."""
    a, b = new.select(*keys).distinct(), old.select(*keys).distinct()
    return {"shared": a.join(b, keys), "new_only": a.join(b, keys, "left_anti"), "old_only": b.join(a, keys, "left_anti")}


def incremental_refresh(cached: DataFrame, context: DataFrame, keys: list[str], context_cols: list[str], build) -> DataFrame:
    """Reuse cached rows of shared keys with fresh context; build only new keys."""
    reused = cached.drop(*context_cols).join(context.select(*keys, *context_cols), keys)
    fresh = build(context.join(cached.select(*keys).distinct(), keys, "left_anti"))
    return reused.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def split_blocked(df: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside a block list of instruments."""
    names = blocked.select("instrument").distinct()
    return df.join(names, "instrument", "left_anti"), df.join(names, "instrument", "left_semi")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer reconcile of `volume, amount` tables with a match status."""
    a = left.select(*keys, F.col("volume").alias("lv"), F.col("amount").alias("la"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("volume").alias("rv"), F.col("amount").alias("ra"), F.lit(True).alias("_r"))
    out = a.join(b, keys, "full")
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    out = out.withColumn("status", status).fillna(0.0, ["lv", "la", "rv", "ra"]).drop("_l", "_r")
    return out.withColumn("volume_diff", F.col("lv") - F.col("rv")).withColumn("amount_diff", F.col("la") - F.col("ra"))


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("status") != "right_only").alias("left_keys"), F.count_if(F.col("status") != "left_only").alias("right_keys"),
        F.count_if(F.col("status") == "both").alias("matched"), F.count_if(F.col("status") == "left_only").alias("left_only"),
        F.count_if(F.col("status") == "right_only").alias("right_only"), F.count_if(F.abs("volume_diff") > 1e-9).alias("volume_mismatch"),
        F.sum("volume_diff").alias("volume_diff"), F.sum("amount_diff").alias("amount_diff"))


def pit_coverage(listings: DataFrame, observed: DataFrame, cal: DataFrame, bars_per_session: int) -> DataFrame:
    """Per session: expected names, observed names inside and outside the listing, missing.

    `listings`: instrument, listed_dt, delisted_dt (null = open). The expected
    count is a running sum of listings minus delistings on the calendar, so no
    (session x listing) pairs are made.
    """
    ends = F.coalesce("delisted_dt", F.lit("2099-12-31").cast("date"))
    valid = listings.where(ends >= F.col("listed_dt"))
    ins = valid.groupBy(F.col("listed_dt").alias("d")).agg(F.count(F.lit(1)).alias("x"))
    outs = valid.groupBy(F.date_add(ends, 1).alias("d")).agg((-F.count(F.lit(1))).alias("x"))
    steps = ins.unionByName(outs).groupBy("d").agg(F.sum("x").alias("x"))
    run = steps.withColumn("live", F.sum("x").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).select("d", "live")
    expected = asof_join(cal.select("dt"), run, [], "dt", "d", ["live"]).select("dt", F.coalesce("live", F.lit(0)).alias("expected"))
    seen = observed.select("instrument", "dt").distinct().join(listings, "instrument", "left").groupBy("dt", "instrument").agg(
        F.coalesce(F.max((F.col("dt") >= F.col("listed_dt")) & (F.col("dt") <= ends)), F.lit(False)).alias("inside"))
    daily = seen.groupBy("dt").agg(F.count_if("inside").alias("observed"), F.count_if(~F.col("inside")).alias("unexpected"))
    out = expected.join(daily, "dt", "left").fillna(0, ["observed", "unexpected"])
    return out.withColumn("missing", F.col("expected") - F.col("observed")).withColumn("bars_expected", F.col("expected") * bars_per_session)


def missing_symbol_dates(listings: DataFrame, observed: DataFrame, cal: DataFrame) -> DataFrame:
    """Every listed (instrument, session) without a row.

    Dates are turned into session numbers on the distinct dates (calendar-sized),
    then each listing expands to its own sessions.
    """
    spans = listings.select("instrument", F.date_sub("listed_dt", 1).alias("_x"), F.coalesce("delisted_dt", F.lit("2099-12-31").cast("date")).alias("_y"))
    days = spans.select(F.col("_x").alias("d")).union(spans.select(F.col("_y").alias("d"))).distinct()
    at = F.broadcast(asof_join(days, cal, [], "d", "dt", ["session_no"]).select("d", F.coalesce("session_no", F.lit(0)).alias("no")))
    spans = spans.join(at.toDF("_x", "_a"), "_x").join(at.toDF("_y", "_b"), "_y").where("_a < _b")
    grid = spans.select("instrument", F.explode(F.sequence(F.col("_a") + 1, F.col("_b"))).alias("session_no"))
    grid = grid.join(F.broadcast(cal.select("dt", "session_no")), "session_no").select("instrument", "dt")
    return grid.join(observed.select("instrument", "dt").distinct(), ["instrument", "dt"], "left_anti")


def overlap_compare(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float) -> DataFrame:
    """Largest absolute difference per column and instrument, and whether it exceeds tol."""
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    diffs = a.select(*keys, *columns).join(right, keys)
    out = diffs.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(f"{c}_diff") for c in columns])
    return out.withColumn("exceeds", F.coalesce(F.greatest(*[F.col(f"{c}_diff") for c in columns]) > tol, F.lit(False)))


def contract_report(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """Key uniqueness, key gaps and value equality of two tables that must agree."""
    def dup(df: DataFrame) -> Column:
        return df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1))).scalar()

    r = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in equal], F.lit(1).alias("_r"))
    both = left.select(*keys, *equal, F.lit(1).alias("_l")).join(r, keys, "full")
    out = both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        *[F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_unequal") for c in equal])
    return out.withColumn("left_dup", dup(left)).withColumn("right_dup", dup(right))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; a repeated key raises when the frame runs.

    The keys are counted map-side first and only repeated ones are looked up, so
    the check adds one aggregate and no large join.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    text = F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys)))
    guard = repeated.agg(F.max(F.raise_error(text).cast("boolean")).alias("g")).scalar()
    return df.withColumn("_g", guard).where(F.col("_g").isNull()).drop("_g")


def drop_conflicts(a: DataFrame, b: DataFrame, keys: list[str], *, primary_wins: bool) -> DataFrame:
    """Candidates of two sets; keys in both are dropped, or the first set wins."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    kept_a = a if primary_wins else a.join(kb, keys, "left_anti")
    return kept_a.withColumn("side", F.lit("a")).unionByName(b.join(ka, keys, "left_anti").withColumn("side", F.lit("b")))


def market_state_blocks(wanted: DataFrame, bars: DataFrame, rejected: DataFrame, limit_pct: float) -> DataFrame:
    """Blocked sides per (dt, instrument) with reasons.

    `wanted`: dt, instrument. `bars`: dt, instrument, volume, pct. `rejected`:
    dt, instrument, side, detail; a halted detail blocks both sides.
    """
    state = wanted.join(bars.select("dt", "instrument", "volume", "pct", F.lit(1).alias("_has")), ["dt", "instrument"], "left")
    reason = (
        F.when(F.col("_has").isNull(), "row_missing").when(F.coalesce("volume", F.lit(0.0)) <= 0, "volume_zero")
        .when(F.abs("pct") >= limit_pct, "limit_move")
    )
    sides = F.array(F.lit("BUY"), F.lit("SELL"))
    daily = state.withColumn("reason", reason).where("reason is not null").select("dt", "instrument", sides.alias("sides"), "reason")
    orders = rejected.select("dt", "instrument", F.when(F.col("detail").contains("halt"), sides).otherwise(F.array("side")).alias("sides"), F.col("detail").alias("reason"))
    return daily.unionByName(orders).groupBy("dt", "instrument").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sides")))), ",").alias("sides"),
        F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))


def target_orders(old: DataFrame, new: DataFrame, prices: DataFrame, keys: list[str], costs: Costs) -> DataFrame:
    """Orders of a target change with fills, fees and cash effects."""
    a = old.select(*keys, "instrument", F.col("shares").alias("before"))
    b = new.select(*keys, "instrument", F.col("shares").alias("after"))
    out = a.join(b, [*keys, "instrument"], "full").fillna(0.0, ["before", "after"]).join(prices, [*keys, "instrument"], "left")
    delta = F.col("after") - F.col("before")
    price = F.coalesce("price", F.lit(0.0))
    side = F.when(delta < 0, "SELL").when(delta > 0, "BUY").otherwise("NONE")
    qty = F.abs(delta)
    out = out.withColumns({"missing_price": F.col("price").isNull(), "delta": delta, "side": side, "reference": qty * price})
    sold, bought = qty * price * (1.0 - costs.slippage), qty * price * (1.0 + costs.slippage)
    cash = (
        F.when(F.col("side") == "SELL", sold - F.greatest(sold * costs.sell, F.lit(costs.min_fee)))
        .when(F.col("side") == "BUY", -(bought + F.greatest(bought * costs.buy, F.lit(costs.min_fee)))).otherwise(0.0)
    )
    return out.withColumn("cash_effect", cash).withColumn(
        "cost", F.when(F.col("side") == "NONE", 0.0).when(F.col("side") == "SELL", F.col("reference") - F.col("cash_effect")).otherwise(-F.col("cash_effect") - F.col("reference")))


def transition_summary(orders: DataFrame, keys: list[str], nav: float) -> DataFrame:
    """Turnover, cost and cash of a change; sells settle before buys.

    The lowest cash is taken at the start, after the sells and at the end, where
    it lies whenever a sale brings in more than its fee.
    """
    sell, buy = F.col("side") == "SELL", F.col("side") == "BUY"

    def total(mask: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(mask, F.col(c))), F.lit(0.0))

    held = F.sum(F.col("before") * F.coalesce("price", F.lit(0.0)))
    out = orders.groupBy(*keys).agg(
        F.count_if("missing_price").alias("missing_prices"), F.count_if(sell).alias("sells"), F.count_if(buy).alias("buys"),
        total(sell, "reference").alias("sell_notional"), total(buy, "reference").alias("buy_notional"), F.sum("cost").alias("cost"),
        (F.lit(nav) - held).alias("cash_before"), total(sell, "cash_effect").alias("_s"), total(buy, "cash_effect").alias("_b"),
        F.count_if((F.col("before") > 0) & (F.col("after") > 0) & (F.col("delta") != 0)).alias("retained_changed"))
    after = F.col("cash_before") + F.col("_s")
    return out.withColumns({
        "turnover": (F.col("sell_notional") + F.col("buy_notional")) / nav,
        "cash_final": after + F.col("_b"), "cash_min": F.least(F.col("cash_before"), after, after + F.col("_b"))}).drop("_s", "_b")


def source_quality(primary: DataFrame, fallback: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Two sources per instrument: overlap, return and price differences, checks."""
    w = Window.partitionBy("instrument").orderBy("dt")

    def side(df: DataFrame, tag: str) -> DataFrame:
        bad = invalid_ohlc(*[F.col(c) for c in PRICE_COLUMNS])
        df = latest_per_key(df, ["instrument", "dt"], F.col("seq") if "seq" in df.columns else F.lit(0))
        out = df.withColumn("ret", ratio(F.col("close"), F.lag("close").over(w)) - 1.0).withColumn("bad", bad)
        return out.select("instrument", "dt", *[F.col(c).alias(f"{tag}_{c}") for c in [*BAR_COLUMNS, "ret", "bad"]], F.lit(1).alias(f"_{tag}"))

    both = stage(side(primary, "p").join(side(fallback, "f"), ["instrument", "dt"], "full"), "quality")
    common = F.col("_p").isNotNull() & F.col("_f").isNotNull()
    # The last known close of each side.
    anchors = both.where(common).groupBy("instrument").agg(*[
        F.max_by(f"{t}_close", F.when(F.col(f"{t}_close").isNotNull(), F.col("dt"))).alias(f"{t}a") for t in ("p", "f")])
    both = both.join(anchors, "instrument", "left")
    diff = F.when(common, F.abs(F.col("p_ret") - F.col("f_ret")))
    errors = F.array(*[F.when(common, ratio(F.abs(F.col(f"p_{c}") / F.col("pa") - F.col(f"f_{c}") / F.col("fa")), F.nullif(F.abs(F.col(f"f_{c}") / F.col("fa")), F.lit(0.0))))
                       for c in PRICE_COLUMNS])
    err = both.where(common).select("instrument", F.explode(errors).alias("e")).groupBy("instrument").agg(F.percentile("e", F.lit(0.95)).alias("ohlc_p95"))

    def logc(c: str) -> Column:
        x, y = (F.when(common, F.log1p(F.greatest(F.col(f"{t}_{c}"), F.lit(0.0)))) for t in ("p", "f"))
        return pair_corr(x, y, 3)

    out = both.groupBy("instrument").agg(
        F.count("_p").alias("primary_rows"), F.count("_f").alias("fallback_rows"), F.count_if(common).alias("common_rows"),
        (F.count_if(common) / F.count(F.lit(1))).alias("common_ratio"), F.percentile(diff, F.lit(0.5)).alias("ret_p50"),
        F.percentile(diff, F.lit(0.95)).alias("ret_p95"), F.max(diff).alias("ret_max"), logc("volume").alias("volume_corr"),
        logc("amount").alias("amount_corr"), F.count_if(F.coalesce("p_bad", F.lit(False))).alias("primary_invalid"),
        F.count_if(F.coalesce("f_bad", F.lit(False))).alias("fallback_invalid")).join(err, "instrument", "left")
    none = F.col("common_rows") == 0
    checks = {
        "common_ratio": F.col("common_ratio") >= limits["common_ratio"], "ret_p95": F.col("ret_p95") <= limits["ret_p95"],
        "ohlc_p95": F.col("ohlc_p95") <= limits["ohlc_p95"], "primary_ohlc": F.col("primary_invalid") == 0,
        "volume_corr": F.col("volume_corr") >= limits["corr"], "amount_corr": F.col("amount_corr") >= limits["corr"],
    }
    failed = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()])
    return out.withColumn("failed", F.when(none, F.lit("no_common_observations")).otherwise(failed)).withColumn("passed", F.col("failed") == "")


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field and instrument: non-null count, first and last date."""
    stats = []
    for f in fields:
        has = F.col(f).isNotNull()
        stats.append(F.struct(F.lit(f).alias("field"), F.count(f).alias("n"), F.min(F.when(has, F.col("dt"))).alias("first_dt"), F.max(F.when(has, F.col("dt"))).alias("last_dt")))
    return df.groupBy("instrument").agg(F.array(*stats).alias("s")).select("instrument", F.inline("s"))


def pool_coverage(covered: DataFrame) -> DataFrame:
    """Per field, from `coverage`: instruments, those with values, and the ranges of their first and last dates."""
    dates = [f(c).alias(f"{name}_{c}") for c in ("first_dt", "last_dt") for name, f in (("earliest", F.min), ("latest", F.max))]
    return covered.groupBy("field").agg(F.count(F.lit(1)).alias("instruments"), F.count_if(F.col("n") > 0).alias("with_values"), *dates)


def value_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field its finite values' count, mean, median, deviation, share above zero and quantiles.

    Rows become one narrow row per field and value; quantiles are exact in groups
    of any size. A field without finite values has count 0 and nulls.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])))
    clean = stage(long.where(F.abs("value") < float("inf")), "profile")
    points = quantiles(clean, ["field"], "value", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95})
    sums = clean.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg((F.col("value") > 0).cast("double")).alias("positive_ratio"))
    names = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(sums, "field", "left").join(points, "field", "left").fillna(0, ["n"])


def direction_agreement(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair of fields the rows that have both and the share with the same sign (up or not)."""
    stats = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        same = F.avg(F.when(both, ((F.col(a) > 0) == (F.col(b) > 0)).cast("double")))
        stats.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("rows"), same.alias("agreement")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def fold_coverage(folded: DataFrame, min_names: int) -> DataFrame:
    """Per fold: sessions, rows, names and whether the fold is blocked."""
    out = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dt").alias("sessions"), F.count_distinct("instrument").alias("names"))
    return out.withColumn("blocked", F.col("names") < min_names)


def target_table_audit(targets: DataFrame, blocked: DataFrame, minimum: Column, lot: int = 100) -> DataFrame:
    """Per date: rows, weight sum, lot and minimum-lot violations, blocked names."""
    flag = targets.join(blocked.select("instrument").distinct().withColumn("_b", F.lit(True)), "instrument", "left")
    return flag.groupBy("dt").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument").alias("names"), F.sum("weight").alias("weight_sum"), F.sum("shares").alias("shares_sum"),
        F.count_if(F.col("shares") % lot != 0).alias("lot_violations"), F.count_if((F.col("shares") > 0) & (F.col("shares") < minimum)).alias("min_lot_violations"),
        F.count_if(F.coalesce("_b", F.lit(False))).alias("blocked_names"))


def fill_aggregate(events: DataFrame, status: str = "Filled") -> DataFrame:
    """Filled volume and amount per (dt, instrument, side)."""
    done = events.where((F.col("status") == status) & (F.col("volume") > 0))
    return done.groupBy("dt", "instrument", "side").agg(F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))


# Texts of market-restriction rejections.
RESTRICTION_TERMS = ["halt", "limit", "停牌", "涨停", "跌停"]


def _restricted(detail: str) -> Column:
    return F.coalesce(F.col(detail).rlike("|".join(RESTRICTION_TERMS)), F.lit(False))


def rejection_summary(events: DataFrame) -> DataFrame:
    """Rejected orders by cause and side, and sells never filled afterwards.

    Input: instrument, side, status, detail, ts.
    """
    rej = events.where(F.col("status") == "Rejected")
    last = rej.where(F.col("side") == "SELL").groupBy("instrument").agg(F.max("ts").alias("last_rej"))
    fills = events.where((F.col("status") == "Filled") & (F.col("side") == "SELL")).groupBy("instrument").agg(F.max("ts").alias("last_fill"))
    open_sells = last.join(fills, "instrument", "left").where(F.col("last_fill").isNull() | (F.col("last_fill") < F.col("last_rej")))
    keys = rej.select("instrument", "side").distinct().agg(F.count(F.lit(1)))
    ok = _restricted("detail")
    return rej.agg(
        F.count_if(ok).alias("expected"), F.count_if(~ok).alias("unexpected"), F.count_distinct("instrument").alias("symbols"),
        F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells")
    ).withColumn("symbol_sides", keys.scalar()).withColumn("unresolved_sells", open_sells.agg(F.count(F.lit(1))).scalar())


# Statuses after which an order no longer changes.
TERMINAL = ["Filled", "Canceled", "Rejected", "Expired", "Suspended"]


def latest_order_state(events: DataFrame) -> DataFrame:
    """Latest event per order: the order id, or symbol/side/target/created."""
    fallback = F.concat_ws("|", F.col("instrument").cast("string"), "side", F.col("target").cast("string"), F.col("created").cast("string"))
    key = F.coalesce(F.col("order_id").cast("string"), fallback)
    return latest_per_key(events.withColumn("order_key", key), ["order_key"], F.struct("ts", "seq"))


def session_reconcile(events: DataFrame, targets: DataFrame, actual: DataFrame, deferred: DataFrame) -> DataFrame:
    """Target against actual holdings, each difference explained or not."""
    latest = latest_order_state(events)
    stuck = latest.where((F.col("status") == "Rejected") & (F.col("side") == "SELL") & _restricted("detail")).select("instrument", F.lit(True).alias("_stuck")).distinct()
    wait = deferred.select("instrument", F.lit(True).alias("_wait")).distinct()
    out = targets.select("instrument", F.col("volume").alias("target")).join(actual.select("instrument", F.col("volume").alias("actual")), "instrument", "full")
    out = out.fillna(0, ["target", "actual"]).withColumn("difference", F.col("actual") - F.col("target")).where("difference <> 0")
    out = out.join(stuck, "instrument", "left").join(wait, "instrument", "left")
    why = F.when((F.col("difference") > 0) & F.col("_stuck"), "blocked_sell").when((F.col("difference") < 0) & F.col("_wait"), "deferred_buy").otherwise("unexplained")
    return out.withColumn("explanation", why).drop("_stuck", "_wait")


def constant_within_group(df: DataFrame, keys: list[str], values: list[str], spread: float = 1e-10) -> DataFrame:
    """One row per group, with a flag telling whether each value was constant."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(v).alias(v) for v in values],
        F.greatest(*[F.coalesce(F.max(v) - F.min(v), F.lit(0.0)) for v in values], F.lit(0.0)).alias("spread")
    ).withColumn("constant", F.col("spread") <= spread)


def resolve_duplicates(df: DataFrame, keys: list[str], values: list[str], order: str, *, atol: float = 1e-8, rtol: float = 1e-8) -> DataFrame:
    """Last non-null value per key; keys whose values disagree are flagged."""
    aggs, bad = [], []
    for v in values:
        scale = F.greatest(F.lit(1.0), F.max(F.abs(v)))
        bad.append(F.coalesce(F.max(v) - F.min(v) > atol + rtol * scale, F.lit(False)))
        aggs.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), reduce(lambda a, b: a | b, bad).alias("conflict"), *aggs)


def pool_candidate_score(held: DataFrame, targets: DataFrame) -> DataFrame:
    """held*10 + target*2 + unmapped + allocated - rank/10000 per instrument.

    `held`: instrument, shares. `targets`: instrument, mapped, shares, rank.
    """
    h = held.where("shares > 0").groupBy("instrument").agg(F.count(F.lit(1)).alias("held_days"))
    t = targets.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("target_days"), F.count_if(F.coalesce("mapped", F.lit(0)) != 1).alias("unmapped_days"),
        F.count_if(F.coalesce("shares", F.lit(0.0)) > 0).alias("allocated_days"), F.avg("rank").alias("avg_rank"))
    out = h.join(t, "instrument", "full").fillna(0, ["held_days", "target_days", "unmapped_days", "allocated_days"]).fillna(999999.0, ["avg_rank"])
    return out.withColumn("score", F.col("held_days") * 10 + F.col("target_days") * 2 + F.col("unmapped_days") + F.col("allocated_days") - F.col("avg_rank") / 10000.0)


def concentration_snapshot(df: DataFrame) -> DataFrame:
    """Per date: names, groups, the largest group with its count and share."""
    per = df.groupBy("dt", F.coalesce("grp", F.lit("__UNKNOWN__")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    best = F.struct("n", F.col("grp").alias("g"))
    return per.groupBy("dt").agg(F.sum("n").alias("names"), F.count(F.lit(1)).alias("groups"), F.max(best).alias("b")).select(
        "dt", "names", "groups", F.col("b.g").alias("largest"), F.col("b.n").alias("largest_n"), (F.col("b.n") / F.col("names")).alias("fraction"))


def rule_checks(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Named metrics against limits (`min`, `max`, `equal`); missing fails.

    Input: metric, value. Adds `all_passed` over every rule.
    """
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), F.lit(float(v)).alias("bound")) for m, k, v in rules]))
    table = metrics.sparkSession.range(1).select(rows)
    joined = table.join(metrics.select("metric", "value"), "metric", "left")
    ok = (F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).when(F.col("kind") == "max", F.col("value") <= F.col("bound"))
          .otherwise(F.col("value") == F.col("bound")))
    out = joined.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return out.withColumn("all_passed", F.min("passed").over(Window.partitionBy(F.lit(0))))
