"""Account metrics: NAV statistics, pnl concentration, folds, candidates.

NAV series have one row per session, so per-series windows are calendar-sized;
trades of any number are first reduced per symbol, date or period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import ratio, trailing
from tapeloom.operators.rolling import drawdown


def nav_metrics(nav: DataFrame, key: str, *, year: float = 252.0) -> DataFrame:
    """Annualised return, Sharpe, drawdown, worst day and three days, turnover.

    Input: key, dt, nav, and optionally turnover and trades per session.
    """
    w = Window.partitionBy(key).orderBy("dt")
    out = drawdown(nav, [key]).withColumn("_r", ratio(F.col("nav"), F.lag("nav").over(w)) - 1.0)
    out = out.withColumn("_r3", F.when(F.count("_r").over(trailing(w, 3)) >= 3, F.sum("_r").over(trailing(w, 3))))
    n, sd = F.count(F.lit(1)), F.stddev_samp("_r")
    growth = ratio(F.max_by("nav", "dt"), F.min_by("nav", "dt"))
    sums = [F.sum(c).alias(c) for c in ("turnover", "trades") if c in nav.columns]
    return out.groupBy(key).agg(
        n.alias("days"), F.max_by("nav", "dt").alias("final_nav"),
        F.when(n < 2, 0.0).otherwise(F.pow(growth, F.lit(year) / n) - 1.0).alias("annual_return"),
        F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, 0.0).otherwise(F.try_divide(F.avg("_r"), sd) * F.sqrt(F.lit(year))).alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"), F.min("_r").alias("worst_day"), F.min("_r3").alias("worst_3d"), *sums)


def holdout_metrics(nav: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """`nav_metrics` plus monthly returns, cash, exposure and a weighted utility.

    Input adds cash, exposure, rebalance. The first month starts at the first NAV.
    """
    base = nav_metrics(nav, key)
    first = F.min_by("nav", "dt")
    months = nav.groupBy(key, F.date_trunc("month", "dt").alias("m")).agg(F.max_by("nav", "dt").alias("end"), first.alias("start"))
    w = Window.partitionBy(key).orderBy("m")
    months = months.withColumn("_mr", ratio(F.col("end"), F.coalesce(F.lag("end").over(w), "start")) - 1.0)
    monthly = months.groupBy(key).agg(F.min("_mr").alias("worst_month"), F.avg((F.col("_mr") > 0).cast("double")).alias("positive_months"), F.count(F.lit(1)).alias("months"))
    extra = nav.groupBy(key).agg(
        (ratio(F.max_by("nav", "dt"), F.min_by("nav", "dt")) - 1.0).alias("total_return"), F.min(ratio(F.col("cash"), F.col("nav"))).alias("min_cash_ratio"),
        F.max("exposure").alias("max_exposure"), F.sum(F.col("rebalance").cast("int")).alias("rebalances"), F.max("turnover").alias("max_daily_turnover"))
    out = base.join(monthly, key).join(extra, key)
    score = (F.lit(weights["return"]) * F.col("total_return") + weights["sharpe"] * F.col("sharpe")
             - weights["drawdown"] * F.col("max_drawdown") - weights["turnover"] * F.col("turnover"))
    return out.withColumn("utility", score)


def pnl_concentration(trades: DataFrame) -> DataFrame:
    """Profit factor, top symbols' share of gains, active and losing months."""
    gain, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    per = trades.groupBy("instrument").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("g"))
    top = per.orderBy(F.col("g").desc(), "instrument").limit(3)
    months = trades.groupBy(F.date_trunc("month", "dt").alias("m")).agg(F.sum("pnl").alias("p"))
    one = trades.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("gross_gain"), F.sum(loss).alias("gross_loss"))
    return one.select(
        F.when(F.col("gross_loss") < 0, F.col("gross_gain") / F.abs("gross_loss")).alias("profit_factor"),
        per.agg(F.count(F.lit(1))).scalar().alias("symbols"),
        ratio(top.agg(F.max("g")).scalar(), F.nullif("gross_gain", F.lit(0.0))).alias("top1_share"),
        ratio(top.agg(F.sum("g")).scalar(), F.nullif("gross_gain", F.lit(0.0))).alias("top3_share"),
        months.agg(F.count(F.lit(1))).scalar().alias("active_months"), months.agg(F.count_if(F.col("p") < 0)).scalar().alias("losing_months"))


def fold_economics(trades: DataFrame, base_nav: float) -> DataFrame:
    """Pnl, return and hit share per fold (input: fold, dt, pnl)."""
    return trades.groupBy("fold").agg(
        F.sum("pnl").alias("pnl"), (F.sum("pnl") / base_nav).alias("ret"), F.count(F.lit(1)).alias("round_trips"),
        F.count_distinct("dt").alias("active_days"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_ratio"))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("pnl") > 0).alias("profitable"), F.min("pnl").alias("worst_pnl"),
                     F.percentile("ret", F.lit(0.5)).alias("median_ret"), F.min("ret").alias("worst_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_ratio"))


def period_breakdown(trades: DataFrame, period: str) -> DataFrame:
    """Pnl, trades, largest daily turnover and share per month, quarter or symbol."""
    total = trades.agg(F.sum("pnl")).scalar()
    if period == "instrument":
        out = trades.groupBy(F.col("instrument").cast("string").alias("period")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))
    else:
        day = trades.groupBy("dt").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"), F.sum("turnover").alias("t"))
        out = day.groupBy(F.date_format(F.date_trunc(period, "dt"), "yyyy-MM-dd").alias("period")).agg(
            F.sum("pnl").alias("pnl"), F.sum("n").alias("trades"), F.max("t").alias("max_turnover"))
    return out.withColumn("share", ratio(F.col("pnl"), F.nullif(total, F.lit(0.0))))


def extreme_trades(trades: DataFrame, n: int, tie: list[str]) -> DataFrame:
    """The n best and n worst trades."""
    best = trades.orderBy(F.col("pnl").desc(), *tie).limit(n).withColumn("which", F.lit("best"))
    return best.unionByName(trades.orderBy("pnl", *tie).limit(n).withColumn("which", F.lit("worst")))


def robust_score(prefix: str = "") -> Column:
    """Median + worst return, small Sharpe bonus, drawdown and turnover penalties."""
    c = lambda name: F.coalesce(F.col(f"{prefix}{name}"), F.lit(0.0))
    return c("median_return") + c("worst_return") + 0.02 * c("median_sharpe") - c("median_drawdown") - 0.003 * c("median_turnover")


def candidate_ranking(metrics: DataFrame, baseline) -> DataFrame:
    """Robust score over folds, rank, and strict dominance over a baseline.

    Input: candidate, fold, ret, sharpe, drawdown, turnover (candidates x folds).
    """
    def med(c: str) -> Column:
        return F.percentile(c, F.lit(0.5))

    out = metrics.groupBy("candidate").agg(
        med("ret").alias("median_return"), F.min("ret").alias("worst_return"), med("sharpe").alias("median_sharpe"),
        med("drawdown").alias("median_drawdown"), med("turnover").alias("median_turnover")).withColumn("score", robust_score())
    base = out.where(F.col("candidate") == baseline).select(F.struct("median_return", "worst_return", "median_drawdown").alias("b")).scalar()
    out = out.withColumn("_b", base)
    better = ((F.col("median_return") > F.col("_b.median_return")) & (F.col("worst_return") > F.col("_b.worst_return"))
              & (F.col("median_drawdown") < F.col("_b.median_drawdown")))
    w = Window.orderBy(F.col("score").desc(), "candidate")
    return out.withColumn("dominates", better).withColumn("rank", F.row_number().over(w)).drop("_b")


def leave_one_fold_out(metrics: DataFrame) -> DataFrame:
    """Per held-out fold the best candidate on the other folds and its own result.

    Each candidate row is copied to the other folds (a handful), never joined
    within a candidate.
    """
    folds = metrics.agg(F.array_sort(F.collect_set("fold"))).scalar()
    others = metrics.withColumn("_f", folds).withColumn("heldout", F.explode("_f")).where("heldout <> fold")

    def med(c: str) -> Column:
        return F.percentile(c, F.lit(0.5))

    dev = others.groupBy("heldout", "candidate").agg((med("ret") + F.min("ret") + 0.02 * med("sharpe") - med("drawdown")).alias("dev_score"))
    pick = dev.withColumn("_k", F.row_number().over(Window.partitionBy("heldout").orderBy(F.col("dev_score").desc(), "candidate"))).where("_k = 1")
    own = metrics.select(F.col("fold").alias("heldout"), "candidate", "ret", "sharpe", "drawdown")
    return pick.drop("_k").join(own, ["heldout", "candidate"])


def scenario_delta(metrics: DataFrame, base: str, stress: str) -> DataFrame:
    """Metric deltas between two scenarios per profile (input: profile, scenario, ret, mdd, turnover)."""
    def pick(s: str, c: str) -> Column:
        return F.max(F.when(F.col("scenario") == s, F.col(c)))

    return metrics.groupBy("profile").agg(*[e for c in ("ret", "mdd", "turnover") for e in (
        pick(base, c).alias(f"base_{c}"), pick(stress, c).alias(f"stress_{c}"), (pick(stress, c) - pick(base, c)).alias(f"{c}_delta"))])


def final_holdings(holdings: DataFrame) -> DataFrame:
    """Number of names held on each profile's last date."""
    last = holdings.groupBy("profile").agg(F.max("dt").alias("dt"))
    return holdings.join(last, ["profile", "dt"]).groupBy("profile").agg(F.count_distinct("instrument").alias("final_names"))


def executed_summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Round trips, pnl, profit factor, hit share, dates and symbols; with keys one row for each that has a trade."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("round_trips"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("cum_pnl"),
        F.when(loss < 0, F.coalesce(gain, F.lit(0.0)) / F.abs(loss)).alias("profit_factor"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("hit_ratio"), F.count_distinct("dt").alias("active_dates"), F.count_distinct("instrument").alias("symbols"))


def grid_days(rows: DataFrame, score: str, label: str, buys: list[float], sells: list[float], cost: float = 0.0) -> DataFrame:
    """Daily return of every pair of a buy and a sell cut: candidate, buy, sell, dt, ret, share.

    Names at or above the buy cut are held, those at or below the sell cut are
    sold short, each side with equal weights; a side without names earns nothing.
    `share` is the part of the day's names in either side and costs `cost` each.
    Rows without score or label take no part. The rows are read once: a date
    keeps a mean and a count per cut, and pairs are formed from those.
    """
    def side(hit: Column) -> Column:
        return F.struct(F.coalesce(F.avg(F.when(hit, F.col(label))), F.lit(0.0)).alias("mean"), F.count_if(hit).alias("n"))

    days = rows.dropna(subset=[score, label]).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[side(F.col(score) >= b) for b in buys]).alias("_long"), F.array(*[side(F.col(score) <= s) for s in sells]).alias("_short"))
    pairs = [(i * len(sells) + j, b, s, i, j) for i, b in enumerate(buys) for j, s in enumerate(sells)]
    grid = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("candidate", "buy", "sell", "i", "j"), p, strict=True)]) for p in pairs])
    each = days.select("*", F.inline(grid))
    long, short = F.col("_long")[F.col("i")], F.col("_short")[F.col("j")]
    share = (long["n"] + short["n"]) / F.col("n")
    return each.select("candidate", "buy", "sell", "dt", (long["mean"] - short["mean"] - cost * share).alias("ret"), share.alias("share"))


def grid_metrics(days: DataFrame, fold: Column, *, year: float = 252.0) -> DataFrame:
    """Per candidate and fold: ret (sum), sharpe, drawdown of the summed return from its peak (0 at the start), turnover.

    Takes the rows of `grid_days`; a group is one candidate's dates of one fold,
    so it is bounded by the calendar. Dates without a fold take no part. Feeds
    `candidate_ranking` and `leave_one_fold_out`.
    """
    own = days.withColumn("fold", fold).where("fold is not null")
    w = Window.partitionBy("candidate", "fold").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("_sum", F.sum("ret").over(w))
    run = run.withColumn("_down", F.greatest(F.lit(0.0), F.max("_sum").over(w)) - F.col("_sum"))
    sd = F.stddev_samp("ret")
    return run.groupBy("candidate", "buy", "sell", "fold").agg(
        F.sum("ret").alias("ret"), F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, 0.0).otherwise(F.try_divide(F.avg("ret"), sd) * F.sqrt(F.lit(year))).alias("sharpe"),
        F.max("_down").alias("drawdown"), F.avg("share").alias("turnover"))
