"""Top-k selection, caps, buffers, budgets and lot allocation.

`row_number() <= n` filters let Spark keep only the best n rows per group before
the shuffle (window group limit), so one huge date does not reach one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.symbols import min_lot
from tapeloom.operators.streamed import fold_columns
from tapeloom.session import stage
from tapeloom.skew import PER_RANGE, row_position


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    """Top n per group by score descending, tie ascending, as `rank`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def group_capped_top_k(ranked: DataFrame, previous: DataFrame, keys: list[str], *, top_k: int, buffer_k: int, fraction: float,
                       round_up: bool = False) -> DataFrame:
    """Previous names still inside the buffer first, then by rank; a cap per group.

    Input: keys, instrument, rank, grp; `previous`: keys, instrument. The i-th
    kept name of a group never depends on other groups, so the greedy walk is two
    row_number filters: the group cap, then the overall k.
    """
    limit = top_k * fraction
    cap = max(1, int(-(-limit // 1)) if round_up else int(limit // 1))
    prev = previous.select(*keys, "instrument", F.lit(1).alias("_prev")).distinct()
    marked = ranked.join(prev, [*keys, "instrument"], "left")
    retained = (F.col("_prev").isNotNull() & (F.col("rank") <= buffer_k)).cast("int")
    order = [F.col("_kept").desc(), F.col("rank").asc()]
    marked = marked.withColumn("_kept", retained).drop("_prev")
    in_group = F.row_number().over(Window.partitionBy(*keys, F.coalesce("grp", F.lit("__UNKNOWN__"))).orderBy(*order))
    capped = marked.withColumn("_g", in_group).where(F.col("_g") <= cap)
    overall = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return capped.withColumn("pick", overall).where(F.col("pick") <= top_k).withColumnRenamed("_kept", "retained").drop("_g")


def rank_hysteresis(ranked: DataFrame, *, enter: int, leave: int) -> DataFrame:
    """Membership by hysteresis: join at rank <= enter, leave at rank > leave."""
    w = Window.partitionBy("instrument").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("rank") <= enter, 1).when(F.col("rank") > leave, 0)
    return ranked.withColumn("member", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)) == 1)


def buffered_membership(ranked: DataFrame, profile: str, *, top_k: int, buffer_k: int) -> DataFrame:
    """Exact size-k membership over the dates, each using the previous result.

    Only ranks <= buffer_k + top_k can ever be picked: a date is one short array,
    and each profile's dates are walked in order with the last picks as state.
    """
    near = ranked.where(F.col("rank") <= buffer_k + top_k)
    days = near.groupBy(profile, "dt").agg(F.sort_array(F.collect_list(F.struct("rank", "instrument"))).alias("_names"))
    kind = ranked.schema["instrument"].dataType.simpleString()

    def step(before: list, names: list[dict]) -> tuple[list, tuple]:
        held = {*before}
        kept = [r["instrument"] for r in names if r["rank"] <= buffer_k and r["instrument"] in held]
        picked = (kept + [r["instrument"] for r in names if r["instrument"] not in {*kept}])[:top_k]
        return picked, (picked,)

    out = fold_columns(days, [profile], ["dt"], ["_names"], f"picked array<{kind}>", list, step)
    return out.select(profile, "dt", F.posexplode("picked").alias("pos", "instrument"))


def two_sided_candidates(df: DataFrame, *, buy_at: float, sell_at: float, buy_n: int, sell_n: int, total: int,
                         buy_offset: float = 0.006, sell_offset: float = 0.0075) -> DataFrame:
    """Best buys and sells per date, names on both sides dropped, capped, priced.

    Input: dt, instrument, code, held, available, price, buy_score, sell_score.
    """
    lot = min_lot(F.col("code"))
    ok = df.withColumn("lot", lot).where((F.col("held") >= 2 * F.col("lot")) & (F.col("available") >= F.col("lot")) & (F.col("price") > 0))
    buys = top_n(ok.where(F.col("buy_score") >= buy_at), ["dt"], "buy_score", "instrument", buy_n).withColumn(
        "direction", F.lit("buy_first")).withColumn("score", F.col("buy_score"))
    sells = top_n(ok.where(F.col("sell_score") >= sell_at), ["dt"], "sell_score", "instrument", sell_n).withColumn(
        "direction", F.lit("sell_first")).withColumn("score", F.col("sell_score"))
    both = buys.unionByName(sells)
    clash = F.count(F.lit(1)).over(Window.partitionBy("dt", "instrument"))
    kept = both.withColumn("_c", clash).where(F.col("_c") == 1).drop("_c", "rank")
    out = top_n(kept, ["dt"], "score", "instrument", total)
    limit = F.when(F.col("direction") == "buy_first", F.col("price") * (1.0 - buy_offset)).otherwise(F.col("price") * (1.0 + sell_offset))
    return out.withColumn("entry_limit", limit).withColumn("volume", F.col("lot"))


def one_sided_candidates(df: DataFrame, *, n: int, at_least: float | None = None, offset: float = 0.0075) -> DataFrame:
    """Best sell candidates per date with lots to spare, and their limit price."""
    lot = min_lot(F.col("code"))
    ok = df.withColumn("lot", lot).where((F.col("held") >= 2 * F.col("lot")) & (F.col("available") >= F.col("lot")) & (F.col("price") > 0))
    if at_least is not None:
        ok = ok.where(F.col("sell_score") >= at_least)
    return top_n(ok, ["dt"], "sell_score", "instrument", n).withColumn("entry_limit", F.col("price") * (1.0 + offset))


def prefix_until_share(df: DataFrame, keys: list[str], value: str, tie: str, share: float, max_rows: int | None = None,
                       per_range: int = PER_RANGE) -> DataFrame:
    """Largest first until the running sum reaches a share of the group's total.

    The first row always counts. Positions are exact for groups of any size; the
    running sum then runs per block of positions plus the sums of earlier blocks.
    """
    block = 100_000
    frame = row_position(stage(df, "prefix"), keys, value, tie, "pos", descending=True, per_range=per_range, staged=True)
    frame = frame.withColumn("_b", F.floor((F.col("pos") - 1) / block))
    sums = frame.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(w), F.lit(0.0))).withColumn("_total", F.sum("_s").over(Window.partitionBy(*keys))).drop("_s")
    local = Window.partitionBy(*keys, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = frame.join(sums, [*keys, "_b"]).withColumn("before", F.col("_off") + F.coalesce(F.sum(value).over(local), F.lit(0.0)))
    kept = out.where((F.col("before") < F.col("_total") * share) | (F.col("pos") == 1))
    if max_rows is not None:
        kept = kept.where(F.col("pos") <= max_rows)
    return kept.drop("_b", "_off", "_total")


def equal_weight_lots(df: DataFrame, keys: list[str], *, budget: Column, k: int, lot: int = 100) -> DataFrame:
    """Fixed allocation: budget / k per name, floored to lots.

    Input: keys, instrument, rank, price, lot_min.
    """
    raw = F.floor(F.try_divide(budget / k, F.col("price")) / lot) * lot
    ok = (F.col("price") > 0) & (F.col("rank") <= k)
    shares = F.when(ok & (raw >= F.greatest(F.col("lot_min"), F.lit(lot))), raw).otherwise(0.0)
    return df.where(ok).withColumn("shares", shares)


def capital_aware_lots(df: DataFrame, keys: list[str], *, budget: Column, k: int, lot: int = 100) -> DataFrame:
    """Widest equal-weight subset that is affordable, then one spare lot per name.

    The widest count n is the largest n whose n-th cheapest minimum order still
    costs at most budget / n. The first n affordable names by rank are sized, and
    the remainder buys one more lot per name, closest to the ideal value first;
    that pass folds over at most k names of a portfolio.
    """
    base = df.where((F.col("price") > 0) & (F.col("rank") <= k)).withColumn("_min", F.greatest("lot_min", F.lit(lot)) * F.col("price")).withColumn("_bud", budget)
    by_cost = Window.partitionBy(*keys).orderBy("_min", "rank")
    widest = base.withColumn("_i", F.row_number().over(by_cost)).where(F.col("_min") * F.col("_i") <= F.col("_bud") + 1e-9).groupBy(*keys).agg(F.max("_i").alias("n_names"))
    fit = base.join(widest, keys).withColumn("_ideal", F.col("_bud") / F.col("n_names")).where(F.col("_min") <= F.col("_ideal") + 1e-9)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    fit = fit.withColumn("_o", first).where(F.col("_o") <= F.col("n_names"))
    raw = F.floor(F.col("_ideal") / F.col("price") / lot) * lot
    fit = fit.withColumn("base_shares", F.when(raw >= F.greatest("lot_min", F.lit(lot)), raw).otherwise(0.0)).where("base_shares > 0")
    now = F.col("base_shares") * F.col("price")
    penalty = F.abs(now + lot * F.col("price") - F.col("_ideal")) - F.abs(now - F.col("_ideal"))
    item = F.struct(penalty.alias("p"), F.col("_o").alias("o"), (lot * F.col("price")).alias("v"), F.col("instrument").alias("i"))
    spent = F.max("_bud") - F.sum(now)
    seq = fit.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("rs"), F.greatest(F.lit(0.0), spent).alias("left"))
    kind = df.schema["instrument"].dataType.simpleString()
    start = F.struct(F.col("left").alias("left"), F.expr(f"cast(array() as array<{kind}>)").alias("got"))

    def step(s: Column, r: Column) -> Column:
        fits = r["v"] <= s["left"] + 1e-9
        return F.struct(F.when(fits, s["left"] - r["v"]).otherwise(s["left"]).alias("left"),
                        F.when(fits, F.array_append(s["got"], r["i"])).otherwise(s["got"]).alias("got"))

    got = seq.select(*keys, F.explode(F.aggregate("rs", start, step, lambda s: s["got"])).alias("instrument"), F.lit(1).alias("_extra"))
    out = fit.join(got, [*keys, "instrument"], "left")
    return out.withColumn("shares", F.col("base_shares") + F.coalesce("_extra", F.lit(0)) * lot).drop("_min", "_bud", "_ideal", "_o", "_extra")


def union_missing(selected: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct selected instruments not yet present."""
    return selected.select("instrument").distinct().join(present.select("instrument").distinct(), "instrument", "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: list[str], n: int, keep_all: Column | None = None) -> DataFrame:
    """At most n rows per class by a stable hash order; some rows always kept.

    The order is that of the MD5 of the key's texts, joined by bars, so any engine
    draws the same rows.
    """
    order = [F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])), *[F.col(c) for c in key]]
    forced = F.lit(False) if keep_all is None else F.coalesce(keep_all, F.lit(False))
    rest = df.where(~forced).withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    return rest if keep_all is None else rest.unionByName(df.where(forced))


def ordered_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of an order (planned as a top-k, not a global sort)."""
    return df.orderBy(*order).limit(n)
