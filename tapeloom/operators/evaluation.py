"""Score evaluation: rank correlations, quantile tables, AUC, daily profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.guards import EPS, pair_corr, ratio
from tapeloom.session import stage
from tapeloom.skew import FITS, PER_RANGE, average_ranks, check_groups, quantiles, row_position, value_counts


def market_breadth(panel: DataFrame, ret: str, eligible: Column | None = None) -> DataFrame:
    """Per date: count, mean return, share rising, dispersion, mean amount."""
    rows = panel if eligible is None else panel.where(eligible)
    up = F.coalesce((F.col(ret) > 0).cast("double"), F.lit(0.0))
    return rows.groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("ret"), F.avg(up).alias("breadth"),
        F.stddev_samp(ret).alias("dispersion"), F.avg("amount").alias("amount"))


def path_outcomes(paths: DataFrame, horizon: int, adverse: float = 0.05) -> DataFrame:
    """Average forward path over names per date: end, low, drawdown, downside.

    Input: dt and cumret_1..cumret_h. The averages are one grouped aggregate;
    the path statistics then work on an array of `horizon` steps per date.
    """
    steps = [F.avg(f"cumret_{k}").alias(f"m{k}") for k in range(1, horizon + 1)]
    daily = paths.groupBy("dt").agg(*steps).withColumn("p", F.array(*[F.col(f"m{k}") for k in range(1, horizon + 1)]))
    known = F.filter("p", lambda x: x.isNotNull())
    zero = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("dd"))

    def step(s: Column, x: Column) -> Column:
        peak = F.greatest(s["peak"], 1.0 + x)
        return F.struct(peak.alias("peak"), F.greatest(s["dd"], 1.0 - (1.0 + x) / peak).alias("dd"))

    pairs = F.transform(F.sequence(F.lit(1), F.lit(horizon - 1)),
                        lambda i: ratio(1.0 + F.element_at("p", i + 1), 1.0 + F.element_at("p", i)) - 1.0)
    falls = F.filter(pairs, lambda r: r < 0)
    mean = F.aggregate("falls", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("falls"), F.lit(0))
    ss = F.aggregate("falls", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    down = F.when(F.size("falls") > 1, F.sqrt(ss / F.nullif(F.size("falls") - 1, F.lit(0)))).when(F.size("falls") == 0, F.lit(0.0))
    out = daily.withColumn("known", known).withColumn("falls", falls).select(
        "dt", F.element_at("p", horizon).alias("fwd"), F.array_min("known").alias("low"),
        F.when(F.size("known") > 0, F.aggregate("known", zero, step, lambda s: s["dd"])).alias("mdd"), down.alias("downside_vol"))
    both = F.col("mdd").isNotNull() & F.col("fwd").isNotNull()
    return out.withColumns({
        "adverse_mdd": F.when(both, (F.col("mdd") > adverse).cast("double")),
        "adverse_loss": F.when(both, (F.col("fwd") < -adverse).cast("double")),
        "adverse_combo": F.when(both, ((F.col("mdd") > adverse) | (F.col("fwd") < -adverse)).cast("double")),
    })


def bucket_of_rank(rank: Column, n: Column, k: int) -> Column:
    """Equal buckets of ranks 1..n by linear quantile edges, 0-based."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * k / F.nullif(n - 1, F.lit(0))) - 1)


def quantile_buckets(df: DataFrame, signal: str, tie: str, outcomes: list[str], k: int = 5, per_range: int = PER_RANGE) -> DataFrame:
    """Mean outcome per signal bucket over the whole sample."""
    rows = stage(df.select(signal, tie, *outcomes).dropna(subset=[signal, *outcomes]), "qb")
    n = rows.count()
    ranked = row_position(rows, [], signal, tie, "_r", per_range=per_range, staged=True)
    return ranked.withColumn("bucket", F.coalesce(bucket_of_rank(F.col("_r"), F.lit(n), k), F.lit(0))).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(signal).alias("signal_mean"), *[F.avg(o).alias(f"{o}_mean") for o in outcomes])


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, *, min_names: int = 3, min_distinct: int = 2,
                     per_range: int = PER_RANGE, staged: bool = False) -> DataFrame:
    """Spearman per group over rows with both values: average ranks, then Pearson."""
    rows = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    limit = check_groups(rows, keys, per_range)
    ranked = average_ranks(rows, keys, {x: "_rx", y: "_ry"}, per_range=limit, staged=staged)
    aggs = [F.count(F.lit(1)).alias("n"), pair_corr(F.col("_rx"), F.col("_ry")).alias("ic")]
    if min_distinct > 2:
        aggs += [F.count_distinct(x).alias("_dx"), F.count_distinct(y).alias("_dy")]
    out = ranked.groupBy(*keys).agg(*aggs).where(F.col("n") >= min_names)
    if min_distinct > 2:
        out = out.where(F.least("_dx", "_dy") >= min_distinct).drop("_dx", "_dy")
    return out.drop("_all")


def daily_ic(df: DataFrame, score: str, label: str, *, min_names: int = 3, min_distinct: int = 2, per_range: int = PER_RANGE) -> DataFrame:
    """Rank correlation of score and label per date (undefined dates dropped)."""
    return rank_correlation(df, ["dt"], score, label, min_names=min_names, min_distinct=min_distinct,
                            per_range=per_range).where("ic is not null")


def mature(ic: DataFrame, label_cal: DataFrame) -> DataFrame:
    """Daily coefficients with the session at which their label is known."""
    dates = label_cal.select("signal_dt", "available_dt")
    return ic.join(F.broadcast(dates), ic["dt"] == dates["signal_dt"]).select("signal_dt", "available_dt", "n", "ic")


def pooled_ic(df: DataFrame, score: str, label: str, *, target: str | None = None, min_rows: int = 20, min_own: int = 10) -> DataFrame:
    """Pooled rank correlation, one instrument's own, and the std of monthly means."""
    pooled = rank_correlation(df, [], score, label, min_names=min_rows).select(F.col("n").alias("pooled_n"), F.col("ic").alias("pooled_ic"))
    own = rank_correlation(df.where(F.col("instrument") == target), [], score, label, min_names=min_own)
    monthly = daily_ic(df, score, label).groupBy(F.date_trunc("month", "dt").alias("m")).agg(F.avg("ic").alias("ic"))
    return pooled.withColumn("own_ic", own.select("ic").scalar()).withColumn(
        "monthly_ic_std", monthly.agg(F.stddev_samp("ic")).scalar())


def alpha_scorecard(df: DataFrame, score: str, label: str, tops: list[int], per_range: int = PER_RANGE) -> DataFrame:
    """Coefficient summary, decile means and top-k outcomes as `(metric, value)`."""
    rows = stage(df.select("dt", "instrument", score, label).dropna(), "card")
    limit = check_groups(rows, ["dt"], per_range)
    ic = daily_ic(rows, score, label, per_range=limit).agg(
        F.avg("ic").alias("ic_mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"))
    up = row_position(rows, ["dt"], score, "instrument", "_r", per_range=limit, staged=True)
    sizes = rows.groupBy("dt").agg(F.count(F.lit(1)).alias("_n"))
    up = up.join(F.broadcast(sizes), "dt").withColumn("_d", F.least(F.lit(9), F.greatest(F.lit(0), F.ceil(F.col("_r") * 10 / F.col("_n")) - 1)))
    dec = up.groupBy().agg(F.avg(F.when(F.col("_d") == 0, F.col(label))).alias("bottom_decile"),
                           F.avg(F.when(F.col("_d") == 9, F.col(label))).alias("top_decile"))
    dec = dec.withColumn("decile_spread", F.col("top_decile") - F.col("bottom_decile"))
    down = row_position(rows, ["dt"], score, "instrument", "_k", descending=True, per_range=limit, staged=True)
    per_day = down.where(F.col("_k") <= max(tops)).groupBy("dt").agg(
        *[F.avg(F.when(F.col("_k") <= k, F.col(label))).alias(f"t{k}") for k in tops])
    top = per_day.agg(*[e for k in tops for e in (
        F.avg(f"t{k}").alias(f"top{k}_mean"), F.percentile(f"t{k}", F.lit(0.5)).alias(f"top{k}_median"),
        F.avg((F.col(f"t{k}") > 0).cast("double")).alias(f"top{k}_positive"))])
    parts = [p.unpivot([], p.columns, "metric", "value") for p in (ic, dec, top)]
    return reduce(DataFrame.unionByName, parts)


def factor_segment_stats(df: DataFrame, factors: list[str], label: str, segment: str, *, min_names: int = 20,
                         per_range: int = PER_RANGE, extra: tuple[str, ...] = (), staged: bool = False) -> DataFrame:
    """Per factor, segment and extra keys: coefficient stats, pooled coefficient, moments, nulls.

    Rows are read several times, in long form that is made on reading; they are
    written first unless the caller has done so (`staged`).
    """
    base = df.select("dt", *extra, segment, label, *factors)
    long = (base if staged else stage(base, "seg")).unpivot(["dt", *extra, segment, label], factors, "factor", "value")
    keys = [*extra, "factor", segment]
    daily = rank_correlation(long, [*keys, "dt"], "value", label, min_names=min_names, per_range=per_range, staged=True).where("ic is not null")
    ic = daily.groupBy(*keys).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"))
    pooled = rank_correlation(long, keys, "value", label, min_names=20, per_range=per_range, staged=True).select(*keys, F.col("ic").alias("pooled_ic"))
    moments = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                      F.avg(F.col("value").isNull().cast("double")).alias("null_ratio"))
    out = moments.join(ic, keys, "left").join(pooled, keys, "left")
    return out.withColumn("ic_ir", F.when(F.col("ic_std") > EPS, F.col("ic_mean") / F.col("ic_std")))


def factor_stability(stats: DataFrame, segment: str, train, valid, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stability of each factor between two segments (one row per keys and factor each)."""
    a = stats.where(F.col(segment) == train).select(*keys, "factor", *[F.col(c).alias(f"t_{c}") for c in ("ic_mean", "ic_positive", "mean", "std", "null_ratio")])
    b = stats.where(F.col(segment) == valid).select(*keys, "factor", *[F.col(c).alias(f"v_{c}") for c in ("ic_mean", "mean", "null_ratio")])
    out = a.join(b, [*keys, "factor"]).withColumn("same_sign", F.signum("t_ic_mean") == F.signum("v_ic_mean"))
    stable = F.when(F.col("same_sign"), F.least(F.abs("t_ic_mean"), F.abs("v_ic_mean"))).otherwise(0.0)
    shift = ratio(F.abs(F.col("v_mean") - F.col("t_mean")), F.nullif("t_std", F.lit(0.0)))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("t_ic_positive", F.lit(0.5))))
    return out.withColumn("stable_ic", stable).withColumn("mean_shift", shift).withColumn(
        "stability", F.col("stable_ic") * F.sqrt(share) / (1.0 + F.coalesce("mean_shift", F.lit(10.0))))


def factor_correlations(df: DataFrame, factors: list[str], per_range: int = PER_RANGE, block: int = 64, by: str | None = None,
                        staged: bool = False) -> DataFrame:
    """Absolute rank correlation of every factor pair (a < b) over all rows, or over those of each `by`; null without spread.

    Ranks are made per factor in long form and meet again row by row, sorted by row
    and factor. Each task multiplies its rows into sums of products, cut into blocks
    of factors, and the blocks of all tasks are added: the plan does not grow with
    the number of factors, and a task holds one number per pair of them and value of
    `by`, which is a fold or the like. Rows are read several times (`staged`: the
    caller has written them).
    """
    n, size = len(factors), -(-len(factors) // block)
    key = F.lit(0) if by is None else F.col(by)
    base = df.select(key.cast("long").alias("_by"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in factors])
    base = base if staged else stage(base, "fc")
    each = F.posexplode(F.array(*[F.col(f) for f in factors])).alias("k", "value")
    long = base.withColumn("_row", F.monotonically_increasing_id()).select("_by", "_row", each)
    ranked = average_ranks(long, ["_by", "k"], {"value": "r"}, per_range=per_range, staged=True)
    wide = ranked.select("_by", "_row", "k", "r").repartition("_row").sortWithinPartitions("_row", "k").select("_by", "r")
    # Average ranks of all rows have the same known mean.
    middle = {r["_by"]: (r["n"] + 1) / 2.0 for r in base.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).collect()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rest = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            # A row's n ranks stand together; a batch may end within a row.
            keys, ranks = (np.concatenate([old, np.asarray(batch.column(c))]) for c, old in enumerate(rest))
            whole = len(ranks) // n * n
            rest = keys[whole:], ranks[whole:]
            own, every = keys[:whole:n], ranks[:whole].reshape(-1, n)
            for k in np.unique(own).tolist():
                x = every[own == k] - middle[k]
                total[k] = total.get(k, 0.0) + x.T @ x
        cuts = [(k, i, j, g[i * block : (i + 1) * block, j * block : (j + 1) * block].tobytes()) for k, g in total.items() for i in range(size) for j in range(i, size)]
        yield pa.RecordBatch.from_pylist([dict(zip("kijg", c, strict=True)) for c in cuts], pa.schema([("k", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("g", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"k": table["k"][:1], "i": table["i"][:1], "j": table["j"][:1], "g": [sum(np.frombuffer(g) for g in table["g"].to_pylist()).tobytes()]})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = np.frombuffer(row["g"]).reshape(min(block, n - row["i"] * block), -1)
                a, b = np.indices(g.shape).reshape(2, -1)
                columns = [pa.array([row["k"]] * g.size, pa.int64()), pa.array(a + row["i"] * block, pa.int32()), pa.array(b + row["j"] * block, pa.int32()), pa.array(g.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "a", "b", "s"])

    gram = wide.mapInArrow(products, "k long, i int, j int, g binary").groupBy("k", "i", "j").applyInArrow(add, "k long, i int, j int, g binary")
    sums = stage(gram.mapInArrow(entries, "k long, a int, b int, s double"), "gram")
    own = sums.where("a = b")
    names = F.array(*[F.lit(f) for f in factors])
    pairs = sums.where("a < b").join(own.select("k", "a", F.col("s").alias("_aa")), ["k", "a"]).join(own.select("k", "b", F.col("s").alias("_bb")), ["k", "b"])
    spread = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    corr = F.when(spread > EPS, F.least(F.lit(1.0), F.abs(F.col("s")) / spread)).alias("corr")
    return pairs.select(*([F.col("k").alias(by)] if by else []), names[F.col("a")].alias("a"), names[F.col("b")].alias("b"), corr)


def factor_whitelist(stability: DataFrame, correlations: DataFrame, *, threshold: float, min_features: int, max_features: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Chosen factors in order, for each value of the keys: `(*keys, factor, position)`.

    Factors stand in an array from the most stable one down, each with the set of
    factors it is too close to. One fold takes a factor unless its set meets the
    chosen ones or `max_features` are chosen; it goes over the sound factors, or
    over the first `min_features` of all if fewer are sound. A second fold over
    all factors fills up to `min_features`. The array has one entry per factor,
    a number fixed by the schema.
    """
    close = correlations.where(F.col("corr") > threshold)
    both = close.select(*keys, F.col("a").alias("factor"), F.col("b").alias("other")).unionByName(
        close.select(*keys, F.col("b").alias("factor"), F.col("a").alias("other")))
    barred = both.groupBy(*keys, "factor").agg(F.collect_set("other").alias("barred"))
    none = F.expr("cast(array() as array<string>)")
    shift = F.coalesce(F.nullif("mean_shift", F.lit(0.0)), F.lit(99.0))
    sound = F.coalesce(F.col("same_sign") & (F.col("stable_ic") > 0) & (shift < 3) & (F.col("t_null_ratio") < 0.25), F.lit(False))
    entry = F.struct(F.coalesce(-F.col("stability"), F.lit(float("inf"))).alias("order"), "factor", sound.alias("sound"), F.coalesce("barred", none).alias("barred"))
    ranked = stability.join(barred, [*keys, "factor"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    fit = F.filter("ranked", lambda f: f["sound"])
    walk = F.when(F.size(fit) >= min_features, fit).otherwise(F.slice("ranked", 1, min_features))

    def unlike(chosen: Column, f: Column) -> Column:
        free = (F.size(chosen) < max_features) & ~F.arrays_overlap(chosen, f["barred"])
        return F.when(free, F.concat(chosen, F.array(f["factor"]))).otherwise(chosen)

    def fill(chosen: Column, f: Column) -> Column:
        wanted = (F.size(chosen) < min_features) & ~F.array_contains(chosen, f["factor"])
        return F.when(wanted, F.concat(chosen, F.array(f["factor"]))).otherwise(chosen)

    chosen = ranked.withColumn("chosen", F.aggregate(walk, none, unlike))
    return chosen.select(*keys, F.posexplode(F.aggregate("ranked", F.col("chosen"), fill)).alias("position", "factor"))


def factor_overlap(factors: DataFrame) -> DataFrame:
    """Per fold: size, overlap with the previous fold, Jaccard, expanding common set.

    Input: fold (1..n), factor, unique.
    """
    sizes = factors.groupBy("fold").agg(F.count(F.lit(1)).alias("size"))
    prev = factors.select("factor", (F.col("fold") + 1).alias("fold"))
    shared = factors.join(prev, ["fold", "factor"]).groupBy("fold").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("factor").orderBy("fold")
    first = factors.agg(F.min("fold")).scalar()
    causal = factors.withColumn("_c", F.row_number().over(w)).where(F.col("_c") == F.col("fold") - first + 1)
    common = causal.groupBy("fold").agg(F.count(F.lit(1)).alias("common_so_far"))
    out = sizes.join(shared, "fold", "left").join(common, "fold", "left")
    before = F.lag("size").over(Window.orderBy("fold"))
    return out.withColumn("_b", before).withColumn(
        "jaccard", F.when(F.col("_b").isNotNull(), ratio(F.coalesce("shared", F.lit(0)), F.col("size") + F.col("_b") - F.coalesce("shared", F.lit(0))))
    ).withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("common_so_far", F.coalesce("common_so_far", F.lit(0))).drop("_b")


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Tie-aware rank AUC per group, null with one class only.

    Works on counts per distinct score, so it needs no row ranks and no join.
    """
    base = df.select(*keys, F.col(score).alias("_s"), F.col(label).cast("int").alias("_y")).where("_s is not null")
    counts = value_counts(stage(base, "auc"), keys, "_s", extra={"_pos": F.sum("_y")})
    pos, total = F.sum("_pos"), F.max("total")
    rank_sum = F.sum(F.col("_pos") * (F.col("below") + (F.col("n") + 1) / 2.0))
    value = (rank_sum - pos * (pos + 1) / 2.0) / F.nullif(pos * (total - pos), F.lit(0))
    return counts.groupBy(*keys).agg(value.alias("auc"))


def score_report(df: DataFrame, label: str, score: str, edge: str, cuts: list[float]) -> DataFrame:
    """One row: AUC, log loss, correlations, mass, edge and hits above cut-offs."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(score)))
    y = F.col(label).cast("double")
    loss = F.avg(-(y * F.log(p) + (1.0 - y) * F.log(1.0 - p)))
    aggs = [F.count(F.lit(1)).alias("rows"), F.avg(y).alias("positive_ratio"), F.avg(score).alias("score_mean"),
            F.stddev_samp(score).alias("score_std"), loss.alias("logloss"), pair_corr(F.col(score), y).alias("pearson")]
    for c in cuts:
        above = F.col(score) >= c
        name = f"{round(c * 100):03d}"
        aggs += [F.avg(F.coalesce(above.cast("double"), F.lit(0.0))).alias(f"mass_{name}"), F.avg(F.when(above, F.col(edge))).alias(f"edge_{name}"),
                 F.avg(F.when(above, y)).alias(f"hit_{name}")]
    out = df.agg(*aggs).withColumn("auc", auc(df, [], label, score).scalar())
    return out.withColumn("spearman", rank_correlation(df.withColumn("_y", y), [], score, "_y", min_names=2).select("ic").scalar())


def confusion_metrics(df: DataFrame, label: str, score: str, threshold: float, keys: list[str]) -> DataFrame:
    pred, y = F.col(score) >= threshold, F.col(label).cast("int") == 1
    out = df.groupBy(*keys).agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                                F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    return out.withColumn("precision", ratio(F.col("tp"), F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))).withColumn(
        "recall", ratio(F.col("tp"), F.nullif(F.col("tp") + F.col("fn"), F.lit(0))))


def banded(df: DataFrame, bands: dict[str, Column], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over overlapping bands in one pass.

    Each row is copied only to the bands it falls in; the band list is fixed.
    """
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in bands.items()]))
    return df.withColumn("band", F.explode(names)).groupBy("band").agg(*[a.alias(n) for n, a in aggs.items()])


def directional_buckets(df: DataFrame, score: str, label: str, width: float = 0.05, strong: float = 0.10) -> DataFrame:
    s = F.col(score)
    bands = {
        "strong_reverse": s <= 0.5 - strong, "reverse": s <= 0.5 - width, "neutral": (s > 0.5 - width) & (s < 0.5 + width),
        "rise": s >= 0.5 + width, "strong_rise": s >= 0.5 + strong,
    }
    total = df.agg(F.count(F.lit(1))).scalar()
    out = banded(df, bands, {
        "rows": F.count(F.lit(1)), "label_mean": F.avg(label),
        "positive_ratio": F.avg((F.col(label) > 0).cast("double")), "negative_ratio": F.avg((F.col(label) < 0).cast("double"))})
    return out.withColumn("share", F.col("rows") / total)


def threshold_grid(df: DataFrame, score: str, outcome: str, fixed: list[float], qs: list[float]) -> DataFrame:
    """Coverage and outcome statistics of fixed and quantile score cut-offs.

    The cut-offs become one array per frame; each row is copied to the gates it
    passes, so work grows with the passing rows and no cross join is planned.
    """
    rows = stage(df.select(score, outcome), "grid")
    picks = quantiles(rows.withColumn("_k", F.lit(0)), ["_k"], score, {f"q{i}": q for i, q in enumerate(qs)}, staged=True)
    gates = [F.struct(F.lit(f"fixed_{c:g}").alias("gate"), F.lit(float(c)).alias("cut")) for c in fixed]
    gates += [F.struct(F.lit(f"quantile_{q:g}").alias("gate"), F.col(f"q{i}").alias("cut")) for i, q in enumerate(qs)]
    table = picks.select(F.array(*gates)).scalar()
    total = rows.agg(F.count(F.lit(1))).scalar()
    gated = rows.withColumn("_t", table)
    passed = gated.withColumn("g", F.explode(F.filter("_t", lambda g: F.col(score) >= g["cut"]))).select("g.*", outcome)
    stats = passed.groupBy("gate", "cut").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(outcome).alias("mean"), F.avg((F.col(outcome) > 0).cast("double")).alias("hit_ratio"))
    return stats.join(quantiles(passed, ["gate"], outcome, {"q10": 0.1, "median": 0.5, "q90": 0.9}), "gate").withColumn(
        "coverage", F.col("rows") / total)


def prediction_profile(df: DataFrame, score: str, label: str, *, share: float = 0.1, min_names: int = 5, per_range: int = PER_RANGE) -> DataFrame:
    """Per date: count, moments, range, coefficient and top/bottom spread."""
    rows = stage(df.select("dt", "instrument", score, label).dropna(), "prof")
    limit = check_groups(rows, ["dt"], per_range)
    stats = rows.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
                                   F.min(score).alias("low"), F.max(score).alias("high")).where(F.col("n") >= min_names)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    pos = row_position(rows, ["dt"], score, "instrument", "_r", per_range=limit, staged=True).join(F.broadcast(stats.select("dt", "n")), "dt")
    spread = pos.groupBy("dt").agg((F.avg(F.when(F.col("_r") > F.col("n") - k, F.col(label))) - F.avg(F.when(F.col("_r") <= k, F.col(label)))).alias("spread"))
    ic = daily_ic(rows, score, label, min_names=min_names, per_range=limit).select("dt", "ic")
    return stats.join(spread, "dt").join(ic, "dt", "left")


def profile_quantiles(daily: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """Quantiles of date-level statistics (one row per date): `(field, q, value)`."""
    long = daily.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "field", "value")
    found = F.array(*[F.struct(F.lit(f"{q:g}").alias("q"), F.percentile("value", F.lit(q)).alias("value")) for q in qs])
    return long.groupBy("field").agg(found.alias("f")).select("field", F.inline("f"))


def daily_meta_frame(df: DataFrame, score: str, edge: str, top: int, per_range: int = PER_RANGE) -> DataFrame:
    """Per date: count, level, spread and shape of the scores, edge of the top names."""
    rows = stage(df.select("dt", "instrument", score, edge), "meta")
    limit = check_groups(rows, ["dt"], per_range)
    s = F.col(score)
    base = rows.groupBy("dt").agg(
        F.count(F.lit(1)).cast("double").alias("held_count"), F.max(s).alias("score_max"), F.stddev_pop(s).alias("score_std"),
        F.avg(F.coalesce((s >= 0.5).cast("double"), F.lit(0.0))).alias("share_above_half"))
    q = quantiles(rows, ["dt"], score, {"score_median": 0.5, "score_q75": 0.75, "score_q90": 0.9}, per_range=limit, staged=True)
    order = Window.partitionBy("dt").orderBy(s.desc(), "instrument")
    best = rows.where(s.isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top)
    tops = best.groupBy("dt").agg(F.avg(s).alias("top_mean"), F.max(F.when(F.col("_k") == 1, s)).alias("_1"),
                                  F.max(F.when(F.col("_k") == 2, s)).alias("_2"), F.sum(edge).alias("realized_edge"))
    out = base.join(tops, "dt").join(q, "dt")
    return out.withColumns({
        "top1_top2": F.col("_1") - F.coalesce("_2", "_1"), "top_to_median": F.col("top_mean") - F.col("score_median"),
        "positive": (F.coalesce("realized_edge", F.lit(0.0)) > 0).cast("double")}).drop("_1", "_2")


def context_aggregate(df: DataFrame, medians: list[str], sums: list[str], means: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """Per-date medians, sums, means and one std of context columns."""
    rows = stage(df.select("dt", *dict.fromkeys(medians + sums + means)), "ctx")
    limit = check_groups(rows, ["dt"], per_range)
    out = rows.groupBy("dt").agg(*[F.sum(c).alias(f"{c}_sum") for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in means],
                                 F.stddev_samp(means[-1]).alias(f"{means[-1]}_std"),
                                 *([F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in medians] if limit == FITS else []))
    for c in medians if limit != FITS else []:
        out = out.join(quantiles(rows, ["dt"], c, {f"{c}_median": 0.5}, per_range=limit, staged=True), "dt", "left")
    return out


def classification_report(df: DataFrame, label: str, probs: list[str], raw: str | None = None) -> DataFrame:
    """Multi-class log loss and macro F1; AUC for two classes; rank coefficient of
    P(last) - P(first) against the raw label, and the weighted composite."""
    eps = 1e-15
    own = F.element_at(F.array(*[F.col(p) for p in probs]), F.col(label).cast("int") + 1)
    best = F.array_position(F.array(*[F.col(p) for p in probs]), F.greatest(*[F.col(p) for p in probs])) - 1
    rows = df.withColumn("_p", best).withColumn("_y", F.col(label).cast("long"))
    loss = rows.agg(F.avg(-F.log(F.least(F.lit(1 - eps), F.greatest(F.lit(eps), own)))))
    cells = rows.groupBy("_y", "_p").agg(F.count(F.lit(1)).alias("c"))
    long = cells.select(F.explode(F.array(
        F.struct(F.col("_y").alias("k"), F.col("c").alias("t"), F.lit(0).alias("p"), F.when(F.col("_y") == F.col("_p"), F.col("c")).otherwise(0).alias("h")),
        F.struct(F.col("_p").alias("k"), F.lit(0).alias("t"), F.col("c").alias("p"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    f1 = long.groupBy("k").agg((2.0 * F.sum("h") / F.nullif(F.sum("t") + F.sum("p"), F.lit(0))).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    out = f1.withColumn("logloss", loss.scalar())
    signal = F.col(probs[-1]) - F.col(probs[0]) if len(probs) > 2 else F.col(probs[1])
    if len(probs) == 2:
        out = out.withColumn("auc", auc(df, [], label, probs[1]).scalar())
    if raw:
        ic = daily_ic(df.withColumn("_s", signal), "_s", raw, min_distinct=3)
        m = ic.agg(F.avg("ic")).scalar()
        sd = ic.agg(F.stddev_samp("ic")).scalar()
        month = ic.groupBy(F.date_trunc("month", "dt").alias("m")).agg(F.avg("ic").alias("ic")).agg(F.stddev_samp("ic")).scalar()
        out = out.withColumn("ic_mean", m).withColumn("ic_ir", ratio(m, F.nullif(sd, F.lit(0.0)))).withColumn("monthly_ic_std", month)
        score = 2.5 * F.col("ic_mean") + 0.25 * F.coalesce("ic_ir", F.lit(0.0)) - 0.3 * F.col("monthly_ic_std") + 0.2 * F.col("macro_f1") - 0.1 * F.col("logloss")
        out = out.withColumn("composite", score)
    return out
