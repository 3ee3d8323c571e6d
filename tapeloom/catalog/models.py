"""I: labels, models and user functions."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tapeloom.catalog.aggregates import CORR, FF, KW, STABLE, factor_frame, whitelist_sql
from tapeloom.catalog.base import BARS_W, PRIMARY, SESS, query, with_
from tapeloom.catalog.windows import W, _avg_rank, scored_w
from tapeloom.operators import evaluation, portfolio, rolling, sessions
from tapeloom.session import scratch_path, stage
from tapeloom.models import isotonic
from tapeloom.models import training as ml
from tapeloom.skew import quantiles


@query("I1_label_expression", "instrument:i dt:d named:f expr:f", with_(BARS_W) + f"""
SELECT instrument, dt, lead(close, 6) OVER ({W})/lead(close, 1) OVER ({W})-1 AS named, lead(close, 3) OVER ({W})/lead(close, 1) OVER ({W})-1 AS expr FROM barsw""")
def _(t):
    out = rolling.add_label(t.bars_w(), "forward_5", "named")
    return rolling.add_label(out, "try_divide(lead(close, 3) over (partition by instrument order by dt), lead(close, 1) over (partition by instrument order by dt)) - 1", "expr")


@ml.plugin("shape")
def _shape(df):
    return df.withColumn("f_range", F.col("high") / F.col("low") - 1).withColumn("f_body", F.col("close") / F.col("open") - 1)


@ml.plugin("momentum")
def _momentum(df):
    return df.withColumn("f_mom", rolling.past_return(3))


@query("I2_feature_plugin", "instrument:i dt:d f_range:f f_body:f f_mom:f", with_(BARS_W) + f"""
SELECT instrument, dt, high/low-1 AS f_range, close/open-1 AS f_body, close/lag(close, 3) OVER ({W})-1 AS f_mom FROM barsw""")
def _(t):
    return ml.apply_plugins(t.bars_w(), ["shape", "momentum"])


FEATURES = ["f_range", "f_body", "f_mom", "volume"]
FOLDS = [{"fold": 1, "train_start": "1992-01-01", "train_end": "1995-12-31", "test_start": "1996-02-01", "test_end": "1996-12-31"},
         {"fold": 2, "train_start": "1992-01-01", "train_end": "1996-12-31", "test_start": "1997-02-01", "test_end": "1997-12-31"}]
SPLIT = {"purge": 2, "valid_fraction": 0.1, "min_valid": 5, "calib_fraction": 0.15, "min_calib": 10}


def training_frame(t):
    x = ml.apply_plugins(t.bars_w(), ["shape", "momentum"]).withColumn("edge", rolling.forward_return(1)).where("edge is not null")
    x = x.withColumn("label", (F.col("edge") > 0).cast("double")).withColumn("touched", (F.col("high") >= F.col("open") * 1.5).cast("double"))
    x = x.withColumn("key", F.col("instrument") * 100_000 + F.datediff("dt", F.lit("1970-01-01").cast("date")))
    return stage(x.select("instrument", "dt", "key", *FEATURES, "edge", "label", "touched"), "train")


def wcal(t):
    return sessions.calendar(t.bars_w().select("dt"))


@query("I3_oof_train_predict", "instrument:i dt:d fold:i score:f")
def _(t):
    return ml.oof_train_predict(training_frame(t), FOLDS, FEATURES, "label", lambda y: LogisticRegression(labelCol=y, maxIter=10))


CHOICE = [{"fold": 1, "train_start": "1995-01-01", "valid_start": "1996-01-01", "train_end": "1996-12-31", "test_start": "1997-02-01", "test_end": "1997-12-31"},
          {"fold": 2, "train_start": "1995-01-01", "valid_start": "1997-01-01", "train_end": "1997-12-31", "test_start": "1998-02-01", "test_end": "1998-12-31"},
          {"fold": 3, "train_start": "1996-01-01", "valid_start": "1998-07-01", "train_end": "1998-12-31", "test_start": "1999-02-01", "test_end": "1999-12-31"}]


def _fold_choice_sql(fold):
    own = FF.replace("CASE WHEN year(dt) < 1997 THEN", f"CASE WHEN dt < DATE '{fold['valid_start']}' THEN", 1).replace(
        "WHERE label IS NOT NULL)", f"WHERE label IS NOT NULL AND dt BETWEEN DATE '{fold['train_start']}' AND DATE '{fold['train_end']}')", 1)
    parts = ", ".join([BARS_W, own, STABLE, "z0 AS (SELECT f_ret AS x, coalesce(f_vol, 0) AS y, f_range AS w FROM fx)", CORR, whitelist_sql("sb", "co", 0.9, 2, 3)])
    return f"SELECT {fold['fold']} AS fold, * FROM (WITH RECURSIVE {parts} SELECT unnest(chosen) AS factor, generate_subscripts(chosen, 1) - 1 AS position FROM pick)"


@query("I3_fold_factors", "fold:i factor:s position:i", " UNION ALL ".join(map(_fold_choice_sql, CHOICE)))
def _(t):
    return ml.fold_factors(factor_frame(t), CHOICE, ["f_ret", "f_vol", "f_range"], "label", threshold=0.9, min_features=2, max_features=3)


@query("I3_oof_selected", "instrument:i dt:d fold:i score:f")
def _(t):
    frame = training_frame(t)
    chosen = ml.fold_factors(frame, CHOICE, FEATURES, "edge", threshold=0.9, min_features=2, max_features=3)
    return ml.oof_train_predict(frame, CHOICE, FEATURES, "label", lambda y: LogisticRegression(labelCol=y, maxIter=10), chosen)


@query("I3_oof_regression", "instrument:i dt:d fold:i score:f")
def _(t):
    return ml.oof_train_predict(training_frame(t), FOLDS, FEATURES, "edge", lambda y: LinearRegression(labelCol=y, regParam=0.1))


@query("I4_boosted_ensemble", "instrument:i dt:d signal:f")
def _(t):
    frame = training_frame(t)
    models = ml.boosted_ensemble(frame.where("year(dt) < 1996"), FEATURES, "label", models=2, rounds=3, depth=2)
    return ml.ensemble_score(frame.where("year(dt) = 1996"), models, [1.0, 2.0])


# Losses after three trees, made of the bars; weights need no fitted model.
CURVE = ["abs(close-open)", "high-low", "abs(close-2*open)"]


@query("I4_sample_weights", "instrument:i dt:d weight:f", with_(BARS_W, "l AS (SELECT instrument, dt, CAST(volume > 30 AS INT) AS loss, " + ", ".join(f"{c} AS c{k}" for k, c in enumerate(CURVE)) + " FROM barsw)", f"""
r AS (SELECT *, {_avg_rank('c2', '1')}/count(*) OVER () AS b, {_avg_rank('c0', '1')}/count(*) OVER () AS a, (rank() OVER (ORDER BY -loss) + (count(*) OVER (PARTITION BY loss) - 1)/2.0)/count(*) OVER () AS h1 FROM l),
q AS (SELECT *, b/a AS t FROM r), h AS (SELECT *, h1 + {_avg_rank('t', '1')}/count(*) OVER () AS h FROM q), s AS (SELECT min(h) AS lo, (max(h)-min(h))/6 AS width FROM h),
n AS (SELECT *, greatest(0, least(5, ceil((h-lo)/width)-1)) AS bin FROM h, s)""") + "SELECT instrument, dt, 1/(0.81*avg(h) OVER (PARTITION BY bin)+0.1) AS weight FROM n")
def _(t):
    bars = t.bars_w().withColumn("key", F.struct("instrument", "dt"))
    points = [F.struct(F.lit(k).alias("tree"), F.expr(c).alias("loss")) for k, c in enumerate(CURVE)]
    curve = stage(bars.select("key", F.inline(F.array(*points))), "curve")
    losses = bars.select("key", (F.col("volume") > 30).cast("double").alias("loss"))
    out = ml.sample_weights(losses.join(ml.loss_ranks(curve, 3), "key"), k=2, decay=0.9)
    return out.select("key.instrument", "key.dt", "weight")


@query("I4_feature_choice", "model:i feature:s")
def _(t):
    models = ml.boosted_ensemble(training_frame(t).where("year(dt) < 1996"), FEATURES, "label", models=3, rounds=3, depth=2, ratios=[1.0, 0.5])
    rows = [(k, f) for k, names in enumerate(ml.model_features(models)) for f in names]
    return t.spark.createDataFrame(rows, "model int, feature string")


@query("I5_permutation_importance", "feature:s importance:f")
def _(t):
    frame = training_frame(t)
    models = ml.boosted_ensemble(frame.where("year(dt) < 1996"), FEATURES, "label", models=1, rounds=3, depth=2)
    return ml.sample_by_importance(ml.permutation_importance(frame.where("year(dt) = 1996"), models[0], FEATURES, "label"), [1.0, 1.0])


def meta(t):
    return evaluation.daily_meta_frame(scored_w(t).dropna(subset=["score", "label"]), "score", "label", 2)


META = ["score_max", "score_median", "score_std", "top1_top2"]


@query("I6_daily_ridge_gate", "dt:d fold:i gate_score:f enabled:b")
def _(t):
    return ml.daily_ridge_gate(stage(meta(t)), FOLDS, META, "realized_edge", alpha=10.0, min_dates=20)


@query("I7_daily_logit_gate", "dt:d fold:i gate_probability:f enabled:b")
def _(t):
    return ml.daily_logit_gate(stage(meta(t)), FOLDS, META, "positive")


@query("I8_isotonic_calibrate", "doc_id:i calibrated:f", """
WITH p AS (SELECT n_chars::DOUBLE AS x, sum(quality)::DOUBLE AS s, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
q AS (SELECT x, row_number() OVER (ORDER BY x) AS k, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn, s, n FROM p),
m AS (SELECT a.k AS a, b.k AS b, (b.cs-a.cs+a.s)/(b.cn-a.cn+a.n) AS mean FROM q a JOIN q b ON a.k <= b.k),
least AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m),
g AS (SELECT x, v FROM (SELECT b, max(low) AS v FROM least GROUP BY b) JOIN q ON q.k = b),
d AS (SELECT doc_id, n_chars::DOUBLE AS c FROM documents),
l AS (SELECT doc_id, c, x AS x0, v AS v0 FROM d ASOF LEFT JOIN g ON d.c >= g.x), r AS (SELECT doc_id, x AS x1, v AS v1 FROM d ASOF LEFT JOIN g ON d.c <= g.x)
SELECT doc_id, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x1 = x0 THEN v0 ELSE v0+(v1-v0)*(c-x0)/(x1-x0) END AS calibrated FROM l JOIN r USING (doc_id)""")
def _(t):
    docs = t.raw("documents").select("doc_id", "n_chars")
    blocks = isotonic.fit_blocks(docs.join(t.raw("labels"), "doc_id"), "n_chars", "quality")
    return isotonic.apply_blocks(blocks, docs, "n_chars", "calibrated")


@query("I9_two_stage_and_hurdle", "mode:s instrument:i dt:d touch_p:f conditional:f score:f")
def _(t):
    frame, cal = training_frame(t), wcal(t)
    args = {"touched": "touched", "edge": "edge", "clip": 0.5, "rounds": 2, "depth": 2, "split": SPLIT}
    hurdle = ml.two_stage_fold(frame, cal, FOLDS[0], FEATURES, mode="hurdle", **args)
    win = ml.two_stage_fold(frame, cal, FOLDS[0], FEATURES, mode="win", calibrate=True, **args)
    return hurdle.withColumn("mode", F.lit("hurdle")).unionByName(win.withColumn("mode", F.lit("win")))


@query("I10_frozen_scoring", "instrument:i dt:d raw_score:f score:f")
def _(t):
    from pyspark.ml import Pipeline

    frame = training_frame(t)
    model = Pipeline(stages=[*ml.featurizer(FEATURES), LogisticRegression(labelCol="label", maxIter=5)]).fit(frame.where("year(dt) < 1996"))
    path = scratch_path(t.spark, "model")
    model.write().save(path)
    calibration = ml.oof_train_predict(frame, FOLDS[:1], FEATURES, "label", lambda y: LogisticRegression(labelCol=y, maxIter=5)).select(F.col("score").alias("raw_score"))
    return ml.frozen_scoring(path, frame, calibration, start="1997-01-01", end="1997-12-31", calibration_end="1996-12-31")


@query("I11_parameter_search", "name:s low:f high:f", with_(BARS_W, KW) + """
SELECT 'buy' AS name, quantile_cont(score, 0.55) AS low, quantile_cont(score, 0.9) AS high FROM kw UNION ALL SELECT 'sell', quantile_cont(score, 0.1), quantile_cont(score, 0.45) FROM kw""")
def _(t):
    rows = scored_w(t).dropna(subset=["score", "label"])
    return ml.search_bounds(rows, {"buy": ("score", 0.55, 0.9), "sell": ("score", 0.1, 0.45)})


BUYS, SELLS = (0.55, 0.7, 0.9), (0.1, 0.3, 0.45)
GRID = KW + ", " + ", ".join(f"{n}(i, cut) AS (" + " UNION ALL ".join(f"SELECT {i}, quantile_cont(score, {q}) FROM kw" for i, q in enumerate(qs)) + ")" for n, qs in (("buys", BUYS), ("sells", SELLS))) + """,
sides AS (SELECT dt, b.i, b.cut, s.i AS j, s.cut AS sell, count(*) AS n, coalesce(avg(label) FILTER (WHERE score >= b.cut), 0) AS up, coalesce(avg(label) FILTER (WHERE score <= s.cut), 0) AS down,
  count(*) FILTER (WHERE score >= b.cut) + count(*) FILTER (WHERE score <= s.cut) AS held FROM kw, buys b, sells s GROUP BY ALL),
gd AS (SELECT i*3+j AS candidate, dt, year(dt) AS fold, up-down-0.002*held/n AS ret, held/n AS share FROM sides),
run AS (SELECT *, sum(ret) OVER (PARTITION BY candidate, fold ORDER BY dt) AS total FROM gd),
dd AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY candidate, fold ORDER BY dt)) - total AS down FROM run),
gm AS (SELECT candidate, fold, sum(ret) AS ret, coalesce(avg(ret)/nullif(stddev_samp(ret), 0)*sqrt(52), 0) AS sharpe, max(down) AS drawdown, avg(share) AS turnover FROM dd GROUP BY ALL)"""


def grid_folds(t):
    rows = stage(scored_w(t).dropna(subset=["score", "label"]).select("dt", "score", "label"), "grid")
    named = {f"c{k}": q for k, q in enumerate((*BUYS, *SELLS))}
    cuts = quantiles(rows.withColumn("g", F.lit(1)), ["g"], "score", named).first()
    values = [float(cuts[c]) for c in named]
    days = portfolio.grid_days(rows, "score", "label", values[: len(BUYS)], values[len(BUYS) :], cost=0.002)
    return portfolio.grid_metrics(days, F.year("dt"), year=52.0)


@query("I11_grid_folds", "candidate:i fold:i ret:f4 sharpe:f4 drawdown:f4 turnover:f", with_(BARS_W, GRID) + "SELECT * FROM gm")
def _(t):
    return grid_folds(t)


@query("I11_grid_ranking", "candidate:i score:f4 median_return:f4 worst_return:f4 dominates:b rank:i", with_(BARS_W, GRID, """
a AS (SELECT candidate, quantile_cont(ret, 0.5) AS median_return, min(ret) AS worst_return, quantile_cont(sharpe, 0.5) AS ms, quantile_cont(drawdown, 0.5) AS md, quantile_cont(turnover, 0.5) AS mt FROM gm GROUP BY 1),
b AS (SELECT *, median_return+worst_return+0.02*ms-md-0.003*mt AS score FROM a)""") + """
SELECT b.candidate, b.score, b.median_return, b.worst_return, b.median_return > z.median_return AND b.worst_return > z.worst_return AND b.md < z.md AS dominates, row_number() OVER (ORDER BY b.score DESC, b.candidate) AS rank FROM b, (SELECT * FROM b WHERE candidate = 0) z""")
def _(t):
    return portfolio.candidate_ranking(grid_folds(t), 0)


@query("I11_time_split", "dt:d role:s", with_(SESS) + """
SELECT dt, CASE WHEN session_no <= floor(n*0.6) THEN 'fit' WHEN session_no <= floor(n*(0.6+0.2)) THEN 'valid' ELSE 'test' END AS role FROM sess, (SELECT max(session_no) AS n FROM sess)""")
def _(t):
    return ml.time_split(sessions.calendar(t.dates()), 0.6, 0.2)


@query("I12_overlay_rule", "dt:d outer_median:f risk_budget:f", with_(BARS_W, "x AS (SELECT dt, close/open-1 AS o, volume FROM barsw)", "m AS (SELECT dt, quantile_cont(o, 0.5) AS outer_median FROM x WHERE volume > 30 GROUP BY 1)") + """
SELECT d.dt, outer_median, CASE WHEN outer_median >= 0.05 THEN 0.3 ELSE 0.9 END AS risk_budget FROM (SELECT DISTINCT dt FROM x) d LEFT JOIN m USING (dt)""")
def _(t):
    x = t.bars_w().select("dt", (F.col("close") / F.col("open") - 1).alias("outer"), (F.col("volume") > 30).alias("eligible"))
    return ml.overlay_rule(x, threshold=0.05, floor=0.3, base=0.9)


@query("I13_frame_shape_adapter", "mode:s rows:i weight:f", with_(BARS_W, """
j AS (SELECT b.instrument, b.dt, s_acctbal > 0 AS u, h.instrument IS NOT NULL AS d FROM barsw b JOIN supplier ON b.instrument = s_suppkey LEFT JOIN (SELECT instrument, dt FROM barsw WHERE volume > 60) h USING (instrument, dt))""") + """
SELECT 'held_weighted' AS mode, count(*) AS rows, sum(greatest(1, 1+CASE WHEN u THEN 0.5 ELSE 0 END+CASE WHEN d THEN 2 ELSE 0 END)) AS weight FROM j UNION ALL SELECT 'held_universe_only', count(*), sum(1.5) FROM j WHERE u UNION ALL SELECT 'held_only', count(*), sum(1.0) FROM j WHERE d""")
def _(t):
    universe = t.raw("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("instrument"))
    held = t.bars_w().where("volume > 60").select("instrument", "dt", F.col("volume").alias("held_shares"), F.lit(0.1).alias("held_weight"))
    frame = ml.attach_held_context(t.bars_w().select("instrument", "dt", "close"), held, universe)
    outs = [ml.context_weights(frame, m, 0.5, 2.0).agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight")).withColumn("mode", F.lit(m)) for m in ("held_weighted", "held_universe_only", "held_only")]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("I13_context_columns", "instrument:i dt:d held_date:b spread:f label:f", with_(BARS_W, PRIMARY) + """
SELECT instrument, dt, b.volume > 60 AS held_date, p.high-p.low AS spread, p.close/p.open-1 AS label FROM barsw b LEFT JOIN prim p USING (instrument, dt)""")
def _(t):
    bars = t.bars_w()
    held = bars.select("instrument", "dt", F.when(F.col("volume") > 60, F.col("volume")).alias("held_shares"), F.lit(0.1).alias("held_weight"))
    context = t.primary().select("instrument", "dt", (F.col("high") - F.col("low")).alias("spread"), F.format_string("%s", F.col("close") / F.col("open") - 1).alias("edge"))
    frame = bars.select("instrument", "dt", F.lit(9.0).alias("label"))
    return ml.attach_held_context(frame, held, bars.select("instrument"), context, context_features=("spread", "absent"), context_label="edge")


@query("I14_user_functions", "instrument:i n:i spread:f", with_(BARS_W) + "SELECT instrument, count(*) AS n, max(close)-min(close) AS spread FROM barsw GROUP BY 1")
def _(t):
    spread = F.max("close") - F.min("close")
    return t.bars_w().groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"))


@query("I15_anchored_fold_train", "mode:s instrument:i dt:d raw_score:f score:f")
def _(t):
    frame, cal = training_frame(t), wcal(t)
    outs = []
    for objective, calibration in (("regression", "isotonic"), ("ranking", "percentile"), ("classification", "percentile")):
        out = ml.anchored_fold(frame, cal, FOLDS[0], FEATURES, edge="edge", objective=objective, calibration=calibration, split=SPLIT, half_life=50, clip=0.5, rounds=2, depth=2, min_rows=20)
        outs.append(out.withColumn("mode", F.lit(objective)))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])
