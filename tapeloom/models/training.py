"""Walk-forward models on `pyspark.ml`: ensembles, gates, calibration, scoring.

Folds are a short list, so a driver loop submits one Spark fit per fold. Every
fit sees only sessions before its test range.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.trading import expected_value
from tapeloom.models import isotonic
from tapeloom.operators import evaluation
from tapeloom.operators.folds import anchored_split
from tapeloom.operators.rolling import session_decay_weights
from tapeloom.operators.scoring import percentile_score
from tapeloom.session import stage
from tapeloom.skew import average_rank, row_position

# ---------------------------------------------------------------- features


def featurizer(features: list[str]) -> list:
    """Median imputation and one feature vector."""
    filled = [f"{f}__filled" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]


def _drop_helpers(df: DataFrame) -> DataFrame:
    helpers = [c for c in df.columns if c.endswith("__filled")] + ["features", "rawPrediction", "probability", "prediction"]
    return df.drop(*helpers)


def _between(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# Feature sets and processors picked by name.
PLUGINS: dict[str, object] = {}


def plugin(name: str):
    """Register a `DataFrame -> DataFrame` feature set under a name."""

    def add(fn):
        PLUGINS[name] = fn
        return fn

    return add


def apply_plugins(df: DataFrame, names: list[str]) -> DataFrame:
    return reduce(lambda d, n: d.transform(PLUGINS[n]), names, df)


# ---------------------------------------------------------------- out-of-fold


def fold_factors(df: DataFrame, folds: list[dict], factors: list[str], label: str, *, threshold: float = 0.9, min_features: int = 20,
                 max_features: int = 80, min_names: int = 20) -> DataFrame:
    """The factors each fold may use, chosen on its own train range: `(fold, factor, position)`.

    A fold's train range is cut at its `valid_start`: a factor must keep its sign
    and level from the earlier to the later part (`factor_stability`), and is left
    out if it runs along with a more stable one over the range
    (`factor_whitelist`). Rows carry their fold, so all folds go through one set of
    jobs; test rows take no part.
    """
    ranges = F.array(*[F.struct(F.lit(int(f["fold"])).alias("fold"), *[F.lit(str(f[c])).cast("date").alias(c) for c in ("train_start", "valid_start", "train_end")]) for f in folds])
    rows = df.where(F.col(label).isNotNull()).select("dt", label, *factors, F.explode(ranges).alias("_f")).where("dt between _f.train_start and _f.train_end")
    part = F.when(F.col("dt") < F.col("_f.valid_start"), "train").otherwise("valid")
    rows = rows.select(F.col("_f.fold").alias("fold"), "dt", part.alias("_part"), label, *factors)
    rows = stage(rows, "folds")
    stats = evaluation.factor_segment_stats(rows, factors, label, "_part", min_names=min_names, extra=("fold",), staged=True)
    stability = evaluation.factor_stability(stats, "_part", "train", "valid", keys=("fold",))
    pairs = evaluation.factor_correlations(rows, factors, by="fold", staged=True).withColumn("fold", F.col("fold").cast("int"))
    return evaluation.factor_whitelist(stability, pairs, threshold=threshold, min_features=min_features, max_features=max_features, keys=("fold",))


def oof_train_predict(df: DataFrame, folds: list[dict], features: list[str], label: str, make_estimator, chosen: DataFrame | None = None) -> DataFrame:
    """Fit per fold on its train range and predict its test range.

    `chosen` (`fold_factors`) names each fold's features in order; a fold without
    any is refused. Without it every fold uses them all.
    """
    own = {int(f["fold"]): features for f in folds}
    if chosen is not None:
        picked = chosen.where(F.col("fold").isin(list(own)) & F.col("factor").isin(features)).orderBy("fold", "position").collect()
        own = {k: [r["factor"] for r in picked if r["fold"] == k] for k in own}
        if empty := [k for k, names in own.items() if not names]:
            raise ValueError(f"no factor is chosen for folds {empty}")
    parts = []
    for fold in folds:
        train = _between(df, fold["train_start"], fold["train_end"]).where(F.col(label).isNotNull())
        model = Pipeline(stages=[*featurizer(own[int(fold["fold"])]), make_estimator(label)]).fit(train)
        test = model.transform(_between(df, fold["test_start"], fold["test_end"]))
        score = vector_to_array("probability")[1] if "probability" in test.columns else F.col("prediction")
        parts.append(_drop_helpers(test.withColumn("score", score)).withColumn("fold", F.lit(int(fold["fold"]))))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- ensemble


def loss_ranks(curve: DataFrame, trees: int) -> DataFrame:
    """Mean percent rank of each row's losses over the first and the last tenth of the trees.

    Input: key, tree (from 0), loss; other trees take no part. A rank is among all
    rows of its tree. Returns key, rank_start, rank_end.
    """
    part = max(trees // 10, 1)
    first, last = F.col("tree") < part, F.col("tree") >= trees - part
    ranked = average_rank(curve.where(first | last), ["tree"], "loss", "_r", pct=True)
    return ranked.groupBy("key").agg(F.avg(F.when(first, F.col("_r"))).alias("rank_start"), F.avg(F.when(last, F.col("_r"))).alias("rank_end"))


def sample_weights(scored: DataFrame, *, k: int, decay: float, bins: int = 6, alpha: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Weights from the loss rank and the loss trend of each row.

    Input: key, loss, and the trend's rank_start and rank_end (`loss_ranks`). h
    mixes both ranks; rows share the weight of their equal-width bin,
    1 / (decay^k * mean(h) + 0.1).
    """
    rows = scored.withColumn("_neg", -F.col("loss")).withColumn("_t", F.col("rank_end") / F.col("rank_start"))
    rows = average_rank(rows, [], "_neg", "_h1", pct=True)
    rows = average_rank(rows, [], "_t", "_h2", pct=True)
    rows = stage(rows.withColumn("_h", alpha[0] * F.col("_h1") + alpha[1] * F.col("_h2")).select("key", "_h"), "sr")
    span = rows.agg(F.min("_h").alias("a"), F.max("_h").alias("b")).first()
    if span["a"] is None:
        return rows.select("key", F.lit(1.0).alias("weight"))
    width = (span["b"] - span["a"]) / bins or 1.0
    bin_no = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col("_h") - span["a"]) / width) - 1))
    rows = rows.withColumn("_b", bin_no)
    means = rows.groupBy("_b").agg((1.0 / (F.lit(decay ** k) * F.avg("_h") + 0.1)).alias("weight"))
    return rows.join(F.broadcast(means), "_b").select("key", "weight")


def _margin_loss(margin: Column, y: Column) -> Column:
    """Logistic loss of a boosted margin (labels 0/1)."""
    return F.log1p(F.exp(-2.0 * (2.0 * y - 1.0) * margin))


def loss_curve(df: DataFrame, model: PipelineModel, label: str, key: str) -> DataFrame:
    """`(key, tree, loss)` of a boosted model after each tree of its first and last tenth.

    The first trees are added up, the last ones taken off the full margin, so only
    a fifth of the trees is evaluated besides the model itself.
    """
    boosted = model.stages[-1]
    weights, trees = list(boosted.treeWeights), len(boosted.trees)
    part = max(trees // 10, 1)
    scored = model.transform(df)
    for i in {*range(part), *range(trees - part, trees)}:
        tree = boosted.trees[i]
        tree.setPredictionCol(f"_t{i}")
        scored = tree.transform(scored)
    margins, margin = {}, F.lit(0.0)
    for i in range(part):
        margin = margin + F.lit(float(weights[i])) * F.col(f"_t{i}")
        margins[i] = margin
    margin = vector_to_array("rawPrediction")[1]
    for i in reversed(range(trees - part, trees)):
        margins[i] = margin
        margin = margin - F.lit(float(weights[i])) * F.col(f"_t{i}")
    y = F.col(label).cast("double")
    points = [F.struct(F.lit(i).alias("tree"), _margin_loss(m, y).alias("loss")) for i, m in sorted(margins.items())]
    return scored.select(F.col(key).alias("key"), F.inline(F.array(*points)))


def majority_vote(df: DataFrame, models: list[PipelineModel], out: str) -> DataFrame:
    """The class most models predict; equal votes give class 0."""
    for i, model in enumerate(models):
        df = _drop_helpers(model.transform(df).withColumn(f"_v{i}", F.col("prediction")))
    votes = reduce(lambda a, b: a + b, [F.col(f"_v{i}") for i in range(len(models))])
    return df.withColumn(out, (votes * 2 > len(models)).cast("double")).drop(*[f"_v{i}" for i in range(len(models))])


def shuffled_features(df: DataFrame, features: list[str], *, key: str, seed: int) -> DataFrame:
    """Each row with `_donors`, an array of the values that a shuffle of each feature gives it.

    Every feature has a shuffle of its own: its values in the order of a seeded
    hash of (feature, key) go to the rows in key order. All features are ordered
    in one job, as narrow rows, and meet their row again by position. Keys are
    unique.
    """
    base = stage(df, "donors")
    values = F.array(*[F.col(f).cast("double") for f in features])
    melted = base.select(key, F.posexplode(values).alias("_f", "_v")).withColumn("_hash", F.xxhash64(F.lit(seed), "_f", key))
    placed = row_position(melted, ["_f"], "_hash", key, "_pos").groupBy("_pos").agg(F.array_sort(F.collect_list(F.struct("_f", "_v"))).alias("_d"))
    placed = placed.select("_pos", F.transform("_d", lambda x: x["_v"]).alias("_donors"))
    return row_position(base, [], key, key, "_pos").join(placed, "_pos").drop("_pos")


def ensemble_importance(df: DataFrame, models: list[PipelineModel], label: str, features: list[str], *, key: str = "key", seed: int = 7) -> DataFrame:
    """`(feature, importance)` of the models' majority vote: mean(change of loss) / std under a shuffle.

    The loss is 1 for a wrong class. Rows with their donors become one row per
    feature inside a task, so all features share one scoring and one aggregate.
    A feature that no model uses has importance 0.
    """
    rows = shuffled_features(majority_vote(df.select(key, label, *features), models, "_plain"), features, key=key, seed=seed)
    each = rows.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    for i, f in enumerate(features):
        each = each.withColumn(f, F.when(F.col("_f") == i, F.col("_donors")[i]).otherwise(F.col(f).cast("double")))
    y = F.col(label).cast("double")
    change = (F.col("_vote") != y).cast("double") - (F.col("_plain") != y).cast("double")
    out = majority_vote(each, models, "_vote").groupBy("_f").agg((F.avg(change) / (F.stddev_pop(change) + 1e-7)).alias("importance"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return out.select(name.alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def boosted_ensemble(train: DataFrame, features: list[str], label: str, *, models: int = 3, rounds: int = 10, depth: int = 3,
                     decay: float = 0.9, key: str = "key", ratios: list[float] | None = None, seed: int = 7) -> list[PipelineModel]:
    """K boosted models; each later one reweights rows the ensemble finds hard.

    A row's loss is that of the models' majority vote, its trend follows the last
    model's trees (`loss_ranks`). With `ratios` each later model also gets its own
    features: of every importance bin of the ensemble so far the given share is
    kept, best bin first (`sample_by_importance`).
    """
    base = stage(train, "ens")
    weights, fitted, own = None, [], features
    for k in range(models):
        rows = base.withColumn("weight", F.lit(1.0)) if weights is None else base.join(weights, key)
        gbt = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=42 + k)
        fitted.append(Pipeline(stages=[*featurizer(own), gbt]).fit(rows))
        if k + 1 == models:
            break
        trend = loss_ranks(stage(loss_curve(base, fitted[-1], label, key), "curve"), rounds)
        wrong = (F.col("_vote") != F.col(label).cast("double")).cast("double")
        losses = majority_vote(base, fitted, "_vote").select(F.col(key).alias("key"), wrong.alias("loss"))
        weights = sample_weights(losses.join(trend, "key"), k=k + 1, decay=decay)
        weights = stage(weights.withColumnRenamed("key", key), "sw")
        if ratios:
            importance = stage(ensemble_importance(base, fitted, label, features, key=key, seed=seed + k), "imp")
            own = [r["feature"] for r in sample_by_importance(importance, ratios, seed + k).orderBy("feature").collect()]
    return fitted


def model_features(models: list[PipelineModel]) -> list[list[str]]:
    """The features each model of an ensemble was fitted on."""
    return [list(m.stages[0].getInputCols()) for m in models]


def ensemble_score(df: DataFrame, models: list[PipelineModel], weights: list[float]) -> DataFrame:
    """Weighted average of P(1) over the models as `signal`."""
    out, total = df, float(sum(weights))
    for i, model in enumerate(models):
        out = _drop_helpers(model.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]))
    mix = reduce(lambda a, b: a + b, [F.col(f"_p{i}") * (w / total) for i, w in enumerate(weights)])
    return out.withColumn("signal", mix).drop(*[f"_p{i}" for i in range(len(models))])


def permutation_importance(df: DataFrame, model: PipelineModel, features: list[str], label: str, *, key: str = "key", seed: int = 7) -> DataFrame:
    """`ensemble_importance` of one model."""
    return ensemble_importance(df, [model], label, features, key=key, seed=seed)


def sample_by_importance(importance: DataFrame, ratios: list[float], seed: int = 7) -> DataFrame:
    """Keep a share of the features of each equal-width importance bin.

    There are as many bins as shares; the n-th share belongs to the n-th best bin
    that holds any feature, and is rounded up. A bin's features are drawn by a
    seeded hash. The table has one row per feature.
    """
    from pyspark.sql import Window

    bins = len(ratios)
    span = importance.select("*", F.min("importance").over(Window.partitionBy()).alias("_a"), F.max("importance").over(Window.partitionBy()).alias("_z"))
    width = F.nullif((F.col("_z") - F.col("_a")) / bins, F.lit(0.0))
    no = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col("importance") - F.col("_a")) / width) - 1)), F.lit(0))
    rows = span.withColumn("_b", F.dense_rank().over(Window.orderBy(no.desc())))
    w = Window.partitionBy("_b")
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "feature")))
    share = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.col("_b"))
    return rows.withColumn("_k", rank).withColumn("_n", F.ceil(F.count(F.lit(1)).over(w) * share)).where("_k <= _n").select("feature", "importance")


# ---------------------------------------------------------------- daily gates


def ridge_fit(df: DataFrame, features: list[str], label: str, alpha: float) -> dict:
    """Standardised ridge by its normal equations.

    Means, deviations and the k x k cross products are one Spark aggregate; only
    that small matrix is solved on the driver.
    """
    rows = df.dropna(subset=[*features, label])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("ym"), *[F.avg(f).alias(f"m_{f}") for f in features],
                     *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = [stats[f"m_{f}"] for f in features]
    scale = [stats[f"s_{f}"] or 1.0 for f in features]
    z = [(F.col(f) - m) / s for f, m, s in zip(features, mean, scale)]
    cross = rows.agg(*[F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i in range(len(z)) for j in range(i, len(z))],
                     *[F.sum(z[i] * (F.col(label) - stats["ym"])).alias(f"y{i}") for i in range(len(z))]).first()
    gram = np.array([[cross[f"x{min(i, j)}_{max(i, j)}"] for j in range(len(z))] for i in range(len(z))], dtype=float)
    coef = np.linalg.solve(gram + alpha * np.eye(len(z)), np.array([cross[f"y{i}"] for i in range(len(z))], dtype=float))
    return {"mean": mean, "scale": scale, "coef": coef.tolist(), "intercept": stats["ym"], "rows": stats["n"]}


def daily_ridge_gate(daily: DataFrame, folds: list[dict], features: list[str], label: str, *, alpha: float, min_dates: int) -> DataFrame:
    """Per fold a ridge on earlier dates; days with a predicted edge > 0 are enabled."""
    from tapeloom.functions.trading import linear_gate_score

    parts = []
    for fold in folds:
        fit = ridge_fit(daily.where(F.col("dt") < F.lit(fold["test_start"]).cast("date")), features, label, alpha)
        if fit["rows"] < min_dates:
            raise ValueError(f"fold {fold['fold']} has too few earlier dates: {fit['rows']}")
        score = linear_gate_score([F.col(f) for f in features], fit["mean"], fit["scale"], fit["coef"], fit["intercept"])
        parts.append(_between(daily, fold["test_start"], fold["test_end"]).withColumn("gate_score", score).withColumn("fold", F.lit(int(fold["fold"]))))
    return reduce(DataFrame.unionByName, parts).withColumn("enabled", F.col("gate_score") > 0)


def daily_logit_gate(daily: DataFrame, folds: list[dict], features: list[str], label: str, *, c: float = 1.0) -> DataFrame:
    """Per fold: impute, standardise, balanced logistic regression; enabled at >= 0.5."""
    parts = []
    for fold in folds:
        train = daily.where(F.col("dt") < F.lit(fold["test_start"]).cast("date"))
        filled = [f"{f}__filled" for f in features]
        imputer = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(train)
        train = imputer.transform(train)
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), *[F.avg(f).alias(f"m_{f}") for f in filled],
                          *[F.stddev_pop(f).alias(f"s_{f}") for f in filled]).first()
        if not 0 < stats["pos"] < stats["n"]:
            raise ValueError(f"fold {fold['fold']} needs both classes before its test")
        zs = {f: (F.col(f) - stats[f"m_{f}"]) / (stats[f"s_{f}"] or 1.0) for f in filled}
        pos_w, neg_w = stats["n"] / (2.0 * stats["pos"]), stats["n"] / (2.0 * (stats["n"] - stats["pos"]))
        train = train.withColumns(zs).withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.when(F.col("_y") == 1, pos_w).otherwise(neg_w))
        assembler = VectorAssembler(inputCols=filled, outputCol="features")
        model = LogisticRegression(labelCol="_y", weightCol="_w", regParam=1.0 / (c * stats["n"]), standardization=False, maxIter=100).fit(assembler.transform(train))
        test = assembler.transform(imputer.transform(_between(daily, fold["test_start"], fold["test_end"])).withColumns(zs))
        out = model.transform(test).withColumn("gate_probability", vector_to_array("probability")[1]).withColumn("fold", F.lit(int(fold["fold"])))
        parts.append(_drop_helpers(out))
    return reduce(DataFrame.unionByName, parts).withColumn("enabled", F.col("gate_probability") >= 0.5)


# ---------------------------------------------------------------- two stages


def split_roles(df: DataFrame, cal: DataFrame, test_start: str, **split) -> dict[str, DataFrame]:
    roles = anchored_split(cal, test_start, **split)
    marked = df.join(F.broadcast(roles), "dt")
    return {r: marked.where(F.col("role") == r).drop("role") for r in ("fit", "valid", "calib")}


def two_stage_fold(df: DataFrame, cal: DataFrame, fold: dict, features: list[str], *, touched: str, edge: str, clip: float, mode: str = "hurdle",
                   rounds: int = 5, depth: int = 3, split: dict, calibrate: bool = False) -> DataFrame:
    """Touch classifier on all rows, then an edge model on touched rows only.

    `hurdle`: score = P(touch) * predicted edge. `win`: the second stage predicts
    P(edge > 0) and the score uses the mean gain and loss of the fit rows.
    """
    parts = split_roles(df, cal, fold["test_start"], **split)
    stages = featurizer(features)
    fit = parts["fit"].where(F.col(touched).isNotNull())
    touch = Pipeline(stages=[*stages, GBTClassifier(labelCol=touched, maxIter=rounds, maxDepth=depth, seed=42)]).fit(fit)
    hit_rows = fit.where((F.col(touched) == 1) & F.col(edge).isNotNull())
    bounded = F.least(F.lit(clip), F.greatest(F.lit(-clip), F.col(edge)))

    def probability(frame: DataFrame, name: str, model: PipelineModel) -> DataFrame:
        return _drop_helpers(model.transform(frame).withColumn(name, vector_to_array("probability")[1]))

    test = probability(_between(df, fold["test_start"], fold["test_end"]), "touch_p", touch)
    if calibrate:
        slice_ = probability(parts["calib"], "touch_p", touch)
        test = isotonic.apply_blocks(isotonic.fit_blocks(slice_, "touch_p", touched), test, "touch_p", "touch_cal").withColumn("touch_p", F.col("touch_cal")).drop("touch_cal")
    if mode == "hurdle":
        second = Pipeline(stages=[*stages, GBTRegressor(labelCol="_edge", maxIter=rounds, maxDepth=depth, seed=43)]).fit(hit_rows.withColumn("_edge", bounded))
        test = _drop_helpers(second.transform(test).withColumn("conditional", F.col("prediction")))
    else:
        means = hit_rows.agg(F.avg(F.when(F.col(edge) > 0, F.col(edge))).alias("g"), F.avg(F.when(F.col(edge) <= 0, F.col(edge))).alias("l")).first()
        wins = hit_rows.withColumn("_win", (F.col(edge) > 0).cast("double"))
        second = Pipeline(stages=[*stages, GBTClassifier(labelCol="_win", maxIter=rounds, maxDepth=depth, seed=43)]).fit(wins)
        test = probability(test, "win_p", second)
        test = test.withColumn("conditional", expected_value(F.col("win_p"), F.lit(means["g"] or 0.0), F.lit(means["l"] or 0.0))).drop("win_p")
    return test.withColumn("score", expected_value(F.col("touch_p"), F.col("conditional"), F.lit(0.0))).withColumn("fold", F.lit(int(fold["fold"])))


def anchored_fold(df: DataFrame, cal: DataFrame, fold: dict, features: list[str], *, edge: str, objective: str, calibration: str, split: dict,
                  half_life: float = 0.0, clip: float = 0.05, rounds: int = 5, depth: int = 3, min_rows: int = 100) -> DataFrame:
    """One anchored fold: objective, session-decay weights, calibrated score.

    `objective`: regression, classification or ranking (a regressor on the
    per-date percent rank). `calibration`: isotonic or percentile.
    """
    bounded = F.least(F.lit(clip), F.greatest(F.lit(-clip), F.col(edge)))
    frame = df.where(F.col(edge).isNotNull()).withColumn("_edge", bounded)
    if objective == "ranking":
        frame = average_rank(frame, ["dt"], edge, "_target", pct=True)
    elif objective == "classification":
        frame = frame.withColumn("_target", (F.col(edge) > 0).cast("double"))
    else:
        frame = frame.withColumn("_target", F.col("_edge"))
    parts = split_roles(frame, cal, fold["test_start"], **split)
    fit = parts["fit"]
    sessions = cal.where(F.col("dt") < F.lit(fold["test_start"]).cast("date"))
    weighted = session_decay_weights(fit, sessions, half_life)
    test = _between(frame, fold["test_start"], fold["test_end"])
    sizes = {"fit": fit.count(), "calib": parts["calib"].count(), "test": test.count()}
    if min(sizes.values()) < min_rows:
        raise ValueError(f"fold {fold['fold']} has too few rows: {sizes}")
    maker = GBTClassifier if objective == "classification" else GBTRegressor
    model = Pipeline(stages=[*featurizer(features), maker(labelCol="_target", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=42)]).fit(weighted)

    def raw(rows: DataFrame) -> DataFrame:
        out = model.transform(rows)
        score = vector_to_array("probability")[1] if objective == "classification" else F.col("prediction")
        return _drop_helpers(out.withColumn("raw_score", score))

    scored, slice_ = raw(test), raw(parts["calib"])
    if calibration == "isotonic":
        out = isotonic.apply_blocks(isotonic.fit_blocks(slice_, "raw_score", "_edge", classes=False), scored, "raw_score", "score")
    else:
        out = percentile_score(scored, "raw_score", slice_, "raw_score", "score")
    return out.drop("_edge", "_target").withColumn("fold", F.lit(int(fold["fold"])))


# ---------------------------------------------------------------- frozen models


def frozen_scoring(model_path: str, df: DataFrame, calibration: DataFrame, *, start: str, end: str, calibration_end: str) -> DataFrame:
    """Score a later period with a saved model and the percentile map of the
    calibration scores (`raw_score`); the period must start after them."""
    if start <= calibration_end:
        raise ValueError(f"period {start} does not start after the calibration end {calibration_end}")
    model = PipelineModel.load(model_path)
    out = model.transform(_between(df, start, end))
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return percentile_score(_drop_helpers(out.withColumn("raw_score", score)), "raw_score", calibration, "raw_score", "score")


# ---------------------------------------------------------------- held context


def attach_held_context(features: DataFrame, held: DataFrame, universe: DataFrame, context: DataFrame | None = None, *,
                        context_features: tuple[str, ...] = (), context_label: str | None = None) -> DataFrame:
    """Feature rows with held shares and weight, membership flags and asked columns of a context table.

    `context` has one row per (instrument, dt) and is joined from the left; its
    asked columns become doubles (null where they are no numbers) and replace
    columns of the same name, those it lacks are left out. With `context_label`
    the label is that column, also where it is null.
    """
    names = universe.select("instrument").distinct().withColumn("_u", F.lit(True))
    out = features.join(names, "instrument", "left").join(held.select("instrument", "dt", "held_shares", "held_weight"), ["instrument", "dt"], "left")
    out = out.withColumn("held_universe", F.coalesce("_u", F.lit(False))).drop("_u").fillna(0.0, ["held_shares", "held_weight"])
    out = out.withColumn("held_date", F.col("held_shares") > 0)
    if context is None:
        return out
    asked = {c: c for c in context_features if c in context.columns}
    if context_label in context.columns:
        asked["label"] = context_label
    numbers = [F.col(source).cast("string").try_cast("double").alias(name) for name, source in asked.items()]
    return out.drop(*asked).join(context.select("instrument", "dt", *numbers), ["instrument", "dt"], "left")


def context_weights(df: DataFrame, mode: str, universe_bonus: float, date_bonus: float) -> DataFrame:
    """Sample weight max(1, 1 + bonuses) and the row filter of a mode."""
    bonus = F.lit(1.0)
    if mode in ("held_weighted", "held_universe_only"):
        bonus = bonus + F.when(F.col("held_universe"), universe_bonus).otherwise(0.0)
    if mode == "held_weighted":
        bonus = bonus + F.when(F.col("held_date"), date_bonus).otherwise(0.0)
    out = df.withColumn("weight", F.greatest(F.lit(1.0), bonus))
    if mode == "held_universe_only":
        return out.where("held_universe")
    return out.where("held_date") if mode == "held_only" else out


def overlay_rule(scores: DataFrame, *, threshold: float, floor: float, base: float) -> DataFrame:
    """Risk budget per date from the median score of eligible names."""
    from tapeloom.skew import quantiles

    med = quantiles(scores.where("eligible"), ["dt"], "outer", {"outer_median": 0.5})
    days = scores.select("dt").distinct().join(med, "dt", "left")
    return days.withColumn("risk_budget", F.when(F.col("outer_median") >= threshold, floor).otherwise(base))


def search_bounds(df: DataFrame, columns: dict[str, tuple[str, float, float]], eps: float = 1e-4) -> DataFrame:
    """Search bounds of named parameters from score quantiles: `(name, low, high)`."""
    from tapeloom.skew import quantiles

    parts = []
    for name, (column, lo, hi) in columns.items():
        q = quantiles(df.select(F.lit(name).alias("name"), F.col(column).alias("_v")), ["name"], "_v", {"low": lo, "high": hi})
        mid = (F.col("low") + F.col("high")) / 2
        tight = F.col("high") - F.col("low") < eps
        parts.append(q.select("name", F.when(tight, mid - eps).otherwise(F.col("low")).alias("low"), F.when(tight, mid + eps).otherwise(F.col("high")).alias("high")))
    return reduce(DataFrame.unionByName, parts)


def time_split(cal: DataFrame, fit_share: float, valid_share: float) -> DataFrame:
    """Sessions split in time order into fit, valid and test."""
    total = cal.agg(F.count(F.lit(1))).scalar()
    cut1 = F.greatest(F.lit(2), F.floor(total * fit_share))
    cut2 = F.greatest(cut1 + 1, F.floor(total * (fit_share + valid_share)))
    return cal.withColumn("role", F.when(F.col("session_no") <= cut1, "fit").when(F.col("session_no") <= cut2, "valid").otherwise("test"))
