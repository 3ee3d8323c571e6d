"""Weights, shuffles and kept features of an ensemble against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.models import training as ml

TREES = 30


def labelled(spark, n=600, seed=0):
    """a decides the label, b decides a fifth of it, c and d are noise; some values are missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] > 0) ^ ((x[:, 1] > 1.2) & (rng.random(n) < 0.9))).astype(float)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(key=range(n), y=y)
    return pdf, spark.createDataFrame(pdf).withColumn("d", F.when(F.col("key") % 17 != 0, F.col("d")))


def test_weights_follow_loss_and_mean_ranks_of_the_curve(spark):
    rng = np.random.default_rng(1)
    curve = pd.DataFrame(rng.integers(0, 40, size=(300, TREES)) / 7.0)
    loss = pd.Series(rng.integers(0, 2, 300).astype(float))
    points = curve.stack().rename_axis(["key", "tree"]).rename("loss").reset_index()
    trend = ml.loss_ranks(spark.createDataFrame(points), TREES)
    rows = spark.createDataFrame(pd.DataFrame({"key": range(300), "loss": loss})).join(trend, "key")
    got = ml.sample_weights(rows, k=2, decay=0.8).toPandas().set_index("key")["weight"].sort_index()
    ranks = curve.rank(pct=True)
    h = (-loss).rank(pct=True) + (ranks.iloc[:, -3:].mean(axis=1) / ranks.iloc[:, :3].mean(axis=1)).rank(pct=True)
    b = np.clip(np.ceil((h - h.min()) / ((h.max() - h.min()) / 6)) - 1, 0, 5)
    np.testing.assert_allclose(got.to_numpy(), (1.0 / (0.8 ** 2 * h.groupby(b).transform("mean") + 0.1)).to_numpy())


def test_weights_of_equal_and_of_no_rows(spark):
    same = spark.createDataFrame([(k, 0.0, 0.5, 0.5) for k in range(4)], "key int, loss double, rank_start double, rank_end double")
    assert len({r["weight"] for r in ml.sample_weights(same, k=1, decay=0.9).collect()}) == 1
    assert ml.sample_weights(same.where("key < 0"), k=1, decay=0.9).count() == 0


def test_loss_curve_equals_adding_tree_by_tree(spark):
    pdf, df = labelled(spark, 200)
    model = ml.boosted_ensemble(df, list("abcd"), "y", models=1, rounds=12, depth=2)[0]
    got = ml.loss_curve(df, model, "y", "key").toPandas().pivot(index="key", columns="tree", values="loss")
    assert list(got.columns) == [0, 11]
    boosted, rows, margin = model.stages[-1], df, np.zeros(len(pdf))
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    vectors = [r["features"] for r in rows.orderBy("key").collect()]
    for t, (tree, weight) in enumerate(zip(boosted.trees, boosted.treeWeights, strict=True)):
        margin += weight * np.array([tree.predict(v) for v in vectors])
        if t in got.columns:
            np.testing.assert_allclose(got[t].to_numpy(), np.log1p(np.exp(-2 * (2 * pdf["y"] - 1) * margin)))


def test_each_feature_is_a_shuffle_of_its_own(spark):
    pdf, df = labelled(spark, 300)
    out = ml.shuffled_features(df, list("abcd"), key="key", seed=3).toPandas().sort_values("key")
    donors = np.array(out["_donors"].tolist(), dtype=float)
    orders = []
    for k, name in enumerate("abc"):
        assert sorted(donors[:, k]) == sorted(pdf[name])
        orders.append(tuple(np.argsort(donors[:, k]).argsort()[np.argsort(pdf[name].to_numpy())]))
    assert len(set(orders)) == 3
    assert np.isnan(donors[:, 3]).sum() == len([k for k in range(300) if k % 17 == 0])


def test_importance_equals_scoring_each_shuffled_column(spark):
    pdf, df = labelled(spark)
    models = ml.boosted_ensemble(df, list("abcd"), "y", models=3, rounds=4, depth=2)
    got = {r["feature"]: r["importance"] for r in ml.ensemble_importance(df, models, "y", list("abcd"), seed=5).collect()}
    donors = ml.shuffled_features(df, list("abcd"), key="key", seed=5).toPandas().set_index("key").sort_index()
    columns = np.array(donors["_donors"].tolist(), dtype=float)

    def losses(frame):
        votes = np.zeros(len(pdf))
        for m in models:
            votes += m.transform(frame).select("key", "prediction").toPandas().set_index("key").sort_index()["prediction"].to_numpy()
        return ((votes > 1.5) != pdf["y"]).astype(float).to_numpy()

    plain = losses(df)
    for k, name in enumerate("abcd"):
        own = spark.createDataFrame(pd.DataFrame({"key": range(len(pdf)), "_n": columns[:, k]})).withColumn("_n", F.when(~F.isnan("_n"), F.col("_n")))
        d = losses(df.drop(name).join(own.withColumnRenamed("_n", name), "key")) - plain
        assert got[name] == pytest.approx(d.mean() / (d.std() + 1e-7), abs=1e-6)
    assert max(got, key=got.get) == "a"


@pytest.mark.parametrize("ratios", [[1.0, 0.5, 0.2], [0.5, 0.0, 1.0], [1.0]])
def test_kept_features_by_bins(spark, ratios):
    """Bins are of equal width, closed at the right; shares go to bins with features, best first."""
    values = {f"f{k}": v for k, v in enumerate([0.0, 0.05, 0.1, 0.2, 0.9, 0.95, 1.0])}
    table = spark.createDataFrame(list(values.items()), "feature string, importance double")
    kept = {r["feature"] for r in ml.sample_by_importance(table, ratios).collect()}
    cuts = np.linspace(0, 1, len(ratios) + 1)
    bins = {f: max(1, int(np.searchsorted(cuts, v, "left"))) for f, v in values.items()}
    for share, b in zip(ratios, sorted(set(bins.values()), reverse=True)):
        members = [f for f in values if bins[f] == b]
        assert len(kept & set(members)) == int(np.ceil(share * len(members)))


def test_equal_importance_is_one_bin_and_later_models_get_their_features(spark):
    table = spark.createDataFrame([(f, 0.5) for f in "abcd"], "feature string, importance double")
    assert ml.sample_by_importance(table, [0.5, 0.0]).count() == 2
    pdf, df = labelled(spark)
    models = ml.boosted_ensemble(df, list("abcd"), "y", models=2, rounds=3, depth=2, ratios=[1.0, 0.0])
    first, second = ml.model_features(models)
    assert first == list("abcd") and second == ["a"]


def test_context_replaces_the_label_and_adds_numbers(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 0.5), (1, "2024-01-02", 0.6)], "instrument long, dt string, label double")
    held = spark.createDataFrame([(1, "2024-01-01", 100.0, 0.2)], "instrument long, dt string, held_shares double, held_weight double")
    context = spark.createDataFrame([(1, "2024-01-01", "1.5", "x", "7")], "instrument long, dt string, f string, g string, edge string")
    out = ml.attach_held_context(rows, held, rows.select("instrument"), context, context_features=("f", "g", "none"), context_label="edge")
    got = {r["dt"]: (r["f"], r["g"], r["label"], r["held_date"]) for r in out.collect()}
    assert got == {"2024-01-01": (1.5, None, 7.0, True), "2024-01-02": (None, None, None, False)}
    assert "none" not in out.columns
    assert ml.attach_held_context(rows, held, rows.select("instrument"), context, context_label="none").where("label is null").count() == 0
