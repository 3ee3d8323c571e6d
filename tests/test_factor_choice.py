"""Factor choice: wide correlations, and what a fold may see."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tapeloom.models import training as ml
from tapeloom.operators import evaluation

FIRST = dt.date(2024, 1, 1)


def panel(spark, days=60, names=25, seed=0):
    """f0 leads the label, f1 is f0 again, f2 turns round half way, f3 leads it weakly, f4 is noise."""
    rng = np.random.default_rng(seed)
    out = []
    for d in range(days):
        label, noise = rng.normal(size=names), rng.normal(size=(5, names))
        f0 = label + 0.5 * noise[0]
        columns = [f0, f0 * 3 + 1e-3 * noise[1], label * (1 if d < days // 2 else -1) + 0.3 * noise[2], label + 3 * noise[3], noise[4]]
        out += [(n, FIRST + dt.timedelta(days=d), float(label[n]), *(float(c[n]) for c in columns)) for n in range(names)]
    return spark.createDataFrame(pd.DataFrame(out, columns=["instrument", "dt", "label", *(f"f{k}" for k in range(5))])).withColumn("dt", F.col("dt").cast("date"))


def test_many_factors_against_pandas(spark):
    rng = np.random.default_rng(1)
    n = 240
    x = rng.integers(0, 30, size=(80, n)).astype(float)
    x[:, 7] = 5.0
    x[:, 9] = -x[:, 8]
    names = [f"g{k:03d}" for k in range(n)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).withColumn("fold", (F.col("g000") > 14).cast("int"))
    want = pd.DataFrame(x, columns=names).corr(method="spearman").abs()
    got = evaluation.factor_correlations(df, names).toPandas()
    assert len(got) == n * (n - 1) // 2 and (got["a"] < got["b"]).all()
    wrong = [(r.a, r.b) for r in got.itertuples() if not (np.isclose(r.corr, want.loc[r.a, r.b]) or (pd.isna(r.corr) and "g007" in (r.a, r.b)))]
    assert not wrong
    keyed = evaluation.factor_correlations(df, names[:5], by="fold", block=2).toPandas()
    for fold, part in df.select("fold", *names[:5]).toPandas().groupby("fold"):
        own = part[names[:5]].corr(method="spearman").abs()
        rows = keyed[keyed["fold"] == fold]
        assert len(rows) == 10 and all(np.isclose(r.corr, own.loc[r.a, r.b]) for r in rows.itertuples())


def test_a_fold_sees_its_train_range_only(spark):
    df = panel(spark)
    day = lambda n: str(FIRST + dt.timedelta(days=n))
    folds = [{"fold": 1, "train_start": day(0), "valid_start": day(20), "train_end": day(29)}, {"fold": 2, "train_start": day(0), "valid_start": day(30), "train_end": day(59)}]
    chosen = ml.fold_factors(df, folds, [f"f{k}" for k in range(5)], "label", min_features=2, max_features=3)
    by_fold = {k: [r["factor"] for r in chosen.where(F.col("fold") == k).orderBy("position").collect()] for k in (1, 2)}
    assert "f2" in by_fold[1] and "f2" not in by_fold[2]
    assert all(len({"f0", "f1"} & {*names}) == 1 for names in by_fold.values())
    # Rows behind a fold's train range may be anything.
    other = df.withColumns({f"f{k}": F.when(F.col("dt") > F.lit(day(29)).cast("date"), F.rand(3)).otherwise(F.col(f"f{k}")) for k in range(5)})
    again = ml.fold_factors(other, folds[:1], [f"f{k}" for k in range(5)], "label", min_features=2, max_features=3)
    assert [r["factor"] for r in again.orderBy("position").collect()] == by_fold[1]


def test_each_fold_is_fitted_on_its_own_factors(spark):
    df = panel(spark)
    folds = [{"fold": 1, "train_start": "2024-01-01", "train_end": "2024-01-30", "test_start": "2024-02-01", "test_end": "2024-02-10"}]
    names = [f"f{k}" for k in range(5)]
    fit = lambda y: LinearRegression(labelCol=y)
    picked = spark.createDataFrame([(1, "f3", 0), (1, "f4", 1), (9, "f0", 0)], "fold int, factor string, position int")
    key = ["instrument", "dt"]
    got = ml.oof_train_predict(df, folds, names, "label", fit, picked).orderBy(*key).toPandas()["score"]
    want = ml.oof_train_predict(df, folds, ["f3", "f4"], "label", fit).orderBy(*key).toPandas()["score"]
    np.testing.assert_allclose(got, want)
    with pytest.raises(ValueError, match="no factor"):
        ml.oof_train_predict(df, folds, names, "label", fit, picked.where("fold = 9"))
