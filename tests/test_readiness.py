"""Coverage ranges, value profiles and direction agreement against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import reconcile

DAY = dt.date(2024, 1, 1)


def test_pool_ranges_ignore_names_without_values(spark):
    rows = [(1, DAY, 1.0), (1, DAY + dt.timedelta(3), 2.0), (2, DAY + dt.timedelta(1), 1.0), (3, DAY, None)]
    df = spark.createDataFrame(rows, "instrument int, dt date, close double")
    r = reconcile.pool_coverage(reconcile.coverage(df, ["close"])).collect()[0]
    assert (r["instruments"], r["with_values"]) == (3, 2)
    assert [r[c] for c in ("earliest_first_dt", "latest_first_dt", "earliest_last_dt", "latest_last_dt")] == [DAY + dt.timedelta(k) for k in (0, 1, 1, 3)]


def test_profile_of_finite_values(spark):
    values = np.array([0.5, -1.0, 3.0, np.inf, np.nan, -np.inf, 0.0, 2.5])
    df = spark.createDataFrame([(float(v), None) for v in values] + [(None, None)], "a double, b double")
    got = {r["field"]: r for r in reconcile.value_profile(df, ["a", "b"]).collect()}
    x = pd.Series(values[np.isfinite(values)])
    want = [len(x), x.mean(), x.median(), x.std(), (x > 0).mean(), *x.quantile([0.05, 0.25, 0.75, 0.95])]
    assert [got["a"][c] for c in ("n", "mean", "median", "std", "positive_ratio", "q05", "q25", "q75", "q95")] == pytest.approx(want)
    assert got["b"]["n"] == 0 and got["b"]["mean"] is None


def test_direction_agreement(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 0.0), (1.0, -1.0), (None, 1.0)], "a double, b double")
    r = reconcile.direction_agreement(df, [("a", "b")]).collect()[0]
    assert r["rows"] == 3 and r["agreement"] == pytest.approx(2 / 3)
    assert reconcile.direction_agreement(df.where("a > 5"), [("a", "b")]).collect()[0]["agreement"] is None
