"""Streaming state against plain walks; model maths against NumPy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.catalog.streams import ticks
from tapeloom.models import training as ml
from tapeloom.sources.bindings import Tables
from tapeloom.streaming import jobs

ROOT = "/root/testdata/sf0.001"


def test_ledger_settles_next_session(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    flows = spark.createDataFrame([(1, days[0], 100.0, 50.0), (1, days[1], 30.0, 80.0), (1, days[2], 0.0, 100.0)], "account long, dt date, bought double, offered double")
    rows = jobs.ledger_batch(flows).orderBy("dt").collect()
    assert [(r["open_available"], r["sold"], r["refused"], r["total"]) for r in rows] == [(0.0, 0.0, 50.0, 100.0), (100.0, 80.0, 0.0, 50.0), (50.0, 50.0, 50.0, 0.0)]


def test_throttle_equals_walk(spark):
    t = Tables(spark, ROOT)
    stream = jobs.second_ticks(ticks(t))
    path = jobs.drain_to_path(stream, "seconds")
    pdf = spark.read.schema(stream.schema).parquet(path).toPandas().sort_values("ts")
    want = set()
    last = {}
    for r in pdf.itertuples():
        s = r.ts.hour * 3600 + r.ts.minute * 60 + r.ts.second
        key = (r.instrument, r.ts.date())
        if 3600 * 6 <= s <= 3600 * 20 and (key not in last or s - last[key] >= 7200):
            last[key] = s
            want.add((r.instrument, r.ts.to_pydatetime(), s >= 3600 * 19))
    # A session that is over and had nothing from 19:00 on is forced at its end.
    over = pdf["ts"].max()
    inside = pdf[[6 * 3600 <= x.hour * 3600 + x.minute * 60 + x.second <= 20 * 3600 for x in pdf["ts"]]]
    for name, day in {(r.instrument, r.ts.date()) for r in inside.itertuples()}:
        if last[name, day] < 19 * 3600 and pd.Timestamp(day) + pd.Timedelta(hours=20, seconds=1) <= over:
            want.add((name, dt.datetime.combine(day, dt.time(20)), True))
    out = jobs.drain(jobs.throttle(jobs.follow(spark, path, stream.schema), interval=7200, start=3600 * 6, end=3600 * 20, force_from=3600 * 19), "throttle")
    assert {(r["instrument"], r["ts"], r["forced"]) for r in out.collect()} == want


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + 3
    y = x @ [0.4, -0.1, 2.0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]))
    fit = ml.ridge_fit(df, ["a", "b", "c"], "y", 10.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(fit["coef"], want)
    assert fit["intercept"] == pytest.approx(y.mean())


def test_frozen_period_must_follow_calibration(spark):
    with pytest.raises(ValueError, match="does not start after"):
        ml.frozen_scoring("nowhere", spark.range(1), spark.range(1), start="2024-01-01", end="2024-02-01", calibration_end="2024-01-01")


def test_logit_gate_separates(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), float(i % 10), float(i % 10 > 5)) for i in range(120)]
    daily = spark.createDataFrame(rows, "dt date, x double, y double")
    out = ml.daily_logit_gate(daily, [{"fold": 1, "test_start": "2024-04-01", "test_end": "2024-04-29"}], ["x"], "y")
    wrong = out.where(F.col("enabled") != (F.col("y") == 1)).count()
    assert out.count() == 29 and wrong == 0
