"""The scored grid of cuts against a plain walk."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import portfolio

DAY = dt.date(2024, 1, 1)


def test_grid_equals_a_walk_over_days(spark):
    rng = np.random.default_rng(2)
    rows = [(DAY + dt.timedelta(days=d), float(rng.normal()), float(rng.normal(scale=0.05))) for d in range(40) for _ in range(8)]
    rows += [(DAY, None, 1.0), (DAY, 1.0, None)]
    pdf = pd.DataFrame(rows, columns=["dt", "score", "label"])
    df = spark.createDataFrame(rows, "dt date, score double, label double")
    buys, sells, cost = [0.0, 9.0], [-0.5, 0.1], 0.01
    out = portfolio.grid_metrics(portfolio.grid_days(df, "score", "label", buys, sells, cost), F.when(F.col("dt") > DAY, F.dayofyear("dt") % 2), year=100.0)
    got = {(r["candidate"], r["fold"]): (r["ret"], r["sharpe"], r["drawdown"], r["turnover"]) for r in out.collect()}
    assert len(got) == 8
    for k, (b, s) in enumerate((b, s) for b in buys for s in sells):
        for fold in (0, 1):
            rets, shares, total, peak, down = [], [], 0.0, 0.0, 0.0
            for day, x in pdf.dropna().groupby("dt"):
                if day == DAY or day.timetuple().tm_yday % 2 != fold:
                    continue
                up, low = x[x.score >= b], x[x.score <= s]
                shares.append((len(up) + len(low)) / len(x))
                rets.append((up.label.mean() if len(up) else 0) - (low.label.mean() if len(low) else 0) - cost * shares[-1])
                total += rets[-1]
                peak = max(peak, total)
                down = max(down, peak - total)
            want = (total, np.mean(rets) / np.std(rets, ddof=1) * 10, down, np.mean(shares))
            assert got[k, fold] == pytest.approx(want)


def test_one_day_a_flat_candidate_and_no_rows(spark):
    df = spark.createDataFrame([(DAY, 0.5, -0.2)], "dt date, score double, label double")
    out = portfolio.grid_metrics(portfolio.grid_days(df, "score", "label", [0.0, 1.0], [0.0]), F.lit(1))
    assert sorted((r["candidate"], r["ret"], r["sharpe"], r["drawdown"]) for r in out.collect()) == [(0, -0.2, 0.0, 0.2), (1, 0.0, 0.0, 0.0)]
    assert portfolio.grid_days(df.where("score > 1"), "score", "label", [0.0], [0.0]).count() == 0
