"""Groups cut into many ranges (a small `per_range`) against pandas, with hot keys,
hot values, nulls and ties."""

import numpy as np
import pandas as pd
import pytest

from tapeloom import skew
from tapeloom.operators import cross_section, evaluation, selection


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    value = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(0, 50, n), 1))
    pdf = pd.DataFrame({"k": key, "v": value, "id": rng.permutation(n)})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def sdf(spark, frame):
    from pyspark.sql import functions as F

    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("limit", [40, 10**9])
@pytest.mark.parametrize("keys", [["k"], []])
def test_average_rank(sdf, frame, limit, keys):
    got = skew.average_rank(sdf, keys, "v", "r", per_range=limit).toPandas().set_index("id")["r"].sort_index()
    ranks = frame.groupby("k")["v"].rank() if keys else frame["v"].rank()
    want = pd.Series(ranks.to_numpy(), index=frame["id"]).sort_index()
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("limit", [40, 10**9])
@pytest.mark.parametrize("descending", [False, True])
def test_row_position(sdf, frame, limit, descending):
    got = skew.row_position(sdf, ["k"], "v", "id", "p", descending=descending, per_range=limit).toPandas().set_index("id")["p"]
    rows = frame.dropna().sort_values(["k", "v", "id"], ascending=[True, not descending, True])
    want = (rows.groupby("k").cumcount() + 1).set_axis(rows["id"])
    assert got.sort_index().tolist() == want.sort_index().tolist()


@pytest.mark.parametrize("limit", [40, 10**9])
def test_quantiles(sdf, frame, limit):
    got = skew.quantiles(sdf, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.97}, per_range=limit).toPandas().set_index("k").sort_index()
    want = frame.groupby("k")["v"].quantile([0.1, 0.5, 0.97]).unstack().sort_index()
    np.testing.assert_allclose(got[["a", "m", "z"]].to_numpy(), want.to_numpy())


def test_spread_equals_window_in_operators(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"dt": pd.to_datetime("2024-01-01").date(), "instrument": range(400), "score": rng.normal(size=400).round(1), "label": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    a, b = (evaluation.daily_ic(df, "score", "label", per_range=g).first()["ic"] for g in (9, 10**9))
    assert a == pytest.approx(b) and a == pytest.approx(pdf["score"].rank().corr(pdf["label"].rank()))
    x, y = (cross_section.rank_pct(df, ["dt"], "score", "instrument", per_range=g).orderBy("instrument").select("rank_pct", "rank_min_desc", "rank_first").collect() for g in (9, 10**9))
    assert x == y
    p, q = (sorted(r["instrument"] for r in selection.prefix_until_share(df.withColumn("w", df.score + 10), ["dt"], "w", "instrument", 0.3, per_range=g).collect()) for g in (9, 10**9))
    assert p == q


def test_auc_matches_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4), (1, 0.7)]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z]
    got = evaluation.auc(spark.createDataFrame(rows, "y int, s double"), [], "y", "s").first()["auc"]
    assert got == pytest.approx(sum(pairs) / len(pairs))
    one = evaluation.auc(spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double"), [], "y", "s").first()["auc"]
    assert one is None


@pytest.mark.parametrize("limit", [11, 10**9])
@pytest.mark.parametrize("descending", [False, True])
def test_text_ties_and_wide_integers(spark, limit, descending):
    rng = np.random.default_rng(9)
    ids = [f"sh{600000 + k}" for k in range(700)] + [f"é{k}" for k in range(40)]
    value = [2**53 + int(x) for x in rng.integers(0, 300, len(ids))]
    value[:200] = [2**60] * 200  # one hot value, to be cut by the tie
    order = rng.permutation(len(ids))
    df = spark.createDataFrame([(ids[k], value[k], "x") for k in order] + [("none", None, "x"), (None, 2**60, "x")], "id string, v bigint, k string")
    got = {r["id"]: r["p"] for r in skew.row_position(df, ["k"], "v", "id", "p", descending=descending, per_range=limit).collect()}
    sign = -1 if descending else 1
    rows = sorted([*zip(value, ids, strict=True), (2**60, None)], key=lambda r: (sign * r[0], r[1] is not None, (r[1] or "").encode()))
    assert got == {name: k + 1 for k, (_, name) in enumerate(rows)}
    ranks = {r["id"]: r["r"] for r in skew.average_rank(df, ["k"], "v", "r", per_range=limit).collect()}
    series = pd.Series([*value, 2**60], index=[*ids, None]).rank()
    assert ranks.pop("none") is None and ranks == dict(series.items())


@pytest.mark.parametrize("name", ["alpha_scorecard", "prediction_profile", "rank_pct"])
def test_operators_with_text_ids_in_many_ranges(spark, name):
    import datetime as dt

    rng = np.random.default_rng(2)
    rows = [(dt.date(2024, 1, 1 + d), f"sh{600000 + k}", float(rng.integers(0, 30)), float(rng.normal())) for d in range(2) for k in range(150)]
    df = spark.createDataFrame(rows, "dt date, instrument string, score double, label double")
    calls = {
        "alpha_scorecard": lambda g: evaluation.alpha_scorecard(df, "score", "label", [5, 20], per_range=g),
        "prediction_profile": lambda g: evaluation.prediction_profile(df, "score", "label", per_range=g),
        "rank_pct": lambda g: cross_section.rank_pct(df, ["dt"], "score", "instrument", per_range=g),
    }
    one, many = (sorted(([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r] for r in calls[name](g).collect()), key=str) for g in (10**9, 7))
    assert one == many


def test_a_shared_folder_is_needed_beyond_local_mode(spark):
    from tapeloom.session import scratch_root

    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, key, default=None):
            return self.known.get(key.replace(".", "_"), default)

    class Session:
        conf = Conf(spark_master="spark://host:7077")

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())
    Session.conf = Conf(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://shared/x/")
    assert scratch_root(Session()) == "hdfs://shared/x"
