"""Nulls, constants, bad inputs, encodings and causality."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import candles, guards, symbols, trading
from tapeloom.operators import asof, blending, evaluation, folds, intraday, reconcile, rolling, sessions
from tapeloom.sources import readers, sinks


def panel(spark, n=60, names=("a", "b", "c")):
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), 10.0 + ((i * 7 + j * 3) % 11), float(100 + (i * 5 + j) % 17)) for j, s in enumerate(names) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, dt date, close double, volume double").withColumns({
        "open": F.col("close") - 0.5, "high": F.col("close") + 1, "low": F.col("close") - 1, "amount": F.col("close") * F.col("volume")})


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0), (None, 9.0)], "x double, y double")
    assert df.agg(guards.pair_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "v double")
    assert [r["v"] for r in guards.clean_columns(df, "v").collect()] == [None, None, None, 2.0]


def test_unknown_symbol_fails(spark):
    df = spark.createDataFrame([("abc",)], "s string").select(symbols.normalize_symbol(F.col("s")).alias("s"))
    with pytest.raises(Exception, match="unsupported symbol"):
        df.collect()


def test_symbol_spellings(spark):
    raw = ["600000.XSHG", "SHSE.600000", "sh600000", "SH600000", "600000", "000001"]
    df = spark.createDataFrame([(r,) for r in raw], "s string").select(symbols.normalize_symbol(F.col("s")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["sh600000"] * 5 + ["sz000001"]


def test_duplicate_keys_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        reconcile.require_unique(df, ["k"]).collect()


def test_same_day_execution_raises(spark):
    day = dt.date(2024, 1, 2)
    held = spark.createDataFrame([(day, "a", 100.0, 10.0, 0.1)], "dt date, instrument string, shares double, mark_price double, weight double")
    targets = spark.createDataFrame([], "dt date, instrument string, target_weight double, target_shares double, rank int")
    windows = spark.createDataFrame([(day, "a", 10.0, 11.0)], "dt date, instrument string, open_exec double, close_exec double")
    wrong = spark.createDataFrame([(day, day)], "dt date, next_dt date")
    with pytest.raises(Exception, match="not after the holding date"):
        reconcile.position_context(held, targets, windows, wrong, trading.BASE_COSTS).collect()


def test_overlapping_append_raises(spark):
    a = spark.createDataFrame([(dt.date(2024, 1, 5), 1)], "dt date, v int")
    b = spark.createDataFrame([(dt.date(2024, 1, 5), 2)], "dt date, v int")
    with pytest.raises(Exception, match="overlaps"):
        blending.append_strictly_later(a, b).collect()


def test_overlapping_intervals_fall_back_to_the_open_one(spark):
    iv = spark.createDataFrame([("a", "x", dt.date(2024, 1, 1), None), ("a", "y", dt.date(2024, 2, 1), dt.date(2024, 2, 10))], "instrument string, grp string, start_dt date, end_dt date")
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 5)), ("a", dt.date(2024, 2, 5)), ("a", dt.date(2024, 3, 1)), ("b", dt.date(2024, 1, 5))], "instrument string, dt date")
    got = {(r["instrument"], r["dt"].month, r["dt"].day): r["grp"] for r in asof.pit_group_join(rows, iv).collect()}
    assert got == {("a", 1, 5): "x", ("a", 2, 5): "y", ("a", 3, 1): "x", ("b", 1, 5): "__UNKNOWN__"}


def test_empty_provider_frame_keeps_the_schema(spark):
    empty = spark.createDataFrame([], "order_book_id string, date string, close double, seq long")
    out = readers.normalize_provider_bars(empty, "1d", "vendor")
    assert out.count() == 0 and {"open", "amount", "limit_up", "source", "adjust_type"} <= set(out.columns)


def test_gbk_files_are_found_and_read(spark, tmp_path):
    (tmp_path / "utf").mkdir()
    (tmp_path / "gbk").mkdir()
    text = "日期,代码,开盘,最高,最低,收盘,成交量,成交额\n2024-01-02,000001,1,2,1,oops,10,20\nbad,000001,1,2,1,2,10,20\n"
    (tmp_path / "utf" / "a.csv").write_text(text, encoding="utf-8")
    (tmp_path / "gbk" / "b.csv").write_text(text, encoding="gbk")
    assert [p.rsplit("/", 1)[1] for p in readers.gbk_files(spark, [str(tmp_path)])] == ["b.csv"]
    for folder, enc in (("utf", "UTF-8"), ("gbk", "GBK")):
        rows = readers.read_bars(spark, [str(tmp_path / folder)], encoding=enc).collect()
        assert len(rows) == 1 and rows[0]["close"] is None and rows[0]["volume"] == 10.0


def test_every_file_is_read_under_its_own_header(spark, tmp_path):
    zh = "日期,代码,开盘,收盘,最高,最低,成交量,成交额\n2024-01-02,a,1,2,3,0.5,10,20\n"
    (tmp_path / "a.csv").write_bytes(zh.encode("gbk"))
    (tmp_path / "b.csv").write_text("\ufeff" + zh.replace(",a,", ",b,").replace("2024-01-02", "2024/1/3"), encoding="utf-8")
    (tmp_path / "c d.csv").write_text("date,instrument,open,high,low,close,amount,volume,limit_up\n20240104,c,1,3,0.5,2,20,10,9\nnever,c,1,1,1,1,1,1,1\n20240105 ,c,1,3,0.5,x,20,10,\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {(r["instrument"], str(r["date"])): r for r in readers.read_bars(spark, [str(tmp_path)]).collect()}
    assert sorted(rows) == [("a", "2024-01-02"), ("b", "2024-01-03"), ("c", "2024-01-04"), ("c", "2024-01-05")]
    for key, r in rows.items():
        assert (r["open"], r["high"], r["low"], r["volume"], r["amount"]) == (1, 3, 0.5, 10, 20), key
        assert r["close"] == (None if key[1] == "2024-01-05" else 2) and r["limit_up"] == (9 if key[1] == "2024-01-04" else None)
    lost = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["dropped"], r["example"]) for r in readers.dropped_rows(spark, [str(tmp_path)]).collect()}
    assert lost == {"a.csv": (1, 0, None), "b.csv": (1, 0, None), "c%20d.csv": (3, 1, "never")}


def test_blends_need_equal_keys(spark):
    days = [(dt.date(2024, 1, d), i, float(k), 0) for k, (d, i) in enumerate([(1, "a"), (1, "b"), (2, "a")])]
    one = spark.createDataFrame(days, "dt date, instrument string, score double, fold int")
    good = {(r["dt"].day, r["instrument"]): r["score"] for r in blending.weighted_blend([one, one], [1, 1]).collect()}
    assert good == {(1, "a"): 0.0, (1, "b"): 1.0, (2, "a"): 2.0}
    for other in (one.limit(2), one.unionByName(one.limit(1)), one.withColumn("instrument", F.upper("instrument"))):
        with pytest.raises(Exception, match="not exactly once"):
            blending.weighted_blend([one, other], [1, 1]).collect()
    with pytest.raises(Exception, match="differ in fold"):
        blending.weighted_blend([one, one.withColumn("fold", F.lit(1))], [1, 1]).collect()


def test_whitelist_walks_from_the_most_stable(spark):
    rows = [("a", True, 0.5, 0.1, 0.0, 0.9), ("b", True, 0.4, 0.1, 0.0, 0.8), ("c", True, 0.3, 0.1, 0.0, 0.7), ("d", False, 0.0, 0.1, 0.0, 0.6), ("e", True, 0.2, None, 0.0, 0.5)]
    stats = spark.createDataFrame(rows, "factor string, same_sign boolean, stable_ic double, mean_shift double, t_null_ratio double, stability double")
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.2), ("b", "c", None)], "a string, b string, corr double")

    def pick(**limits):
        return [r["factor"] for r in evaluation.factor_whitelist(stats, pairs, threshold=0.9, **limits).orderBy("position").collect()]

    assert pick(min_features=1, max_features=5) == ["a", "c"]
    assert pick(min_features=3, max_features=5) == ["a", "c", "b"]
    assert pick(min_features=4, max_features=1) == ["a", "b", "c", "d"]


def test_zip_minute_bars(spark, tmp_path):
    head = "时间,代码,开盘,最高,最低,收盘,成交量,成交额\n"
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("a.csv", (head + "2024-01-02 09:31:00,sh1,1,1,1,1,10,10\n2024-01-02 09:32:00,sh1,1,1,1,2,10,10\n").encode("gbk"))
        z.writestr("b.csv", (head + "2024-01-02 09:32:00,sh1,1,1,1,3,10,10\n").encode("utf-8"))
    rows = readers.read_zip_minute_bars(spark, str(tmp_path)).orderBy("minute_of_day").collect()
    assert [(r["minute_of_day"], r["close"], r["factor"]) for r in rows] == [(571, 1.0, 1.0), (572, 3.0, 1.0)]


def test_version_is_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    sinks.write_versioned(df, str(tmp_path), "v1")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_versioned(df, str(tmp_path), "v1")


def test_shift_past_the_end(spark):
    cal = sessions.calendar(panel(spark, 5).select("dt"))
    late = spark.createDataFrame([(dt.date(2024, 1, 4),)], "dt date")
    assert sessions.shift_sessions(late, cal, 3).first()["shifted"] is None
    assert sessions.shift_sessions(late, cal, 3, past_end="keep").first()["shifted"] == dt.date(2024, 1, 4)
    with pytest.raises(Exception, match="past the last session"):
        sessions.shift_sessions(late, cal, 3, past_end="error").collect()


CUT = dt.date(2024, 2, 10)


def _unchanged(build, base, on="dt"):
    """Output at or before the cut must not depend on later rows."""
    changed = base.withColumns({c: F.when(F.col("dt") > CUT, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("close", "open", "high", "low", "volume", "amount")})
    a, b = (sorted(map(str, build(x).where(F.col(on) <= CUT).collect())) for x in (base, changed))
    assert a and a == b


def test_causality_of_windows(spark):
    base = panel(spark)
    _unchanged(lambda x: rolling.pit_eligibility(x, min_days=5, min_amount=10), base)
    daily = lambda x: x.groupBy("dt").agg(F.avg("close").alias("ret"), F.avg("volume").alias("breadth"), F.stddev("close").alias("dispersion"), F.avg("amount").alias("amount"), F.count("*").alias("n"))
    _unchanged(lambda x: rolling.regime_features(daily(x)), base)
    _unchanged(lambda x: rolling.risk_thresholds(x.withColumns({"outer": F.col("close"), "inner": F.col("volume"), "eligible": F.lit(True)}), window=10, gap_days=20, base=0.5,
                                                 slope=0.1, low=0.1, high=0.9, q_low=0.2, q_high=0.8), base)


def test_rolling_values_after_a_jump_and_with_nulls(spark):
    import numpy as np

    first = dt.date(2024, 1, 1)
    close = [10.0 + 0.01 * k for k in range(5)] + [2000.0 + 0.001 * (k % 7) for k in range(40)]
    rows = [(n, first + dt.timedelta(days=k), None if n == "holes" and k in (20, 21) else c, c, c, 5.0 + k % 3, c) for n in ("whole", "holes") for k, c in enumerate(close)]
    rows += [("flat", first + dt.timedelta(days=k), 3.0, 3.0, 3.0, 4.0, 3.0) for k in range(30)]
    df = spark.createDataFrame(rows, "instrument string, dt date, close double, high double, low double, volume double, open double")
    got = {(r["instrument"], (r["dt"] - first).days): r for r in candles.rolling_features(df, [5, 10]).collect()}
    for k in range(16, 45):
        part = np.array(close[k - 4 : k + 1])
        r = got["whole", k]
        assert r["std5"] == pytest.approx(part.std(ddof=1) / close[k], rel=1e-6)
        assert r["rsqr5"] == pytest.approx(np.corrcoef(part, np.arange(5))[0, 1] ** 2, rel=1e-4)
    known = np.array([close[18], close[19], close[22]])
    assert got["holes", 22]["ma5"] == pytest.approx(known.mean() / close[22], rel=1e-12)
    assert got["holes", 22]["qtlu5"] == pytest.approx(np.quantile(known, 0.8) / close[22], rel=1e-12)
    assert got["flat", 20]["std5"] == 0.0 and got["flat", 20]["rsqr5"] is None and got["flat", 20]["corr5"] is None
    assert got["flat", 3]["ma5"] is None and got["flat", 4]["roc5"] is None and got["flat", 5]["roc5"] == 1.0


def test_health_uses_only_available_coefficients(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    ic = spark.createDataFrame([(d, d + dt.timedelta(days=6), 0.5 if i < 20 else -9.0) for i, d in enumerate(days)], "signal_dt date, available_dt date, ic double")
    cal = spark.createDataFrame([(d,) for d in days], "dt date")
    got = {r["dt"]: r for r in folds.causal_health(ic, cal, window=20, min_obs=3, below=0.0).collect()}
    assert got[days[5]]["known"] == 0 and got[days[6]]["known"] == 1
    assert got[days[25]]["health"] == 0.5 and not got[days[25]]["trigger"]
    assert got[days[26]]["health"] < 0.5


def test_visible_features_ignore_later_bars(spark):
    rows = [("a", dt.date(2024, 1, 2), 571 + i, 10.0 + (i % 5), 100.0 + i) for i in range(60)]
    bars = spark.createDataFrame(rows, "instrument string, dt date, minute_of_day int, close double, volume double").withColumns({
        "open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "amount": F.col("close") * F.col("volume")})
    later = bars.withColumns({c: F.when(F.col("minute_of_day") > 600, F.col(c) * 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume", "amount")})
    marks = bars.select("instrument", "dt").distinct().withColumn("mark_price", F.lit(9.0))
    a, b = (intraday.visible_features(x, {"1000": 600}, marks).collect() for x in (bars, later))
    assert a == b
