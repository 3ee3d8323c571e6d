"""Overlapping intervals by dyadic blocks, and folds over long histories."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tapeloom.operators import asof, ordered, streamed

FIRST = dt.date(2000, 1, 1)


def day(n):
    return FIRST + dt.timedelta(days=n)


def test_blocks_make_up_exactly_the_range(spark):
    rng = random.Random(2)
    ranges = [(a, a + rng.choice([0, 1, 2, 30, 1000, 40_000])) for a in (rng.randint(0, 60_000) for _ in range(60))] + [(0, (1 << asof.LEVELS) - 1)]
    df = spark.createDataFrame(ranges, "a int, b int").withColumn("c", asof.covering_blocks(F.col("a"), F.col("b")))
    for r in df.collect():
        days = sorted(d for x in r["c"] for d in (x["block"] << x["level"], ((x["block"] + 1) << x["level"]) - 1))
        assert days[0] == r["a"] and days[-1] == r["b"] and len(r["c"]) <= 2 * asof.LEVELS
        assert all(b - a == 1 for a, b in zip(days[1::2], days[2::2], strict=False)), r


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    spans = [(k % 3, f"g{n}", day(s), None if n % 17 == 0 else day(s + rng.choice([-3, 0, 5, 40, 400]))) for n, (k, s) in enumerate((rng.randint(0, 5), rng.randint(0, 600)) for _ in range(150))]
    spans += [(0, "early", None, day(20)), (1, "same", spans[0][2], day(900))]
    rows = [(n, rng.randint(0, 3), day(rng.randint(-30, 1100))) for n in range(400)]
    got = asof.pit_group_join(spark.createDataFrame(rows, "id int, instrument int, dt date"),
                              spark.createDataFrame(spans, "instrument int, grp string, start_dt date, end_dt date"))
    for r in got.collect():
        held = [(s or dt.date(1900, 1, 1), e or dt.date(2099, 12, 31), g) for k, g, s, e in spans if k == r["instrument"]]
        held = [x for x in held if x[0] <= r["dt"] and x[0] <= x[1]]
        by_start = {}
        for s, e, g in held:
            by_start[s] = max(by_start.get(s, (e, g)), (e, g))
        live = [(s, g) for s, (e, g) in by_start.items() if e >= r["dt"]]
        assert r["grp"] == (max(live)[1] if live else asof.UNKNOWN)


def test_rows_grow_with_days_and_intervals(spark):
    """A day meets one block per level, however many intervals overlap it."""
    n = 2000
    spans = spark.range(n).select(F.lit(1).alias("instrument"), F.date_add(F.lit(FIRST), F.col("id").cast("int")).alias("_s"), F.date_add(F.lit(FIRST), 9000).alias("_e"), F.col("id").alias("_g"))
    days = spark.range(n).select(F.lit(1).alias("instrument"), F.date_add(F.lit(FIRST), (F.col("id") + 4000).cast("int")).alias("_d"))
    found = asof.latest_covering(days, spans)
    assert found.where(F.col("_og") != n - 1).count() == 0 and found.count() == n
    cut = spans.select(F.explode(asof.covering_blocks(asof._day(F.col("_s")), asof._day(F.col("_e")))))
    assert cut.count() <= 2 * (asof.LEVELS + 1) * n


def test_a_long_history_folds_in_linear_time(spark):
    def run(n):
        t = spark.range(n).select(F.lit(1).alias("symbol"), F.col("id").alias("dt"), (F.col("id") * 7919 % 500).cast("double").alias("shares"))
        start = time.perf_counter()
        rows = ordered.effective_targets(t, F.lit(100.0)).agg(F.sum("effective"), F.count("*")).first()
        return time.perf_counter() - start, rows

    run(1000)
    long, (total, n) = run(200_000)
    effective, want = 0.0, 0.0
    for i in range(200_000):
        shares = float(i * 7919 % 500)
        effective = effective if effective < shares < effective + 100 else shares
        want += effective
    assert (total, n) == (want, 200_000) and long < 60


def test_fold_replaces_columns_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7), (None, 3, 8)], "k string, o int, v int")
    out = streamed.fold_columns(df, ["k"], ["o"], ["v"], "v long, n int", lambda: (0, 0), lambda s, v: ((s[0] + v, s[1] + 1),) * 2)
    assert sorted((r["k"] or "", r["o"], r["v"], r["n"]) for r in out.collect()) == [("", 1, 7, 1), ("", 3, 15, 2), ("a", 1, 5, 1), ("a", 2, 11, 2)]
    assert streamed.fold_columns(df.where("o > 9"), ["k"], ["o"], ["v"], "n int", int, lambda s, v: (s, (s,))).count() == 0
