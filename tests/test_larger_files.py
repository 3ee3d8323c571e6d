"""Reading and writing work that must not grow with the number of names, passes or grid cells."""

import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.functions import candles, trading
from tapeloom.operators import labels
from tapeloom.session import scratch_root
from tapeloom.sources import readers, sinks

ROOT = "/root/testdata/sf0.001"



def test_symbol_files_lie_in_few_folders(spark):
    before = set(os.listdir(scratch_root(spark)))
    assert entry.queries()["A2_read_bar_panel"](spark, ROOT).count()
    made = [n for n in set(os.listdir(scratch_root(spark))) - before if n.startswith("panel-")]
    folders = [d for d, _, _ in os.walk(f"{scratch_root(spark)}/{made[0]}")]
    assert len(folders) - 1 <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_symbols_longer_than_a_batch_keep_their_rows(spark, tmp_path):
    rows = spark.range(25_000).select((F.col("id") % 2).alias("instrument"), F.date_add(F.lit("1950-01-01").cast("date"), F.floor(F.col("id") / 2).cast("int")).alias("date"),
                                      *[(F.col("id") / 7).alias(c) for c in readers.BAR_NUMBERS])
    assert sinks.write_symbol_csv(rows, str(tmp_path / "x"), "instrument") == 2
    got = readers.read_bar_panel(spark, [str(tmp_path / "x")], "1900-01-01", "2100-01-01", r"instrument=(\d+)")
    assert got.count() == 25_000
    assert got.withColumn("instrument", F.col("instrument").cast("long")).withColumnRenamed("dt", "date").select(*rows.columns).exceptAll(rows).count() == 0


def test_instruments_rolled_together_are_as_if_alone():
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.array([40, 1, 5, 6, 4, 13])
    firsts = np.cumsum(sizes) - sizes
    bars = {c: np.round(rng.random(sizes.sum()) + 10, 2) for c in ("close", "volume", "high", "low")}
    bars["close"][7] = bars["volume"][20] = np.nan
    got = candles._rolled(bars, firsts, sizes, 5)
    for first, size in zip(firsts, sizes, strict=True):
        own = slice(first, first + size)
        alone = candles._rolled({c: x[own] for c, x in bars.items()}, np.array([0]), np.array([size]), 5)
        for o in candles.OPERATORS:
            np.testing.assert_array_equal(got[o][own], alone[o])


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_batches_are_cut_between_instruments(size):
    rows = pa.record_batch({"instrument": pa.array(["a"] * 5 + ["b"] * 3 + ["c"] * 9 + [None] * 4), "x": pa.array(range(21))})
    cuts = [(t.column("x").to_pylist(), f.tolist()) for t, f in candles._whole_instruments((rows.slice(a, size) for a in range(0, 21, size)), "instrument")]
    assert [x for xs, _ in cuts for x in xs] == list(range(21))
    assert [xs[k] for xs, firsts in cuts for k in firsts] == [0, 5, 8, 17]


def test_the_lot_of_a_held_row_is_found_once(spark):
    held = spark.createDataFrame([("688001", 1000.0, 10.0, 11.0), ("600001", 100.0, 10.0, None)], "code string, shares double, decision_price double, exit_price double")
    out = labels.execution_labels(held, {"exit": "exit_price"}, trading.BASE_COSTS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("RLIKE") == 1
    rows = {(r["code"], r["sizing"], r["direction"]): r for r in out.collect()}
    assert len(rows) == 16
    assert rows["688001", "30pct", "sell_first"]["volume"] == 200.0 and rows["688001", "10pct", "sell_first"]["volume"] == 0.0
    assert rows["600001", "10pct", "buy_first"]["pnl"] is None and not rows["600001", "one_lot", "buy_first"]["tradeable"]


@pytest.mark.parametrize("name", ["E20_normalizers", "E5_rolling_z_gap_reset"])
def test_passes_over_bars_read_them_from_a_file(spark, name):
    assert not [f for f in entry.queries()[name](spark, ROOT).inputFiles() if "lineitem" in f]


def test_bars_of_four_files_are_made_once(spark):
    before = set(os.listdir(scratch_root(spark)))
    entry.queries()["A1_read_bars"](spark, ROOT)
    assert sum(n.startswith("bars-") and not n.startswith("bars-zh") for n in set(os.listdir(scratch_root(spark))) - before) == 1


def test_stamps_of_every_shape(spark):
    texts = ["2024-01-02", "20240102", "2024/1/2", "20240102093000", "20240102 09:30:00", "2024/1/2 9:30", "2024/1/2 9:30:00", " 2024-01-02 09:30:00", "bad", "2024/13/2", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[1] for r in rows.select("k", readers.parse_stamp(F.col("t"))).orderBy("k").collect()]
    day, open_ = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 9, 30)
    assert got == [day, day, day, open_, open_, open_, open_, open_, None, None, None, None]


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    from tapeloom.catalog.base import _rounded

    values = [0.0, -0.0, 0.00000123, -0.00001, 1.00005, -2.5, 123456.7890123, 9.9e6, 1.1e7, 3.3e12, -1e300, 1e308, float("inf"), float("-inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(_rounded(F.col("v") + 1.23e-6, 4)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE + 1.230e-06::DOUBLE, 4) + 0.0", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))
