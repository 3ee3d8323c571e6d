"""Faults that the small tables do not show: many tasks, borders, empty sides."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom import skew
from tapeloom.models import isotonic


@pytest.fixture
def apart(spark):
    """A session that leaves every shuffle partition to a task of its own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def both(spark, name, **tables):
    """The rows of a query and of its SQL, over tables given as paths."""
    root = next(iter(tables.values())).rsplit("/", 1)[0]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = entry.queries()[name](spark, root)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_every_lane_of_scores_meets_its_blocks(apart):
    blocks = apart.createDataFrame([(0.0, 1.0, 0.25, 4.0), (2.0, 3.0, 0.5, 4.0)], "first double, last double, value double, n double")
    rows = apart.range(0, 1000, 1, 4).select("id", (F.col("id") % 4).cast("double").alias("s"))
    got = isotonic.apply_blocks(blocks, rows, "s", "p")
    assert {(r["s"], r["p"]): r["count"] for r in got.groupBy("s", "p").count().collect()} == {(0.0, 0.25): 250, (1.0, 0.25): 250, (2.0, 0.5): 250, (3.0, 0.5): 250}


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_a_tick_at_its_limit_passes_the_gate(spark, tmp_path):
    ticks = [(50.15, 2), (50.16, 2), (50.15, 3), (49.85, 3), (49.84, 3), (49.85, 2)]
    rows = [(k, dt.datetime(2024, 1, 2, 10), user, "click", value, "") for k, (value, user) in enumerate(ticks)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
    got, want = both(spark, "B31_tick_price_gate", events=path)
    assert got == want and len(got) == 6


def test_minutes_without_a_price_count_for_no_volume(spark, tmp_path):
    ticks = [("view", 9, 2.0, 100), ("view", 10, 3.0, 50), ("view", 11, 0.0, 70), ("view", 12, -0.0, 7), ("click", 9, 0.0, 5), ("error", 9, 1e6, 0)]
    rows = [(k, dt.datetime(2024, 1, 2, hour), user, kind, value, "") for k, (kind, hour, value, user) in enumerate(ticks)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
    got, want = both(spark, "B9_volume_unit_normalize", events=path)
    assert got == want and len(got) == 1


def test_a_choice_that_accepts_nothing_has_no_row(spark, tmp_path):
    # The five largest trades of the day all cost more than the budget; only a small one gains.
    lines = [(k, 1, k, 1, 1.0, 200_000.0 + k, 0.04) for k in range(5)] + [(5, 1, 5, 1, 1.0, 30_000.0, 0.07)]
    rows = [(*line, 0.0, "N", "O", dt.datetime(1996, 1, 2)) for line in lines]
    fields = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(path)
    got, want = both(spark, "D42_opportunity_ceiling", lineitem=path)
    assert got == want and len(got) == 1


def test_copies_of_one_value_are_ranked_by_many_tasks(apart, monkeypatch):
    """Two values and nulls over 60,000 rows: no task of the join back holds most of one value."""
    monkeypatch.setattr(skew, "COMMON", 2_000)
    apart.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = apart.range(0, 60_000, 1, 4).select("id", F.when(F.col("id") % 3 < 2, F.when(F.col("id") % 3 == 0, -0.0).otherwise(1.0)).alias("v"))
    ranked = skew.average_rank(rows, [], "v", "r", per_range=4_000)
    got = ranked.withColumn("task", F.spark_partition_id()).groupBy("v", "r", "task").count().collect()
    apart.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["v"], r["r"]) for r in got} == {(0.0, 10_000.5), (1.0, 30_000.5), (None, None)}
    assert sum(r["count"] for r in got) == 60_000 and max(r["count"] for r in got) < 16_000
