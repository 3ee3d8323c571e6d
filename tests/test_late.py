"""Timers of the throttle, late rows, and windows closed by a marker."""

import datetime as dt

from pyspark.sql import functions as F

from tapeloom.streaming import jobs

DAY = dt.datetime(2024, 1, 2)


def seconds_folder(spark, path, rows):
    """Each list of (instrument, second of the day, day, price) is one file."""
    for part in rows:
        data = [(k, DAY + dt.timedelta(days=d, seconds=s), p, 1) for k, s, d, p in part]
        spark.createDataFrame(data, "instrument string, ts timestamp, price double, ticks long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("instrument string, ts timestamp, price double, ticks long").option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, path, stream):
    out = f"{path}-out"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect(), job.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_forced_action_comes_without_a_further_tick(spark, tmp_path):
    path = str(tmp_path / "s")
    # "a" ends early and never ticks again; "b" acts after force_from by itself; "c" never ticks inside the window.
    parts = [[("a", 1000, 0, 1.0), ("a", 1500, 0, 2.0), ("b", 1000, 0, 5.0), ("b", 4100, 0, 6.0), ("c", 9000, 0, 3.0)], [("z", 100, 3, 1.0)]]
    got, left = run(spark, path, jobs.throttle(seconds_folder(spark, path, parts), interval=600, start=900, end=5000, force_from=4000))
    rows = {(r["instrument"], (r["ts"] - DAY).total_seconds(), r["price"], r["forced"]) for r in got}
    assert rows == {("a", 1000.0, 1.0, False), ("a", 5000.0, 2.0, True), ("b", 1000.0, 5.0, False), ("b", 4100.0, 6.0, True)}
    # Only the last, open session is still held.
    assert left <= 1


def test_a_window_that_is_not_over_forces_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    got, left = run(spark, path, jobs.throttle(seconds_folder(spark, path, [[("a", 1000, 0, 1.0), ("a", 1400, 0, 2.0)]]), interval=600, start=900, end=5000, force_from=4000))
    assert [(r["price"], r["forced"]) for r in got] == [(1.0, False)] and left >= 1


def test_late_rows_lie_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path / "s")
    parts = [[("a", 100, 0, 1.0)], [("a", 5000, 0, 1.0), ("a", 50, 0, 1.0)], [("a", 4690, 0, 2.0), ("a", 4710, 0, 3.0)], [("a", 90_000, 0, 1.0)]]
    stream = seconds_folder(spark, path, parts)
    got = jobs.arrivals(stream, "arrivals").orderBy("batch", "ts").collect()
    assert [(r["batch"], (r["ts"] - DAY).total_seconds(), r["late"]) for r in got] == [
        (0, 100.0, False), (1, 50.0, False), (1, 5000.0, False), (2, 4690.0, True), (2, 4710.0, False), (3, 90_000.0, False)]


def test_a_marker_closes_every_window(spark, tmp_path):
    path = str(tmp_path / "s")
    stream = seconds_folder(spark, path, [[("a", 10, 0, 1.0), ("b", 70, 0, 2.0)]])
    ticks = stream.select("instrument", "ts", "price", F.lit(1.0).alias("qty"), F.lit(1).alias("seq"))
    assert jobs.drain(jobs.minute_bars(ticks), "open").count() == 0
    bars = jobs.drain(jobs.minute_bars(jobs.with_close(ticks, "2024-01-05")), "closed").collect()
    assert sorted((r["instrument"], r["close"]) for r in bars) == [("a", 1.0), ("b", 2.0)]
