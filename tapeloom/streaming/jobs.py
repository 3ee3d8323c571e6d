"""Structured Streaming jobs over ticks and order events.

Ticks arrive as files with an event time. Everything that an aggregate can say
stays a streaming aggregate, which combines map-side, so one hot symbol never
fills one task; Python state is used only for the ledger and the throttle, on
input already reduced to one row per session or per second.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tapeloom.operators.streamed import fold_columns
from tapeloom.session import scratch_path

DELAY = "5 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, root: str, name: str = "events.parquet") -> DataFrame:
    """File stream of events; the zone-free time becomes a timestamp (UTC session)."""
    schema = spark.read.parquet(f"{root}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(root)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over all available input into a table, read it back."""
    return stream.sparkSession.read.schema(stream.schema).parquet(drain_to_path(stream, label))


def drain_to_path(stream: DataFrame, label: str) -> str:
    """As `drain`, returning the folder, for a following job to stream from."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = scratch_path(spark, label)
    job = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
           .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    return out


def with_close(stream: DataFrame, end: str, on: str = "ts") -> DataFrame:
    """The stream and a marker behind its last session, which lets the watermark pass every window.

    The marker is a row of nulls at `end`, written to the shared folder and read as
    a second source. `end` lies at least one window and the watermark's delay behind
    the last event, so the marker's own window never closes and no result shows it.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "close-marker")
    values = [F.lit(end).cast(f.dataType).alias(f.name) if f.name == on else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*values).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def arrivals(events: DataFrame, label: str, delay: str = DELAY) -> DataFrame:
    """Every row of a stream with the batch it came in and whether it came too late for the watermark.

    A row is late if its time lies before the latest time of all earlier batches
    minus the delay. A window behind the same watermark drops such a row without a
    trace, at the latest from the batch after the next one on. Each batch is written
    once, under its number, and the watermark is read back from the batches before,
    so a restarted job gives the same verdicts.
    """
    spark = events.sparkSession
    out = scratch_path(spark, label)
    schema = StructType([*events.schema.fields, StructField("batch", LongType()), StructField("late", BooleanType())])
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession.read.schema(schema).parquet(*[f"{out}/batch={k}" for k in range(-1, number)])
        mark = own.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
        flagged = rows.join(F.broadcast(mark), how="cross").withColumn("late", F.coalesce(F.col("ts") < F.col("_mark"), F.lit(False)))
        flagged.drop("_mark").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    last = job.lastProgress["batchId"] if job.lastProgress else -1
    return spark.read.schema(schema).parquet(*[f"{out}/batch={k}" for k in range(-1, last + 1)])


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream the finished files of an earlier job's folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def minute_bars(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Tumbling one-minute bars of closed minutes.

    Input: instrument, ts, price, qty, seq. Later ticks than the watermark are
    dropped; a minute is emitted once the watermark passes its end.
    """
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "instrument").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("amount")
    ).select("instrument", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def reached(direction: Column, price: Column, limit: Column) -> Column:
    return F.when(direction == "buy_first", price <= limit).otherwise(price >= limit)


def first_triggers(ticks: DataFrame, candidates: DataFrame, delay: str = DELAY) -> DataFrame:
    """First affordable tick at or through each candidate's limit, per session.

    `candidates`: instrument, direction, entry_limit, volume, budget. A tick the
    budget refuses leaves the candidate open for a later, cheaper one. The stream
    meets the static candidates in an equi join; the earliest hit is a streaming
    `min_by`, emitted when the session's watermark has passed.
    """
    hits = ticks.withWatermark("ts", delay).join(candidates, "instrument").where(
        reached(F.col("direction"), F.col("price"), F.col("entry_limit")) & (2.0 * F.col("volume") * F.col("price") <= F.col("budget")))
    first = F.struct("ts", "seq")
    return hits.groupBy(F.window("ts", "1 day"), "instrument", "direction").agg(
        F.min(first).alias("_f"), F.min_by("price", first).alias("price"), F.count(F.lit(1)).alias("touches")
    ).select("instrument", "direction", F.col("window.start").cast("date").alias("dt"), F.col("_f.ts").alias("ts"), "price", "touches")


def order_states(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Latest callback per order and session.

    Input: order_key, instrument, side, status, ts, seq. Repeated callbacks
    collapse in the aggregate; state of a session is dropped once it closes.
    """
    order = F.struct("ts", "seq")
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "order_key").agg(
        F.max_by(F.struct("instrument", "side", "status"), order).alias("_l"), F.count(F.lit(1)).alias("callbacks")
    ).select("order_key", F.col("window.start").cast("date").alias("dt"), "_l.*", "callbacks")


def session_flows(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Bought and offered shares per (account, session), closed sessions only.

    Input: account, ts, side (BUY/SELL), shares.
    """
    qty = F.col("shares")
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "account").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "BUY", qty)), F.lit(0.0)).alias("bought"),
        F.coalesce(F.sum(F.when(F.col("side") == "SELL", qty)), F.lit(0.0)).alias("offered")
    ).select("account", F.col("window.start").cast("date").alias("dt"), "bought", "offered")


LEDGER = "account bigint, dt date, open_available double, sold double, refused double, unsettled double, total double"


class LedgerProcessor(StatefulProcessor):
    """Shares (total, available, unsettled) of one key with next-session settlement.

    Shares bought in a session can be sold from the next one on; a sale is
    clipped to what is available at the open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "total double, available double, unsettled double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, available, unsettled = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0)
        out = []
        for day in pd.concat(list(rows)).sort_values("dt").itertuples(index=False):
            available, unsettled = available + unsettled, 0.0
            opened = available
            sold = min(day.offered, available)
            available, total = available - sold, total - sold + day.bought
            unsettled = day.bought
            out.append((key[0], day.dt, opened, sold, day.offered - sold, unsettled, total))
        self.state.update((total, available, unsettled))
        yield pd.DataFrame(out, columns=["account", "dt", "open_available", "sold", "refused", "unsettled", "total"])

    def close(self) -> None:
        pass


def position_ledger(flows: DataFrame) -> DataFrame:
    """Ledger rows from a stream of session flows (one row per account and session)."""
    return flows.groupBy("account").transformWithStateInPandas(
        LedgerProcessor(), outputStructType=LEDGER, outputMode="append", timeMode="none")


def ledger_batch(flows: DataFrame) -> DataFrame:
    """Batch twin of the ledger: an ordered walk per account over its sessions."""

    def step(state: tuple[float, float, float], bought: float, offered: float) -> tuple[tuple, tuple]:
        total, available, unsettled = state
        opened = available + unsettled
        sold = min(offered, opened)
        total = total - sold + bought
        return (total, opened - sold, bought), (opened, sold, offered - sold, bought, total)

    added = "open_available double, sold double, refused double, unsettled double, total double"
    out = fold_columns(flows, ["account"], ["dt"], ["bought", "offered"], added, lambda: (0.0, 0.0, 0.0), step)
    return out.drop("bought", "offered")


def second_ticks(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """First tick of each instrument and second (clocks count whole seconds)."""
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", "1 second"), "instrument").agg(
        F.min_by("price", F.struct("ts", "seq")).alias("price"), F.count(F.lit(1)).alias("ticks")
    ).select("instrument", F.col("window.start").alias("ts"), "price", "ticks")


THROTTLED = "instrument string, dt date, ts timestamp, price double, forced boolean"


class ThrottleProcessor(StatefulProcessor):
    """At most one action per interval inside a clock window, and one by force at its end.

    A timer behind the window's end ends the session: if nothing was done from
    `force_from` on, the last price acts, also when no further tick arrives; then
    the session's state is gone.
    """

    def __init__(self, interval: int, start: int, end: int, force_from: int):
        self.interval, self.start, self.end, self.force_from = interval, start, end, force_from

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, price double, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, price, at = self.state.get() if self.state.exists() else (None, None, None)
        ticks = pd.concat(list(rows)).sort_values("ts")
        seconds = ticks["ts"].dt.hour * 3600 + ticks["ts"].dt.minute * 60 + ticks["ts"].dt.second
        inside = seconds.between(self.start, self.end)
        out = []
        if at is None and len(ticks):
            day = datetime.combine(key[1], time(), UTC)
            self.handle.registerTimer(int(day.timestamp() + self.end + 1) * 1000)
        for second, ts, own in zip(seconds[inside].tolist(), ticks["ts"][inside], ticks["price"][inside].tolist(), strict=True):
            price, at = own, ts
            if last is None or second - last >= self.interval:
                last = second
                out.append((key[0], key[1], ts, own, second >= self.force_from))
        if at is not None:
            self.state.update((last, price, at))
        yield pd.DataFrame(out, columns=["instrument", "dt", "ts", "price", "forced"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, price, _ = self.state.get() if self.state.exists() else (None, None, None)
        self.state.clear()
        missed = price is not None and last < self.force_from
        end = pd.Timestamp(datetime.combine(key[1], time(), UTC)).tz_localize(None) + pd.Timedelta(seconds=self.end)
        yield pd.DataFrame([(key[0], key[1], end, price, True)] if missed else [], columns=["instrument", "dt", "ts", "price", "forced"])

    def close(self) -> None:
        pass


def throttle(seconds: DataFrame, *, interval: int, start: int, end: int, force_from: int, delay: str = "0 seconds") -> DataFrame:
    """Throttled actions per (instrument, session): at most 86,400 input rows a key."""
    keyed = seconds.withWatermark("ts", delay).withColumn("dt", F.col("ts").cast("date"))
    return keyed.groupBy("instrument", "dt").transformWithStateInPandas(
        ThrottleProcessor(interval, start, end, force_from), outputStructType=THROTTLED, outputMode="append", timeMode="EventTime")


def flag_decisions(events: DataFrame, *, max_age: int, cutoff_second: int) -> DataFrame:
    """Decisions with a verdict: fresh, stale, future, same_day or late.

    Input adds signal_dt. A refused decision keeps its own date; it is never
    moved to another session.
    """
    from tapeloom.functions.clock import freshness

    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    verdict = freshness(F.col("ts").cast("date"), F.col("signal_dt"), max_age, same_day_ok=False)
    return events.withColumn("verdict", F.when((verdict == "fresh") & (second > cutoff_second), "late").otherwise(verdict))


def session_summary(events: DataFrame, expected: list[str], delay: str = DELAY) -> DataFrame:
    """Per closed session: decisions done, missing, blocked, and whether it closed.

    Input: ts, decision, blocked, is_close. The decision list is fixed, so each
    becomes one conditional count and no set of events is collected.
    """
    aggs = [F.count_if(F.col("decision") == d).alias(f"_{i}") for i, d in enumerate(expected)]
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("blocked").alias("blocked"), F.count_if("is_close").alias("_close"), *aggs)
    missing = F.concat_ws(",", *[F.when(F.col(f"_{i}") == 0, F.lit(d)) for i, d in enumerate(expected)])
    done = sum((F.when(F.col(f"_{i}") > 0, 1).otherwise(0) for i in range(len(expected))), F.lit(0))
    return out.select(F.col("window.start").cast("date").alias("dt"), "events", done.alias("done"), missing.alias("missing"), "blocked",
                      (F.col("_close") > 0).alias("closed"))
