"""Bind the panel operators to TPC-H-like tables.

Every group used by a later per-instrument window is bounded by the calendar
(one row per instrument and date) or by the clock (one row per minute), because
the raw rows are aggregated first; that aggregation combines map-side, so one
hot supplier or event type does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        # Dates and windows of the tables are zone-free, so the session reads UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _bars(self, dt, where=None, scale: float = 1.0) -> DataFrame:
        lines = self.raw("lineitem")
        if where is not None:
            lines = lines.where(where)
        price = F.col("l_extendedprice") / F.col("l_quantity") * F.lit(scale)
        # The price breaks ties between repeated (order, line) numbers.
        seq = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
        return (
            lines.select(
                F.col("l_suppkey").alias("instrument"), dt.alias("dt"), price.alias("p"), seq.alias("seq"),
                "l_quantity", "l_extendedprice",
            )
            .groupBy("instrument", "dt")
            .agg(
                F.min_by("p", "seq").alias("open"),
                F.max("p").alias("high"),
                F.min("p").alias("low"),
                F.max_by("p", "seq").alias("close"),
                F.sum("l_quantity").alias("volume"),
                F.sum("l_extendedprice").alias("amount"),
            )
        )

    def bars(self, where=None, scale: float = 1.0) -> DataFrame:
        """Daily bars: supplier as instrument, ship date as session."""
        return self._bars(F.col("l_shipdate").cast("date"), where, scale)

    def bars_w(self) -> DataFrame:
        """Weekly bars: denser cross-sections."""
        return self._bars(F.date_trunc("week", F.col("l_shipdate")).cast("date"))

    def primary(self) -> DataFrame:
        return self.bars(F.col("l_returnflag") == "N")

    def fallback(self) -> DataFrame:
        return self.bars(F.col("l_returnflag") != "N", 1.25)

    def dates(self) -> DataFrame:
        """The session dates of the panel (one date column)."""
        return self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("dt")).distinct()

    def minutes(self) -> DataFrame:
        """Minute bars: event type as instrument, at most 1,440 rows a session."""
        ts = F.col("ts")
        return (
            self.raw("events")
            .select(
                F.col("event_type").alias("instrument"), ts.cast("date").alias("dt"),
                (F.hour(ts) * 60 + F.minute(ts)).alias("minute_of_day"), "event_id", "value",
                F.col("user_id").cast("double").alias("u"),
            )
            .groupBy("instrument", "dt", "minute_of_day")
            .agg(
                F.min_by("value", "event_id").alias("open"),
                F.max("value").alias("high"),
                F.min("value").alias("low"),
                F.max_by("value", "event_id").alias("close"),
                F.sum("u").alias("volume"),
                F.sum(F.col("value") * F.col("u")).alias("amount"),
            )
        )

    def held(self) -> DataFrame:
        """Held rows: shares and prices of one decision per instrument and date."""
        code = F.concat(
            F.element_at(F.array(*[F.lit(p) for p in ("600", "300", "688", "000", "830")]),
                         (F.col("instrument") % 5 + 1).cast("int")),
            F.lpad((F.col("instrument") % 1000).cast("string"), 3, "0"),
        )
        return self.bars().select(
            "instrument", "dt", code.alias("code"),
            (F.floor("volume") * 20).cast("double").alias("shares"),
            F.col("low").alias("mark_price"), F.col("open").alias("decision_price"),
            F.col("close").alias("exit_price"), F.col("low").alias("window_low"),
            F.col("high").alias("window_high"), F.col("volume").alias("visible_volume"),
            F.col("amount").alias("visible_amount"),
        )
