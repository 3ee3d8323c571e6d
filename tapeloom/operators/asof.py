"""As-of and point-in-time joins without range joins.

Both sides are put on one time line and the last known right row is carried
forward, so each key is sorted once and no pair of rows is ever multiplied.
Callers pass sides with one row per (keys, date); a key's line is then at most
two calendars long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "__UNKNOWN__"
OPEN_START, OPEN_END = "1900-01-01", "2099-12-31"


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, cols: list[str]) -> DataFrame:
    """Left rows with `cols` of the latest right row at or before `left_on`."""
    payload = F.struct(*[F.col(c) for c in cols])
    marks = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), payload.alias("_right"))
    rows = left.select(*keys, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(rows, allowMissingColumns=True).withColumn("_seen", F.last("_right", ignorenulls=True).over(line))
    return merged.where("_side = 1").select("_left.*", *[F.col("_seen")[c].alias(c) for c in cols])


#: Dyadic date blocks reach from one day to 2^LEVELS days, counted from OPEN_START.
LEVELS = 17


def _day(column: Column) -> Column:
    """Days since OPEN_START, at least 0 and below 2^LEVELS."""
    return F.least(F.greatest(F.datediff(column, F.lit(OPEN_START).cast("date")), F.lit(0)), F.lit((1 << LEVELS) - 1))


def covering_blocks(first: Column, last: Column) -> Column:
    """The fewest dyadic blocks that make up the days from first to last: at most two per level.

    A block (level, k) holds the days k * 2^level up to (k + 1) * 2^level - 1. Level
    by level, what is left of the range gives up its odd ends.
    """

    def ends(level: int) -> list[Column]:
        low = F.floor((first + ((1 << level) - 1)) / (1 << level)).cast("int")
        high = F.floor((last + 1) / (1 << level)).cast("int")
        odd = [(low, (low % 2 == 1) & (low < high)), (high - 1, (high % 2 == 1) & (low < high) & ~((low % 2 == 1) & (low == high - 1)))]
        return [F.when(given, F.struct(F.lit(level).alias("level"), k.alias("block"))) for k, given in odd]

    return F.filter(F.array(*[e for level in range(LEVELS + 1) for e in ends(level)]), lambda b: b.isNotNull())


def latest_covering(days: DataFrame, spans: DataFrame) -> DataFrame:
    """(instrument, _d, _og) for days inside any interval: the group of the interval that started last.

    `days`: instrument, _d; `spans`: instrument, _s, _e, _g. Each interval is cut
    into dyadic blocks and a block keeps the latest start; a day looks up the one
    block of each level that holds it. So an interval makes at most two rows per
    level and a day one, however many intervals overlap, and the key of the join
    holds the block, which spreads a busy instrument.
    """
    cut = spans.select("instrument", "_s", "_g", F.explode(covering_blocks(_day(F.col("_s")), _day(F.col("_e")))).alias("_b"))
    best = cut.groupBy("instrument", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.max(F.struct("_s", "_g")).alias("_top"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    asked = days.withColumns({"_n": _day(F.col("_d")), "_level": levels}).withColumn("_block", F.expr("shiftright(_n, _level)")).drop("_n")
    met = asked.join(best, ["instrument", "_level", "_block"])
    return met.groupBy("instrument", "_d").agg(F.max("_top").alias("_top")).select("instrument", "_d", F.col("_top._g").alias("_og"))


def pit_group_join(df: DataFrame, intervals: DataFrame, *, on: str = "dt", group: str = "grp") -> DataFrame:
    """Group of each row from `(instrument, grp, start_dt, end_dt)` intervals.

    Of the intervals holding the date the latest start wins; none gives
    `__UNKNOWN__`. Open ends default to 1900-01-01 and 2099-12-31; intervals that
    end before they start hold nothing. The as-of step settles every row whose
    latest interval still runs. Dates after its end look among the earlier
    intervals by dyadic blocks, so overlaps do not multiply rows.
    """
    start = F.coalesce("start_dt", F.lit(OPEN_START).cast("date"))
    end = F.coalesce("end_dt", F.lit(OPEN_END).cast("date"))
    spans = intervals.select("instrument", start.alias("_s"), end.alias("_e"), F.col(group).alias("_g")).where("_e >= _s")
    spans = spans.groupBy("instrument", "_s").agg(F.max(F.struct("_e", "_g")).alias("m")).select(
        "instrument", "_s", "m._e", "m._g")
    # One row per instrument and date is settled; the rows themselves meet it in a plain join.
    days = df.select("instrument", on).distinct()
    out = asof_join(days, spans, ["instrument"], on, "_s", ["_s", "_e", "_g"])
    by_start = Window.partitionBy("instrument").orderBy("_s")
    outlasting = spans.withColumn("_next", F.lead("_s").over(by_start)).where("_e >= _next").drop("_next")
    open_rows = out.where(F.col("_e") < F.col(on)).select("instrument", F.col(on).alias("_d"))
    older = latest_covering(open_rows, outlasting).withColumnRenamed("_d", on)
    direct = F.when(F.col("_e") >= F.col(on), F.col("_g"))
    out = out.join(older, ["instrument", on], "left")
    settled = out.select("instrument", on, F.coalesce(direct, "_og", F.lit(UNKNOWN)).alias("_found"))
    return df.join(settled, ["instrument", on], "left").withColumn(group, F.coalesce("_found", F.lit(UNKNOWN))).drop("_found")


def snapshot_asof(snapshots: DataFrame, dates: DataFrame, *, snap: str = "snap_dt") -> DataFrame:
    """All rows of the latest complete snapshot at or before each date.

    Snapshot dates and query dates are calendar-sized; only the last join moves
    the snapshot rows, on the snapshot date.
    """
    days = snapshots.select(F.col(snap).alias("_snap")).distinct()
    picked = asof_join(dates.select("dt").distinct(), days, [], "dt", "_snap", ["_snap"]).where("_snap is not null")
    return snapshots.join(F.broadcast(picked), snapshots[snap] == picked["_snap"]).drop("_snap")
