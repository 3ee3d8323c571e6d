"""The share ledger: reservations, settlement, refusals, and its streaming form."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.streaming import positions

DAY = dt.date(2024, 1, 2)
EVENTS = "account long, instrument long, ts timestamp, seq long, kind string, shares double"


def at(day, hour):
    return dt.datetime.combine(DAY + dt.timedelta(days=day), dt.time(hour))


def history(spark, rows, opening=None, **how):
    events = spark.createDataFrame([(1, 7, at(d, 9 + k % 9), k, kind, s) for k, (d, kind, s) in enumerate(rows)], EVENTS)
    first = opening and spark.createDataFrame([(1, 7, *opening)], "account long, instrument long, total double, available double, frozen double, unsettled double")
    return [(r["done"], r["total"], r["available"], r["frozen"], r["unsettled"]) for r in positions.position_history(events, first, **how).orderBy("seq").collect()]


def test_bought_shares_are_sellable_next_session(spark):
    rows = [(0, "buy", 100.0), (0, "reserve", 50.0), (1, "reserve", 80.0), (1, "reserve", 80.0), (1, "release", 30.0), (1, "fill", 70.0), (2, "reserve", 99.0)]
    assert history(spark, rows) == [
        (100.0, 100.0, 0.0, 0.0, 100.0), (0.0, 100.0, 0.0, 0.0, 100.0), (80.0, 100.0, 100.0, 80.0, 0.0), (20.0, 100.0, 100.0, 100.0, 0.0),
        (30.0, 100.0, 100.0, 70.0, 0.0), (70.0, 30.0, 30.0, 0.0, 0.0), (30.0, 30.0, 30.0, 30.0, 0.0)]


def test_a_fill_must_be_reserved(spark):
    with pytest.raises(Exception, match="exceeds"):
        history(spark, [(0, "fill", 1.0)], (10.0, 10.0, 0.0, 0.0))
    assert history(spark, [(0, "fill", 1.0), (0, "release", 5.0)], (10.0, 10.0, 0.0, 0.0), overfill="refuse") == [(0.0, 10.0, 10.0, 0.0, 0.0)] * 2
    with pytest.raises(Exception, match="not negative"):
        history(spark, [(0, "buy", -1.0)])
    with pytest.raises(Exception, match="unknown event"):
        history(spark, [(0, "gift", 1.0)])


def test_missing_parts_of_an_opening_position(spark):
    assert history(spark, [(0, "reserve", 99.0)], (10.0, None, None, None)) == [(10.0, 10.0, 10.0, 10.0, 0.0)]


@pytest.mark.parametrize("opening", [(10.0, 11.0, 0.0, 0.0), (10.0, 5.0, 6.0, 0.0), (10.0, 8.0, 0.0, 3.0), (-1.0, -1.0, 0.0, 0.0), (5.0, 5.0, -2.0, 0.0)])
def test_contradicting_positions_are_refused(spark, opening):
    with pytest.raises(Exception, match="position of account 1"):
        history(spark, [(0, "buy", 1.0)], opening)


def test_stream_holds_events_until_their_session_is_over(spark, tmp_path):
    """Files arrive out of order; the ledger equals the batch walk over all closed sessions."""
    from tapeloom.streaming import jobs

    kinds = ["buy", "reserve", "fill", "buy", "release", "reserve"]
    rows = [(k % 3, k % 4, at(k // 40, 9 + k * 7 % 8), k, kinds[k * 5 % 6], float(k % 13)) for k in range(200)]
    events = spark.createDataFrame(rows, EVENTS)
    for n in range(2):
        # Both files hold events of all sessions.
        events.where(F.col("seq") % 2 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    got = jobs.drain(positions.position_events(stream, overfill="refuse", buckets=2), "ledger")
    closed = events.where(F.col("ts") < F.lit(at(4, 0)))
    want = positions.position_history(closed, overfill="refuse")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 160
    assert got.where("frozen > available + 1e-9 or available + unsettled > total + 1e-9 or least(total, available, frozen, unsettled) < 0").count() == 0


class Held:
    """State of one bucket outside of a stream: a list, a map and timers, with the number of readings of the list."""

    def __init__(self):
        self.rows, self.map, self.timers, self.reads = [], {}, set(), 0
        self.registerTimer, self.updateValue, self.containsKey, self.getValue = self.timers.add, self.map.__setitem__, self.map.__contains__, self.map.get
        self.getMapState = self.getListState = lambda *_: self
        self.appendList, self.clear = self.rows.extend, self.rows.clear

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.rows[:] = rows


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_a_backlog_of_sessions_is_read_once():
    columns = ["account", "instrument", "session", "ts", "seq", "kind", "shares"]
    rows = pd.DataFrame([(1, k % 3, DAY + dt.timedelta(days=k // 4), at(k // 4, 9 + k % 4), k, "buy", 1.0) for k in range(120)], columns=columns)
    held, job = Held(), positions.PositionProcessor("raise")
    job.init(held)
    list(job.handleInputRows((1, 0), iter([rows[:50], rows[50:]]), None))
    mark = int(at(20, 12).replace(tzinfo=dt.UTC).timestamp() * 1000)
    out = []
    while due := sorted(t for t in held.timers if t <= mark):
        held.timers.discard(due[0])
        fired = At(due[0])
        out += [f for f in job.handleExpiredTimer((1, 0), At(mark), fired)]
    assert sum(map(len, out)) == 80 and len(held.rows) == 40 and len(held.timers) == 1
    assert held.reads == 1
