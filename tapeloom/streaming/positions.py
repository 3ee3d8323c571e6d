"""Share positions with reservations and next-session settlement.

Shares bought in a session can be sold from the next one on. A sale is reserved
first, which freezes shares that are available; its fill takes them out of the
reservation. Events of a session are applied in their order once the watermark
has passed the session, so late arrivals inside it change nothing.

The streaming job deals positions, which never meet, to buckets by a hash of account
and instrument. A bucket keeps its positions as a map and its open sessions' events
as one list with one timer, so neither small accounts nor long backlogs cost a call each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.streamed import fold_columns

# The kinds of events, and how far shares may be off by rounding.
KINDS = ("buy", "reserve", "release", "fill")
SLACK = 1e-9

Position = tuple[float, float, float, float, dt.date | None]  # total, available, frozen, unsettled, session
EMPTY: Position = (0.0, 0.0, 0.0, 0.0, None)
_STATE = "total double, available double, frozen double, unsettled double, session date"
_EVENT = "account bigint, instrument bigint, session date, ts timestamp, seq bigint, kind string, shares double"
RESULT = "account bigint, instrument bigint, session date, seq bigint, kind string, shares double, done double, total double, available double, frozen double, unsettled double"


def apply_event(state: Position, session: dt.date, kind: str, shares: float, overfill: str = "raise") -> tuple[Position, float]:
    """The position after one event, and the shares it moved.

    A reservation is clipped to the shares that are available and not frozen, a
    release to those frozen. A fill above the reservation is an error, or moves
    nothing with overfill="refuse".
    """
    total, available, frozen, unsettled, last = state
    if shares is None or shares < -SLACK:
        raise ValueError(f"shares of a {kind} must be known and not negative, not {shares}")
    if last is not None and session > last:
        available, unsettled = min(total, available + unsettled), 0.0
    done = max(shares, 0.0)
    if kind == "buy":
        total, unsettled = total + done, unsettled + done
    elif kind == "reserve":
        done = min(done, max(0.0, available - frozen))
        frozen += done
    elif kind == "release":
        done = min(done, frozen)
        frozen -= done
    elif kind == "fill":
        if done > frozen + SLACK:
            if overfill == "raise":
                raise ValueError(f"a fill of {done} shares exceeds the {frozen} reserved")
            done = 0.0
        total, available, frozen = max(0.0, total - done), max(0.0, available - done), max(0.0, frozen - done)
    else:
        raise ValueError(f"unknown event {kind}")
    return (total, available, frozen, unsettled, session), done


def checked_positions(positions: DataFrame) -> DataFrame:
    """Opening positions (account, instrument, total, available, frozen, unsettled), refused where they contradict themselves.

    A missing `available` is the total, a missing `frozen` or `unsettled` nothing.
    """
    total = F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    given = {"total": total, "available": F.coalesce(F.col("available").cast("double"), total)}
    given |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("frozen", "unsettled")}
    rows = positions.select("account", "instrument", *[v.alias(c) for c, v in given.items()])
    limits: list[tuple[Column, str]] = [(F.col(c) >= -SLACK, f"{c} is negative") for c in given]
    limits += [
        (F.col("frozen") <= F.col("available") + SLACK, "frozen shares exceed the available ones"),
        (F.col("available") + F.col("unsettled") <= F.col("total") + SLACK, "available and unsettled shares exceed the total"),
    ]
    fault = F.coalesce(*[F.when(~ok, F.lit(text)) for ok, text in limits])
    named = F.concat(F.lit("position of account "), F.col("account"), F.lit(", instrument "), F.col("instrument"), F.lit(": "), fault)
    return rows.withColumn("total", F.when(fault.isNotNull(), F.raise_error(named)).otherwise(F.col("total")))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.hash("account", "instrument"), F.lit(buckets)))


class PositionProcessor(StatefulProcessor):
    """Positions of one bucket; a session's events wait until the watermark has passed it."""

    def __init__(self, overfill: str):
        self.overfill = overfill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getMapState("positions", "account bigint, instrument bigint", _STATE)
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.positions.updateValue((int(row.account), int(row.instrument)), (row.total, row.available, row.frozen, row.unsettled, None))

    def _wake(self, first: dt.date) -> None:
        """A timer at the end of the earliest waiting session."""
        end = dt.datetime.combine(first + dt.timedelta(days=1), dt.time(), dt.UTC)
        self.handle.registerTimer(int(end.timestamp() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            columns = (part[c].tolist() for c in ("account", "instrument", "session", "ts", "seq", "kind", "shares"))
            self.waiting.appendList(list(zip(*columns, strict=True)))
            earliest = part["session"].min()
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All sessions behind the watermark are over, also those after the timer's own.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        limit = dt.datetime.fromtimestamp(passed / 1000, dt.UTC).date()
        events = [tuple(e) for e in self.waiting.get()]
        ready, rest = [e for e in events if e[2] < limit], [e for e in events if e[2] >= limit]
        if rest and ready:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        if rest:
            self._wake(min(e[2] for e in rest))
        out, held = [], {}
        for account, instrument, session, _, seq, kind, shares in sorted(ready, key=lambda e: (e[3], e[4])):
            at = (account, instrument)
            if at not in held:
                held[at] = tuple(self.positions.getValue(at)) if self.positions.containsKey(at) else EMPTY
            state, done = apply_event(held[at], session, kind, shares, self.overfill)
            held[at] = state
            out.append((account, instrument, session, seq, kind, shares, done, *state[:4]))
        for at, state in held.items():
            self.positions.updateValue(at, state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def position_events(events: DataFrame, opening: DataFrame | None = None, *, delay: str = "5 minutes", overfill: str = "raise", buckets: int = 1024) -> DataFrame:
    """The ledger of a stream of events, each with what it moved and the position after it.

    Input: account, instrument, ts, seq, kind (buy, reserve, release, fill), shares.
    `opening` holds positions from before the stream, checked by `checked_positions`.
    A task holds the waiting events of one of the `buckets` at a time.
    """
    rows = events.withWatermark("ts", delay).select("account", "instrument", F.col("ts").cast("date").alias("session"), "ts", "seq", "kind", F.col("shares").cast("double").alias("shares"))
    first = None if opening is None else _bucketed(checked_positions(opening), buckets).groupBy("bucket")
    return _bucketed(rows, buckets).groupBy("bucket").transformWithStateInPandas(
        PositionProcessor(overfill), outputStructType=RESULT, outputMode="append", timeMode="EventTime", initialState=first)


def position_history(events: DataFrame, opening: DataFrame | None = None, *, overfill: str = "raise") -> DataFrame:
    """The same ledger over a finished table, as one ordered walk per account and instrument."""
    rows = events.select("account", "instrument", F.col("ts").cast("date").alias("session"), "ts", "seq", "kind", F.col("shares").cast("double").alias("shares"))
    if opening is not None:
        first = checked_positions(opening).select("account", "instrument", F.array("total", "available", "frozen", "unsettled").alias("_open"))
        rows = rows.join(first, ["account", "instrument"], "left")
    else:
        rows = rows.withColumn("_open", F.lit(None).cast("array<double>"))

    def step(state: Position | None, opened, session, kind, shares) -> tuple[Position, tuple]:
        if state is None:
            state = EMPTY if opened is None else (*opened, None)
        state, done = apply_event(state, session, kind, shares, overfill)
        return state, (done, *state[:4])

    added = "done double, total double, available double, frozen double, unsettled double"
    out = fold_columns(rows, ["account", "instrument"], ["ts", "seq"], ["_open", "session", "kind", "shares"], added, lambda: None, step)
    return out.select(*[c.split()[0] for c in RESULT.split(", ")])
