"""Registry of checked queries.

A query is a function of `Tables` plus an output spec and, where SQL can say the
same, the SQL text. The spec (`name:type`) fixes names, types and rounding on
both sides: i bigint, f double rounded to 6 digits, f2/f4 to fewer, s text,
b boolean, d date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.bindings import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean", "d": "date"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "d": "DATE"}


def _split(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _digits(kind: str) -> int:
    return int(kind[1:] or 6)


def _nudge(kind: str) -> str:
    """A hundredth of the last digit, added before rounding on both sides.

    The two engines treat exact halves differently; the nudge takes short
    decimals such as 0.0000005 off the boundary.
    """
    return f"{0.0123 * 10.0 ** -_digits(kind):.3e}"


def _rounded(value: Column, digits: int) -> Column:
    """Round as DuckDB does, by scaling; large values, where that is coarse, by their decimal text, which takes far longer."""
    scale = 10.0**digits
    return F.when(F.abs(value) < 1e11 / scale, F.rint(value * scale) / scale + 0.0).otherwise(F.round(value, digits))


def tidy(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _split(spec):
        if kind[0] == "f":
            cols.append(_rounded(F.col(name).cast("double") + float(_nudge(kind)), _digits(kind)).alias(name))
        else:
            cols.append(F.col(name).cast(_SPARK[kind]).alias(name))
    return df.select(*cols)


def _tidy_sql(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _split(spec):
        if kind[0] == "f":
            cols.append(f"round(CAST({name} AS DOUBLE) + {_nudge(kind)}::DOUBLE, {_digits(kind)}) + 0.0 AS {name}")
        else:
            cols.append(f"CAST({name} AS {_SQL[kind]}) AS {name}")
    return f"SELECT {', '.join(cols)} FROM ({sql}) AS q"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: tidy(fn(Tables(spark, root)), spec)
        if sql is not None:
            ORACLES[name] = _tidy_sql(sql, spec)
        return fn

    return register


def _bars_sql(dt: str, where: str = "", scale: str = "1.0") -> str:
    price = f"l_extendedprice/l_quantity*{scale}"
    return f"""SELECT l_suppkey AS instrument, {dt} AS dt,
      min_by({price}, (l_orderkey, l_linenumber, l_extendedprice)) AS open, max({price}) AS high, min({price}) AS low,
      max_by({price}, (l_orderkey, l_linenumber, l_extendedprice)) AS close, sum(l_quantity) AS volume,
      sum(l_extendedprice) AS amount
      FROM lineitem {where} GROUP BY ALL"""


_DAY = "CAST(l_shipdate AS DATE)"
BARS = "bars AS (" + _bars_sql(_DAY) + ")"
BARS_W = "barsw AS (" + _bars_sql("CAST(date_trunc('week', l_shipdate) AS DATE)") + ")"
PRIMARY = "prim AS (" + _bars_sql(_DAY, "WHERE l_returnflag='N'") + ")"
FALLBACK = "fall AS (" + _bars_sql(_DAY, "WHERE l_returnflag<>'N'", "1.25") + ")"
SESS = """sess AS (SELECT dt, row_number() OVER (ORDER BY dt) AS session_no
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem) d)"""
MINUTES = """minutes AS (SELECT event_type AS instrument, CAST(ts AS DATE) AS dt,
  extract(hour FROM ts)*60 + extract(minute FROM ts) AS minute_of_day,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
  CAST(sum(user_id) AS DOUBLE) AS volume, sum(value*user_id) AS amount FROM events GROUP BY ALL)"""
HELD = BARS + """, held AS (SELECT instrument, dt,
  ['600','300','688','000','830'][CAST(instrument % 5 AS INT) + 1] || lpad(CAST(instrument % 1000 AS VARCHAR), 3, '0') AS code,
  CAST(floor(volume)*20 AS DOUBLE) AS shares, low AS mark_price, open AS decision_price, close AS exit_price,
  low AS window_low, high AS window_high, volume AS visible_volume, amount AS visible_amount FROM bars)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
