"""Null, NaN and zero-variance guards (ANSI mode raises where pandas gives NaN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def finite_or_null(value: Column) -> Column:
    """NaN and +-inf become null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), F.lit(None)).otherwise(number)


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: finite_or_null(F.col(n)) for n in names})


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pair_corr(x: Column, y: Column, min_pairs: int = 2, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over pairs with both values; null on no spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)

    def agg(c: Column) -> Column:
        return c.over(over) if over is not None else c

    n = agg(F.count(x))
    sx, sy = agg(F.stddev_pop(x)), agg(F.stddev_pop(y))
    spread = (n >= min_pairs) & (sx > EPS) & (sy > EPS)
    return F.when(spread, F.try_divide(agg(F.covar_pop(x, y)), sx * sy))


def by_instrument(*extra: str) -> WindowSpec:
    """Rows of one instrument in date order; bounded by the calendar."""
    return Window.partitionBy("instrument", *extra).orderBy("dt")


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def guarded(agg: Column, counted: Column, w: WindowSpec, min_periods: int) -> Column:
    """A window aggregate, null until `min_periods` non-null inputs are seen."""
    return F.when(F.count(counted).over(w) >= min_periods, agg.over(w))
