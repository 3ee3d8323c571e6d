"""Ranks, positions and exact quantiles inside groups of any size.

A group (a date, a class, the whole table) may hold a third of all rows. The
rows are cut into value ranges of about `per_range` rows: the number of ranges
follows the row count, and a single range is one plain window per group. Range
points are values of the column itself, compared in its own order (numbers of
any width, text, dates), taken once from a hash sample and then fixed in the
plan. They only steer the load: equal values are counted before the shuffle,
copies of one value are cut again by the tie column, and range offsets turn
local counts into exact global ones.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import stage

PER_RANGE = 1_000_000
SAMPLE = 8  # sampled values per range
CUTS = 64  # sampled rows per range
LANES = 8  # lanes per range for rows without a value
COMMON = PER_RANGE // LANES  # rows from which a value's copies are dealt apart


class Ranges(int):
    """Number of ranges that the rows of a frame need; pass it on to spare later calls the count."""


FITS = Ranges(1)


def check_groups(df: DataFrame, keys: list[str], per_range: int = PER_RANGE) -> Ranges:
    """Ranges needed: 1 if the largest group has at most `per_range` rows, else by the whole row count."""
    if isinstance(per_range, Ranges):
        return per_range
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m"), F.sum("_n").alias("s")).first()
    return FITS if (sizes["m"] or 0) <= per_range else Ranges(-(-sizes["s"] // max(1, per_range)))


def _points(df: DataFrame, columns: list[str], ranges: int) -> list[Column]:
    """Per column an array of up to `ranges - 1` ascending values, fixed in the plan."""
    rows = df.count()
    every = max(1, rows // (SAMPLE * ranges))
    picked = df.select(*columns).where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0).distinct().collect()
    out = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        values = sorted({r[c] for r in picked if r[c] is not None and r[c] == r[c]})
        chosen = sorted({values[k * len(values) // ranges] for k in range(1, ranges)}) if values else []
        out.append(F.array(*[F.lit(v).cast(kind) for v in chosen]).cast(f"array<{kind}>"))
    return out


def _range_no(value: Column, points: Column, ranges: int) -> Column:
    """Number of points below the value, by binary search."""
    steps = [1 << k for k in reversed(range(ranges.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(points)) & (F.try_element_at(points, at + step) < value), at + step).otherwise(at))


def _cuts(df: DataFrame, value: str, ranges: int) -> tuple[Callable[[DataFrame], DataFrame], Column]:
    """What adds the slot `_b` of the value to a frame, and the lanes of a slot.

    Points cut a row sample of the value into equal parts, so one that many rows
    share is a point itself. Slot 2k lies between two points, slot 2k + 1 holds the
    copies of point k, null those without a value. Copies of a common value, and
    rows without one, are dealt to lanes. The sample only steers the load.
    """
    share = min(1.0, CUTS * ranges / max(1, df.count()))
    kind = df.schema[value].dataType.simpleString()
    picked = sorted(r[0] for r in df.select(value).where(F.col(value).isNotNull()).sample(share, 7).collect() if r[0] == r[0])
    chosen = sorted({picked[k * len(picked) // ranges] for k in range(1, ranges)}) if picked else []
    copies = [(bisect_right(picked, v) - bisect_left(picked, v)) / share for v in chosen]
    points = F.array(*[F.lit(v).cast(kind) for v in chosen]).cast(f"array<{kind}>")
    widths = F.array(*[F.lit(max(1, round(4 * n / COMMON))) for n in copies]).cast("array<int>")
    below = _range_no(F.col(value), points, max(1, len(chosen)))
    equal = F.coalesce(F.try_element_at(points, F.col("_b") + 1) == F.col(value), F.lit(False))
    width = F.when(F.col("_b") % 2 == 1, F.try_element_at(widths, F.floor(F.col("_b") / 2).cast("int") + 1))
    width = F.when(F.col("_b").isNull(), F.lit(LANES * int(ranges))).otherwise(F.coalesce(width, F.lit(1)))

    def cut(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_b", F.when(F.col(value).isNotNull(), below)).withColumn("_b", F.col("_b") * 2 + equal.cast("int"))

    return cut, width


def _by(keys: list[str], *more: str):
    return Window.partitionBy(*(keys or [F.lit(0)]), *more)


def value_counts(
    df: DataFrame,
    keys: list[str],
    value: str,
    extra: dict[str, Column] | None = None,
    weight: Column | None = None,
    per_range: int = PER_RANGE,
) -> DataFrame:
    """One row per (keys, value): `n` equal rows, `below` smaller rows, `total`.

    `extra` adds further sums per value, for example positives for an AUC. A
    0/1 `weight` counts only part of the rows (a calibration sample).
    """
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    known = df.where(F.col(value).isNotNull())
    hist = known.groupBy(*keys, value).agg(counted.alias("n"), *[c.alias(name) for name, c in (extra or {}).items()])
    ranges = check_groups(known, keys, per_range)
    if ranges == FITS:
        before = _by(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return hist.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(_by(keys)))
    points, = _points(known, [value], ranges)
    hist = hist.withColumn("_b", _range_no(F.col(value), points, ranges))
    before = _by(keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hist.groupBy(*keys, "_b")
        .agg(F.sum("n").alias("_m"))
        .withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .withColumn("total", F.sum("_m").over(_by(keys)))
        .drop("_m")
    )
    local = _by(keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.withColumn("_loc", F.coalesce(F.sum("n").over(local), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .withColumn("below", F.col("_off") + F.col("_loc"))
        .drop("_b", "_off", "_loc")
    )


def average_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    *,
    pct: bool = False,
    per_range: int = PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Average rank of a value in its group (nulls get none), or rank / count."""
    return average_ranks(df, keys, {value: out}, pct=pct, per_range=per_range, staged=staged)


def average_ranks(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str],
    *,
    pct: bool = False,
    per_range: int = PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Average ranks of several values, `{value: out}`, as in `average_rank`.

    A frame that needs several ranges is read again for points and counts and
    therefore written first, unless the caller has done so (`staged`). Its rows
    then move once per value, to the window of their range; the counts of the
    ranges come to them there. A value that is a point needs no more than counts.
    """
    ranges = check_groups(df, keys, per_range)
    if ranges == FITS:
        for value, out in values.items():
            up = _by(keys).orderBy(F.col(value).asc_nulls_last())
            known = F.col(value).isNotNull()
            # rank() is the first position of equal values, the running count their last.
            rank = (F.rank().over(up) + F.count(value).over(up)) / 2.0
            total = F.count(value).over(_by(keys))
            df = df.withColumn(out, F.when(known, rank / total if pct else rank))
        return df
    frame = ranked = df if staged else stage(df, "rank")
    for value, out in values.items():
        cut, lanes = _cuts(frame, value, ranges)
        sizes = cut(frame.select(*dict.fromkeys([*keys, value]))).where("_b is not null").groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
        before = _by(keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_total", F.sum("_m").over(_by(keys)))
        # One row per group, slot and lane; as a file its size is known to the join.
        offsets = stage(offsets.withColumn("_l", F.explode(F.sequence(F.lit(0), lanes - 1))), "offsets")
        up = Window.partitionBy(*keys, "_b", "_l").orderBy(value)
        ranked = cut(ranked).withColumn("_l", F.pmod(F.monotonically_increasing_id(), lanes).cast("int"))
        ranked = ranked.withColumn("_at", (F.rank().over(up) + F.count(value).over(up)) / 2.0).join(offsets, [*keys, "_b", "_l"], "left")
        rank = F.col("_off") + F.when(F.col("_b") % 2 == 1, (F.col("_m") + 1) / 2.0).otherwise(F.col("_at"))
        ranked = ranked.withColumn(out, rank / F.col("_total") if pct else rank).drop("_b", "_l", "_at", "_m", "_off", "_total")
    return ranked


def row_position(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    out: str,
    *,
    descending: bool = False,
    per_range: int = PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """1-based position by (value, tie ascending) in the group, exact and unique.

    Rows with a null value are dropped. Ranges lie between the points of the
    value; copies of one point are cut again by the tie column, null first.
    """
    known = df.where(F.col(value).isNotNull())
    ranges = check_groups(known, keys, per_range)
    order = F.col(value).desc() if descending else F.col(value).asc()
    if ranges == FITS:
        return known.withColumn(out, F.row_number().over(_by(keys).orderBy(order, F.col(tie).asc())).cast("long"))
    frame = known if staged else stage(known, "pos")
    points, ties = _points(frame, [value, tie], ranges) if value != tie else _points(frame, [value], ranges) * 2
    cut = frame.withColumn("_b", _range_no(F.col(value), points, ranges))
    equal = F.coalesce(F.try_element_at(points, F.col("_b") + 1) == F.col(value), F.lit(False))
    cut = cut.withColumn("_t", F.when(equal & F.col(tie).isNotNull(), 1 + _range_no(F.col(tie), ties, ranges)).otherwise(0)).withColumn(
        "_b", F.col("_b") * 2 + equal.cast("int"))
    first = F.col("_b").desc() if descending else F.col("_b").asc()
    before = _by(keys).orderBy(first, F.col("_t").asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_b", "_t")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .drop("_m")
    )
    local = _by(keys, "_b", "_t").orderBy(order, F.col(tie).asc())
    return (
        cut.withColumn("_loc", F.row_number().over(local))
        .join(offsets, [*keys, "_b", "_t"])
        .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
        .drop("_b", "_t", "_off", "_loc")
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, float],
    *,
    per_range: int = PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name."""
    frame = df.where(F.col(value).isNotNull())
    ranges = check_groups(frame, keys, per_range)
    if ranges == FITS:
        aggs = [F.percentile(value, F.lit(q)).alias(name) for name, q in wanted.items()]
        return frame.groupBy(*keys).agg(*aggs)
    frame = frame if staged else stage(frame.select(*keys, value), "quant")
    counts = value_counts(frame, keys, value, per_range=ranges)
    aggs = []
    for name, q in wanted.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)

        def holds(position: Column) -> Column:
            return (F.col("below") <= position) & (position < F.col("below") + F.col("n"))

        lo = F.max(F.when(holds(low), F.col(value).cast("double")))
        hi = F.max(F.when(holds(high), F.col(value).cast("double")))
        weight = F.max(at - low)
        aggs.append((lo + (hi - lo) * weight).alias(name))
    return counts.groupBy(*keys).agg(*aggs)
