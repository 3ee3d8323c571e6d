"""Candle shapes, rolling features and daily proxies.

All windows are per instrument over one row per session. Short ones are Column
builders over one window spec; those of any length are put together from blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapeloom.functions import blocks
from tapeloom.functions.guards import EPS, by_instrument, guarded, pair_corr, ratio, trailing
from tapeloom.session import spread_by


def candle_features() -> dict[str, Column]:
    """Nine candle-shape ratios and four price ratios."""
    o, h, low, c = (F.col(n) for n in ("open", "high", "low", "close"))
    spread, top, bottom = h - low + EPS, F.greatest(o, c), F.least(o, c)
    return {
        "kmid": ratio(c - o, o), "klen": ratio(h - low, o), "kmid2": (c - o) / spread,
        "kup": ratio(h - top, o), "kup2": (h - top) / spread, "klow": ratio(bottom - low, o),
        "klow2": (bottom - low) / spread, "ksft": ratio(2 * c - h - low, o), "ksft2": (2 * c - h - low) / spread,
        "open0": ratio(o, c), "high0": ratio(h, c), "low0": ratio(low, c),
        "vwap0": ratio(ratio(F.col("amount"), F.col("volume")), c),
    }


OPERATORS = ("ma", "std", "beta", "rsqr", "rsv", "imxd", "corr", "vma", "vstd", "qtlu", "qtld", "roc", "cntd", "wvma", "sumd")


def _rolled(bars: dict[str, np.ndarray], firsts: np.ndarray, sizes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The operators over windows of n rows for instruments that lie one after another.

    Each instrument with a full window begins a block of its own and is filled up
    with unknown values, so no block holds rows of two. Windows that reach back
    into another instrument end in its first rows, which get no result.
    """
    total, long = int(sizes.sum()), sizes >= n
    firsts, sizes = firsts[long], sizes[long]
    out = {f: np.full(total, np.nan) for f in OPERATORS}
    if not len(sizes):
        return out
    padded = -(-sizes // n) * n
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a row in its instrument
    given, at = np.repeat(firsts, sizes) + place, np.repeat(np.cumsum(padded) - padded, sizes) + place
    length = int(padded.sum())

    def laid(x: np.ndarray) -> np.ndarray:
        apart = np.full(length, np.nan)
        apart[at] = x[given]
        return apart

    p, v, high, low = (laid(bars[c]) for c in ("close", "volume", "high", "low"))
    w, rows = blocks.Windows(length, n), np.zeros(length)
    rows[at] = place
    before = blocks.lagged(p, 1)
    before[at[place == 0]] = np.nan
    d = p - before
    with np.errstate(invalid="ignore", divide="ignore"):
        logs = np.log(v + 1.0)
    move = np.abs(blocks.divided(p, before) - 1.0) * v
    mean, sd = w.mean_and_deviation(p)
    v_mean, v_sd = w.mean_and_deviation(v)
    m_mean, m_sd = w.mean_and_deviation(move)
    _, kk, pp, kp = w.comoments(rows, p)
    pairs, aa, bb, ab = w.comoments(p, logs)
    (top, top_at), (bottom, bottom_at) = w.top(high), w.top(-low)
    bottom = -bottom
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.sqrt(aa / pairs), np.sqrt(bb / pairs)
        whole = {
            "ma": blocks.divided(mean, p), "std": blocks.divided(sd, p), "beta": blocks.divided(blocks.divided(kp, kk), p),
            "rsqr": np.where(sd > EPS, blocks.divided(kp * kp, kk * pp), np.nan), "rsv": blocks.divided(p - bottom, top - bottom + EPS),
            "imxd": (top_at - bottom_at) / n, "corr": np.where((spread[0] > EPS) & (spread[1] > EPS), blocks.divided(ab / pairs, spread[0] * spread[1]), np.nan),
            "vma": blocks.divided(v_mean, v), "vstd": blocks.divided(v_sd, v),
            "qtlu": blocks.divided(w.quantile(p, 0.8), p), "qtld": blocks.divided(w.quantile(p, 0.2), p),
        }
        # These need the row before the window's first one.
        changes = {
            "roc": blocks.divided(blocks.lagged(p, n), p), "cntd": blocks.divided(w.sum(np.sign(d)), w.count(d)),
            "wvma": blocks.divided(m_sd, m_mean), "sumd": blocks.divided(w.sum(d), w.sum(np.abs(d))),
        }
    for need, part in ((n - 1, whole), (n, changes)):
        full = place >= need
        for f, x in part.items():
            out[f][given[full]] = x[at[full]]
    return out


def _whole_instruments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole instruments from rows in their order, and the first row of each instrument."""

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        ends = pc.run_end_encode(table.column(key).chunk(0)).run_ends.to_numpy()
        return table, np.concatenate([[0], ends[:-1]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield cut(held)
            held = []
        ends = pc.run_end_encode(batch.column(key)).run_ends
        last = ends[-2].as_py() if len(ends) > 1 else 0
        if last:
            yield cut([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(held)


def rolling_features(df: DataFrame, windows: list[int]) -> DataFrame:
    """15 rolling operators per window length; null until the window has all its rows.

    Rows are dealt by instrument and sorted by date; a task takes a batch's worth of
    whole instruments, a calendar each at most, as one set of arrays. Each window
    is put together from two partial aggregates (`blocks`), so the work per row does
    not depend on the length, and neither the level of earlier prices nor a flat
    stretch leaks in. A null inside a full window is left out: means, deviations,
    extremes and quantiles are those of the known values, pairs need both. Without
    spread, `rsqr` and `corr` are null. Of equal extremes the first counts.
    """
    names = [f"{o}{n}" for n in windows for o in OPERATORS]
    used = ("close", "volume", "high", "low")
    kept = [c for c in df.columns if c not in names]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in names)])
    given = df.select(*kept, *[F.col(c).cast("double").alias(f"_{c}") for c in used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in _whole_instruments(batches, "instrument"):
            bars = {c: table.column(f"_{c}").to_numpy().astype(float) for c in used}
            sizes = np.diff(firsts, append=table.num_rows)
            made = []
            for n in windows:
                rolled = _rolled(bars, firsts, sizes, n)
                made += [pa.array(rolled[o], pa.float64(), from_pandas=True) for o in OPERATORS]
            own = [table.column(c).chunk(0) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *made], [*kept, *names])

    rows = spread_by(given, "instrument").sortWithinPartitions(F.col("instrument"), F.col("dt").asc_nulls_last())
    return rows.mapInArrow(run, schema)


def daily_proxies(df: DataFrame) -> DataFrame:
    """Five daily proxies of intraday behaviour and nine shape/volume features."""
    w = by_instrument()
    tiny = 1e-8
    base = spread_by(df, "instrument").withColumn("_r", ratio(F.col("close"), F.lag("close").over(w)) - 1.0).withColumn(
        "_gap", ratio(F.col("open"), F.lag("close").over(w)) - 1.0).withColumn(
        "_lv", F.log(ratio(F.col("volume"), F.lag("volume").over(w)) + EPS))
    o, h, low, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    spread = h - low + tiny

    def mean(x: Column, n: int) -> Column:
        return guarded(F.avg(x), x, trailing(w, n), n)

    r = F.col("_r")
    dev = r - mean(r, 20)
    std5, std20 = (guarded(F.stddev_samp(r), r, trailing(w, n), n) for n in (5, 20))
    return base.withColumns({
        "ovn_gap": F.col("_gap"), "mom_tail5": mean(ratio(c - o, o), 5), "rng_open": ratio(h - low, o),
        "intra_vol5": std5,
        "pv_div5": F.when(F.count("_lv").over(trailing(w, 5)) >= 5, pair_corr(r, F.col("_lv"), 5, trailing(w, 5))),
        "gap_mom3": mean(F.col("_gap"), 3), "tail_str5": mean((c - o) / spread, 5), "intra_pos": (c - low) / spread,
        "vol_ratio5": v / (mean(v, 5) + tiny), "up_shadow": (h - c) / spread, "body_ratio": F.abs(c - o) / spread,
        "ret_skew20": dev * dev * dev / (std20 + tiny), "amplitude_ma5": mean(ratio(h - low, o), 5),
        "down_shadow": (F.least(o, c) - low) / spread,
    }).drop("_r", "_gap", "_lv")
