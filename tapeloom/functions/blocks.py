"""Aggregates over the last n rows by two partial aggregates per row.

A column is cut into blocks of n rows. Every window of n rows is the end of one
block and the beginning of the next, so one running aggregate from each block's
first row on and one from its last row back are all that is needed: two steps per
row, however long the window. Running values start anew in each block, so nothing
from outside the window takes part and no value is ever subtracted again. Unknown
values (NaN) are left out. Rows before the first full window give NaN or 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


class Windows:
    """Windows of n rows over columns of one length."""

    def __init__(self, rows: int, n: int):
        self.rows, self.n, self.blocks = rows, n, -(-rows // n)
        last = np.arange(n - 1, rows)
        self.last, self.first = last, last - n + 1
        self.whole = self.first % n == 0

    def _cut(self, x: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate([x, np.full(self.blocks * self.n - self.rows, fill)]).reshape(self.blocks, self.n)

    def _full(self, values: np.ndarray, fill: float = np.nan) -> np.ndarray:
        out = np.full(self.rows, fill)
        out[self.n - 1 :] = values
        return out

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the two parts of each window; the second is 0 where one block is the window."""
        cut = self._cut(x, 0.0)
        head = cut.cumsum(axis=1).ravel()[self.last]
        tail = cut[:, ::-1].cumsum(axis=1)[:, ::-1].ravel()[self.first]
        return tail, np.where(self.whole, 0.0, head)

    def count(self, x: np.ndarray) -> np.ndarray:
        return self._full(sum(self._parts((~np.isnan(x)).astype(float))), 0.0)

    def sum(self, x: np.ndarray) -> np.ndarray:
        """NaN where nothing is known."""
        n = self.count(x)
        return np.where(n > 0, self._full(sum(self._parts(np.nan_to_num(x)))), np.nan)

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row, a known value of its block: the last one (for ends of blocks) and the first one (for beginnings)."""
        cut = self._cut(x, np.nan)
        known = ~np.isnan(cut)
        first, last = known.argmax(axis=1), self.n - 1 - known[:, ::-1].argmax(axis=1)
        rows = np.arange(self.blocks)
        return tuple(np.repeat(np.nan_to_num(cut[rows, k]), self.n)[: self.rows] for k in (last, first))

    def comoments(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count and sums of (x - mean)^2, (y - mean)^2 and their product over rows where both are known."""
        both = ~(np.isnan(x) | np.isnan(y))
        x, y = np.where(both, x, np.nan), np.where(both, y, np.nan)
        sides = []
        for side, (rx, ry) in enumerate(zip(self._near(x), self._near(y), strict=True)):
            # Differences to a value of the same part keep their digits, whatever the level.
            dx, dy = np.nan_to_num(x - rx), np.nan_to_num(y - ry)
            n, sx, sy, sxx, syy, sxy = (self._parts(v)[side] for v in (both.astype(float), dx, dy, dx * dx, dy * dy, dx * dy))
            at = self.first if side == 0 else self.last
            with np.errstate(invalid="ignore", divide="ignore"):
                mx, my = np.nan_to_num(sx / n), np.nan_to_num(sy / n)
            sides.append((n, rx[at] + mx, ry[at] + my, sxx - sx * mx, syy - sy * my, sxy - sx * my))
        (n1, x1, y1, xx1, yy1, xy1), (n2, x2, y2, xx2, yy2, xy2) = sides
        n = n1 + n2
        with np.errstate(invalid="ignore", divide="ignore"):
            w = np.nan_to_num(n1 * n2 / n)
        dx, dy = x2 - x1, y2 - y1
        xx, yy, xy = xx1 + xx2 + w * dx * dx, yy1 + yy2 + w * dy * dy, xy1 + xy2 + w * dx * dy
        return self._full(n, 0.0), self._full(np.maximum(xx, 0.0)), self._full(np.maximum(yy, 0.0)), self._full(xy)

    def mean_and_deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean, and sample deviation (NaN below two known values)."""
        n, squares, _, _ = self.comoments(x, x)
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.sum(x) / n, np.sqrt(np.where(n > 1, squares / (n - 1), np.nan))

    def top(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest known value and the place of the first such row (the window's first row if none is known)."""
        x = np.where(np.isnan(x), -np.inf, x)
        cut, at = self._cut(x, -np.inf), self._cut(np.arange(self.rows, dtype=float), 0.0)
        head = np.maximum.accumulate(cut, axis=1)
        fresh = np.concatenate([np.ones((self.blocks, 1), bool), cut[:, 1:] > head[:, :-1]], axis=1)
        head_at = np.maximum.accumulate(np.where(fresh, at, -1.0), axis=1)
        back = cut[:, ::-1]
        tail = np.maximum.accumulate(back, axis=1)
        fresh = np.concatenate([np.ones((self.blocks, 1), bool), back[:, 1:] >= tail[:, :-1]], axis=1)
        tail_at = np.minimum.accumulate(np.where(fresh, at[:, ::-1], np.inf), axis=1)
        a, a_at = tail[:, ::-1].ravel()[self.first], tail_at[:, ::-1].ravel()[self.first]
        b, b_at = head.ravel()[self.last], head_at.ravel()[self.last]
        later = ~self.whole & (b > a)
        value, place = np.where(later, b, a), np.where(later, b_at, a_at)
        return self._full(np.where(np.isinf(value), np.nan, value)), self._full(np.where(np.isinf(value), self.first, place))

    def quantile(self, x: np.ndarray, q: float) -> np.ndarray:
        """Linear quantile of the known values, from an ordered list that gains one value and loses one per row."""
        return self._full(pd.Series(x).rolling(self.n, min_periods=1).quantile(q).to_numpy()[self.n - 1 :])


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0 or either is unknown."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(b == 0, np.nan, a / b)


def lagged(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])
