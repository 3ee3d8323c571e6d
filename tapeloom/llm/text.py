"""Word splitting and window hashing over Arrow batches.

Words are byte strings: `bytes.split()` cuts at exactly the ASCII white space
`[\\x20\\x09-\\x0D]`, and UTF-8 never puts an ASCII byte inside another character.
A word's hash is a 64-bit one that is the same in every process; the hash of a
window combines the hashes of two shorter windows that cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

_U = np.uint64
_LEFT, _RIGHT, _STIR = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; every other ASCII byte that is no letter or digit becomes a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class WordHashes(dict):
    """Hashes of words met before, emptied when it holds `limit` of them (memory stays bounded)."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> _U(32))) * _STIR
    x = (x ^ (x >> _U(29))) * _LEFT
    return x ^ (x >> _U(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the window that both parts cover together."""
    return mixed(left * _LEFT + mixed(right ^ _RIGHT))


def doubled(hashes: np.ndarray, width: int, target: int) -> np.ndarray:
    """Hashes of `target` words at each start, from those of `width` (target up to twice the width)."""
    if target == width:
        return hashes
    step = target - width
    return joined(hashes[:-step], hashes[step:]) if len(hashes) > step else hashes[:0]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each start; empty if there are fewer words."""
    width = 1
    while width < size and len(hashes):
        target = min(2 * width, size)
        hashes, width = doubled(hashes, width, target), target
    return hashes


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, after its session hands rows to Python in batches of about 8 MB.

    Spark's default of 64 MB is held several times per task, on both sides. A
    size that the session has set itself stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64m", "64MB"):
        conf.set(name, "8m")
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of one binary column, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if end > start:
                yield batch.slice(start, end - start)
