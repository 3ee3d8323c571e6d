"""Best-fit packing of tokenised documents into sequences of equal capacity.

Plan: only the number of pieces of each length goes to the driver (at most
`capacity` numbers, whatever the corpus). Long lengths come first; a gap is
filled by one, two or three pieces that fit it exactly, taken from an index of
the lengths still available; what is left goes to the fullest sequence with room.
The plan says how often each pattern of lengths is used. Each piece finds its
place from its rank among the pieces of its length, so placing needs no sort of
the corpus and no task sees more than one partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import tokens
from tapeloom.llm.text import slices, small_batches
from tapeloom.session import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(docs: DataFrame, vocabulary: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the document's ids, then id 0, cut every `capacity` ids.

    `part` is the task, `nth` counts its pieces of the same length. A null text
    is empty (the end id alone). Repeated rows are separate documents. With
    `keep_ids` the ids follow as little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.Encoder.of(vocabulary), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * keep_ids]
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode((text or b"").decode()) + bytes(4)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, int(met[length]), *[own] * keep_ids))
                    met[length] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return small_batches(given).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


class Lengths:
    """How many pieces of each length are left, with an index of their exact sums.

    Bit n of `there` is set while length n is left; `back` holds the same bits in
    reverse, so that one shift and one `and` give all pairs with a wanted sum.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.there, self.back = defaultdict(int), capacity, 0, 0
        for length, n in counts.items():
            self.take(length, -n)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] > 0:
            self.there |= 1 << length
            self.back |= 1 << (self.capacity - length)
        else:
            self.there &= ~(1 << length)
            self.back &= ~(1 << (self.capacity - length))

    def times(self, pattern: Sequence[int]) -> int:
        """How often the pattern can be built from what is left."""
        return min(self.left[x] // pattern.count(x) for x in pattern)

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Available (longer, shorter) with that sum, the longest first."""
        both = self.there & (self.back >> (self.capacity - total)) if total <= self.capacity else 0
        both = both >> (total + 1) // 2 << (total + 1) // 2
        while both:
            longer = both.bit_length() - 1
            both ^= 1 << longer
            yield longer, total - longer

    def fills(self, first: int) -> Iterator[tuple[int, ...]]:
        """Patterns that begin with a length and use the capacity exactly: two, three, then four pieces."""
        gap = self.capacity - first
        if gap == 0:
            yield (first,)
            return
        if self.there >> gap & 1:
            yield first, gap
        for pair in self.pairs(gap):
            yield first, *pair
        rest = self.there & ((1 << gap) - 1)
        while rest:
            longest = rest.bit_length() - 1
            rest ^= 1 << longest
            if 3 * longest < gap:
                return
            for a, b in self.pairs(gap - longest):
                if a <= longest:
                    yield first, longest, a, b


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ((length, pieces), ...) and how many sequences have each.

    Lengths are 1 to capacity. Every piece counted is in exactly one sequence.
    """
    lengths, out = Lengths(counts, capacity), []
    for first in range(capacity, 0, -1):
        for pattern in lengths.fills(first) if lengths.left[first] > 0 else ():
            n = lengths.times(pattern)
            if n > 0:
                for x in pattern:
                    lengths.take(x, n)
                out.append(([(x, pattern.count(x)) for x in sorted({*pattern}, reverse=True)], n))
            if lengths.left[first] <= 0:
                break
    return out + _best_fit({x: n for x, n in lengths.left.items() if n > 0}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first, each into the fullest sequence with room; equal sequences are counted, not listed."""
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: list[tuple[int, int]], n: int) -> None:
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((pattern, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, [(length, each)], n // each)
                if n % each:
                    put(capacity - n % each * length, [(length, n % each)], 1)
                break
            room = rooms[at]
            pattern, there = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            each = min(room // length, n)
            used = min(there, n // each)
            put(room - each * length, [*pattern, (length, each)], used)
            if there > used:
                put(room, pattern, there - used)
            n -= used * each
    return [x for group in bins.values() for x in group]


def slots(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces per sequence, first sequence, first offset) by first rank."""
    ranks, rows, sequence = defaultdict(int), defaultdict(list), 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows[length].append((ranks[length], each, sequence, offset))
            ranks[length] += each * n
            offset += each * length
        sequence += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds `sequence_id` and `offset` to the rows of a written table of `cut`."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = slots(plan(counts, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        pieces.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                row = where[int(length)]
                row = row[np.searchsorted(row[:, 0], ranks[own], "right") - 1]
                nth = ranks[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * length
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only `doc_id` and `text` are read; other columns are ignored. An empty table
    gives no rows.
    """
    return place(stage(cut(docs, vocabulary, capacity, keep_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from `pack(..., keep_ids=True)`: at most `capacity` ids each."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
