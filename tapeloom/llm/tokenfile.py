"""Token-id files: shards of ids, each compressed by a grammar of its own.

Pairs of ids that are frequent in a shard are replaced by new symbols, round by
round (Re-Pair); pairs never reach over the end of a document, so each document
is a run of symbols that can be read and expanded alone. A shard holds about
`shard_ids` ids: memory is bounded, and a file stays small enough for one task.

File: the ten numbers of `HEAD` as unsigned 64-bit integers, then arrays:
rules (two symbols each, uint32), their expansion lengths (uint32), document ids
(int64) with a byte each that is 0 for null, the first symbol and the first id
of each document and of the end (uint64), and the symbols (uint16, or uint32
where there are more than 65,536 different ones). All little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import shared, tokens
from tapeloom.llm.text import slices, small_batches
from tapeloom.session import scratch_path, stage

MAGIC = 0x31305247_52494150
HEAD = ("magic", "documents", "ids", "terminals", "rules", "symbols", "width", "reserved0", "reserved1", "reserved2")
MANIFEST = "part int, shard int, path string, documents long, ids long, symbols long, rules long"
_TABLE = 1 << 20


def repair(ids: np.ndarray, starts: np.ndarray, terminals: int, rounds: int, max_rules: int, least: int) -> tuple:
    """(symbols, first symbol of each document, rules): pairs seen `least` times or more become symbols.

    A round counts every pair of the shard in a hashed table of its size, and
    replaces the most frequent ones from left to right, at most `max_rules` in
    all rounds together.
    """
    seq, starts, rules = ids.astype(np.int64), starts.copy(), np.zeros((0, 2), np.int64)
    for done in range(rounds):
        room = (max_rules - len(rules)) // (rounds - done)
        if len(seq) < 2 or room < 1:
            break
        key = (seq[:-1] << 32) | seq[1:]
        inner = np.ones(len(key), bool)
        ends = starts[1:-1]
        inner[ends[(ends > 0) & (ends < len(seq))] - 1] = False
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        owner = np.full(_TABLE, -1, np.int64)
        owner[slot[inner]] = key[inner]
        inner &= owner[slot] == key
        count = np.bincount(slot[inner], minlength=_TABLE)
        best = np.flatnonzero(count >= least)
        if not len(best):
            break
        if len(best) > room:
            best = best[np.argpartition(-count[best], room - 1)[:room]]
        symbol = np.full(_TABLE, -1, np.int64)
        symbol[best] = terminals + len(rules) + np.arange(len(best))
        rules = np.concatenate([rules, np.stack([owner[best] >> 32, owner[best] & 0xFFFFFFFF], 1)])
        at = np.flatnonzero(inner & (symbol[slot] >= 0))
        if not len(at):
            break
        # In a run of overlapping pairs every other one is replaced.
        order = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, order, 0))
        at = at[(order - first) % 2 == 0]
        seq[at] = symbol[slot[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        starts = starts - np.searchsorted(at + 1, starts)
    return seq, starts, rules


def write_shard(path: str, doc_ids: list, ids: np.ndarray, starts: np.ndarray, terminals: int, rounds: int, max_rules: int, least: int) -> tuple[int, int]:
    """Writes one file; returns how many symbols and rules it has."""
    terminals = max(terminals, int(ids.max(initial=0)) + 1)
    symbols, firsts, rules = repair(ids, starts, terminals, rounds, max_rules, least)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    sizes = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        sizes[terminals + k] = sizes[a] + sizes[b]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = [MAGIC, len(doc_ids), len(ids), terminals, len(rules), len(symbols), width, 0, 0, 0]
    with shared.writer(path) as out:
        for array in (
            np.array(head, "<u8"), rules.astype("<u4"), sizes[terminals:].astype("<u4"),
            np.array([x or 0 for x in doc_ids], "<i8"), known, firsts.astype("<u8"), starts.astype("<u8"),
            symbols.astype(f"<u{width}"),
        ):
            out.write(array.tobytes())
    return len(symbols), len(rules)


class Shard:
    """One file, open for reading any of its documents."""

    def __init__(self, stream):
        self.stream = stream
        self.head = dict(zip(HEAD, self._array("<u8", len(HEAD)).tolist(), strict=True))
        if self.head["magic"] != MAGIC:
            raise ValueError("not a token-id file")
        n, rules, self.base = self.head["documents"], self.head["rules"], self.head["terminals"]
        self.rules = self._array("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = self._array("<u4", rules)
        ids, known = self._array("<i8", n).tolist(), self._array("u1", n)
        self.doc_ids = [x if k else None for x, k in zip(ids, known, strict=True)]
        self.firsts, self.starts = (self._array("<u8", n + 1).astype(np.int64) for _ in range(2))
        self.origin = stream.tell()
        self.kind = np.dtype(f"<u{self.head['width']}")
        self._expand()

    def _array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.stream.read(n * np.dtype(kind).itemsize), kind)

    def _expand(self) -> None:
        """The ids of every rule in one array; a terminal lies at its own number."""
        parts: list[bytes] = []
        for a, b in self.rules.tolist():
            parts.append(b"".join(x.to_bytes(4, "little") if x < self.base else parts[x - self.base] for x in (a, b)))
        self.flat = np.concatenate([np.arange(self.base, dtype="<u4"), np.frombuffer(b"".join(parts), "<u4")])
        self.length = np.concatenate([np.ones(self.base, np.int64), self.sizes.astype(np.int64)])
        self.place = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.sizes.astype(np.int64)) - self.sizes])

    def documents(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents from first up to, not with, last."""
        self.stream.seek(self.origin + int(self.firsts[first]) * self.kind.itemsize)
        symbols = self._array(self.kind, int(self.firsts[last] - self.firsts[first]))
        sizes = self.length[symbols]
        end = np.cumsum(sizes)
        shift = np.repeat(self.place[symbols] - end + sizes, sizes)
        return self.flat[shift + np.arange(len(shift))]


def write(docs: DataFrame, vocabulary: str, terminals: int, *, shard_ids: int = 2_000_000, rounds: int = 4, max_rules: int = 15_000, least: int = 4) -> DataFrame:
    """Encodes every text, appends id 0, and writes the shards in ascending doc_id order.

    Returns the written table of files. Null doc_ids come first, equal ones
    follow each other by text (null first), each as a document; a null text is
    the end id alone. An empty table writes no file. `terminals` is the size of
    the vocabulary, `least` how often a pair must occur to become a symbol.
    """
    folder = scratch_path(docs.sparkSession, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.Encoder.of(vocabulary), TaskContext.get().partitionId()
        shard, doc_ids, parts, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, doc_ids, parts, held
            starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
            path = shared.new_file(folder, f"part-{part:06d}-{shard:06d}", ".ids")
            symbols, rules = write_shard(path, doc_ids, np.frombuffer(b"".join(parts), "<u4"), starts, terminals, rounds, max_rules, least)
            row = {"part": part, "shard": shard, "path": path, "documents": len(doc_ids), "ids": held, "symbols": symbols, "rules": rules}
            shard, doc_ids, parts, held = shard + 1, [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(encoder.encode((text or b"").decode()) + bytes(4))
                held += len(parts[-1]) // 4
                if held >= shard_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = small_batches(given).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, MANIFEST), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds `first_id`, the ids before each file: by task (one row each), then by file inside the task."""
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("part").agg(F.sum("ids").alias("n"))
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"))
    own = files.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return own.join(tasks, "part").withColumn("first_id", F.col("before") + F.col("own")).drop("before", "own")


def read(files: DataFrame, block_ids: int = 500_000, keep_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first_id in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                with shared.reader(path) as stream:
                    shard = Shard(stream)
                    total, first = len(shard.doc_ids), 0
                    while first < total:
                        last = int(np.searchsorted(shard.starts, shard.starts[first] + block_ids, "right")) - 1
                        last = min(max(last, first + 1), total)
                        data, starts = shard.documents(first, last).tobytes(), shard.starts[first : last + 1]
                        cuts = ((starts - starts[0]) * 4).tolist()
                        own = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                        columns = [
                            pa.array(shard.doc_ids[first:last], pa.int64()), pa.array(starts[:-1] + first_id),
                            pa.array(np.diff(starts)), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                            *[pa.array(own, pa.binary())] * keep_ids,
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names)
                        first = last

    todo = with_starts(files).select("path", "first_id").repartition(n, "path")
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
