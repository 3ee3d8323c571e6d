"""Passages that stand in an earlier document, found by doubling the compared length.

A window is `size` words. Lengths start at `seed` words and double up to `size`.
At each length a candidate window is represented by one part of that length: the
one with the least hash of all such parts inside it, so equal windows have equal
representatives, and a long text sends few of them. Windows whose representative
stands in one document only are no candidates at the next length; the last
length compares whole windows. The search ends early when no candidate is left.

Comparing is a shuffle of packed arrays. A task sorts its hashes first and sends
each one once, with its smallest document (all its places in that document if it
needs an answer), so a passage that is in a third of all documents costs every
receiver one entry per task. Receivers answer with places; a second shuffle
brings the answers back to the unit that sent them and turns them into rows per
document.

Hashes have 64 bits. Over n different windows, a window meets a foreign one with
probability n / 2^64: 5e-9 for 10^11 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text as T
from tapeloom.session import stage

MESSAGE = "bucket long, src long, kind int, at binary, hashes binary, docs binary, flags binary"
ASK, YES, DOCUMENTS = 0, 1, 2
_LAST = np.iinfo(np.int64).max


def lengths(size: int, seed: int) -> list[int]:
    """seed, twice the seed, ... and at last the window size itself."""
    out = []
    while seed < size:
        out.append(seed)
        seed *= 2
    return [*out, size]


def packed(places: np.ndarray) -> bytes:
    """Ascending places as differences of 2 or 4 bytes."""
    steps = np.diff(places, prepend=0)
    return steps.astype("<u2" if steps.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0), dtype=np.int64)


def representatives(hashes: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """For each start the first place of the least hash among `width` places from it."""
    least, done = hashes, 1
    while done < width:
        step = min(done, width - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    target, place = least[starts], np.full(len(starts), -1, np.int64)
    for k in range(width):
        hit = (place < 0) & (hashes[starts + k] == target)
        place[hit] = starts[hit] + k
    return place


def _messages(src: int, buckets: int, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, last: bool) -> Iterator[tuple]:
    """What one unit sends: questions by bucket, and the places it can answer itself."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return
    n = np.diff(np.append(first, len(h)))
    least, most = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
    several = np.repeat(least != most, n)
    if last:
        known, ask = d > np.repeat(least, n), d == np.repeat(least, n)
    else:
        known, ask = several, ~several
        ask[first] = True
    yes = np.sort(order[known])
    yield src % buckets, src, YES, packed(places[yes]), np.array([len(yes)], "<i8").tobytes(), None, None
    flag = np.zeros(len(h), np.uint8)
    flag[order] = several
    sent = np.sort(order[ask])
    bucket = (hashes[sent] % np.uint64(buckets)).astype(np.int64)
    sent = sent[np.argsort(bucket, kind="stable")]
    edges = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = sent[edges[k] : edges[k + 1]]
        yield int(k), src, ASK, packed(places[own]), hashes[own].tobytes(), docs[own].tobytes(), flag[own].tobytes()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _send(rows: DataFrame, size: int, length: int, before: int | None, buckets: int, unit: int) -> DataFrame:
    """Messages of all units: `rows` has doc_id, key, text and, after the first length, the places that are still alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, number = T.WordHashes(), TaskContext.get().partitionId(), 0
        parts: list[tuple] = []
        offset, held = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, offset, held, number
            src, number = part << 24 | number, number + 1
            ids, known, keys, starts, hashes, docs, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = [(src % buckets, src, DOCUMENTS, starts.tobytes(), keys.tobytes(), ids.tobytes(), known.tobytes())]
            out += _messages(src, buckets, hashes, docs, places, length == size)
            parts, offset, held = [], 0, 0
            for k in range(0, len(out), 64):
                yield _table(out[k : k + 64])

        for batch in T.slices(batches, "text"):
            texts = [(t or b"").split() for t in batch.column("text").to_pylist()]
            counts = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(counts)
            hashes = cache.of([w for t in texts for w in t])
            starts = np.flatnonzero(np.arange(len(hashes)) <= np.repeat(ends - size, counts))
            if before is not None:
                alike = np.zeros(len(hashes) + 1, bool)
                for end, n, at in zip(ends, counts, batch.column("at").to_pylist(), strict=True):
                    alike[np.frombuffer(at, "<i4") + (end - n)] = True
                starts = starts[alike[representatives(T.windows(hashes, before), size - before + 1, starts)]]
            found = T.windows(hashes, length)
            places = starts if length == size or not len(starts) else np.unique(representatives(found, size - length + 1, starts))
            ids = batch.column("doc_id")
            known = np.array([x.is_valid for x in ids], np.uint8)
            numbers = np.array(ids.fill_null(_LAST), np.int64)
            row = np.searchsorted(ends, places, "right")
            parts.append((numbers, known, np.array(batch.column("key"), np.int64), ends - counts + offset, found[places], numbers[row], places + offset))
            offset, held = offset + len(hashes), held + len(places)
            if held >= unit or offset >= 1 << 30:
                yield from flush()
        if parts:
            yield from flush()

    return rows.mapInArrow(run, MESSAGE)


def _answer(last: bool):
    """Receiver of one bucket: the places of each unit that are also elsewhere (at the last length: earlier)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asks = [r for r in rows if r["kind"] == ASK]
        out = [tuple(r.values()) for r in rows if r["kind"] != ASK]
        if asks:
            hashes, docs, flags = (np.concatenate([np.frombuffer(r[c], k) for r in asks]) for c, k in (("hashes", "<u8"), ("docs", "<i8"), ("flags", "u1")))
            order = np.argsort(hashes, kind="stable")
            h, d = hashes[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            least = np.repeat(np.minimum.reduceat(d, first), n)
            if last:
                found = d > least
            else:
                found = (np.repeat(np.maximum.reduceat(d, first), n) > least) | np.repeat(np.maximum.reduceat(flags[order], first) > 0, n)
            yes, at = np.zeros(len(h), bool), 0
            yes[order] = found
            for r in asks:
                count = len(r["hashes"]) // 8
                places = unpacked(r["at"], count)[yes[at : at + count]]
                at += count
                if len(places):
                    out.append((r["src"], r["src"], YES, packed(places), np.array([len(places)], "<i8").tobytes(), None, None))
        return pa.Table.from_batches([_table(out)])

    return run


def _gather(table: pa.Table) -> pa.Table:
    """Answers of one unit as rows per document: its places, counted from its first word."""
    rows = table.to_pylist()
    unit = next(r for r in rows if r["kind"] == DOCUMENTS)
    starts, keys, ids = (np.frombuffer(unit[c], "<i8") for c in ("at", "hashes", "docs"))
    known = np.frombuffer(unit["flags"], "u1")
    places = [unpacked(r["at"], int.from_bytes(r["hashes"], "little")) for r in rows if r["kind"] == YES]
    places = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    # Documents without words share a start with the next one; the last of them owns the places.
    row = np.searchsorted(starts, places, "right") - 1
    edges = np.flatnonzero(np.diff(row, prepend=-1))
    spans = list(zip(edges, np.append(edges, len(row))[1:], strict=True))
    owner = row[edges]
    return pa.table({
        "doc_id": pa.array([int(ids[k]) if known[k] else None for k in owner], pa.int64()), "key": pa.array(keys[owner], pa.int64()),
        "at": pa.array([(places[a:b] - starts[k]).astype("<i4").tobytes() for k, (a, b) in zip(owner, spans, strict=True)], pa.binary()),
    })


def bucket_count(docs: DataFrame, bucket_bytes: int) -> int:
    """Buckets for the hashes of all texts: a receiver gets those of about `bucket_bytes` of text.

    A word has a byte and a separator at least, so a bucket expects at most half
    as many hashes, whatever the size of the table.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(4 * partitions, -(-size // bucket_bytes))


def repeats(docs: DataFrame, size: int = 13, seed: int = 7, unit: int = 4_000_000, bucket_bytes: int = 24_000_000) -> DataFrame:
    """(doc_id, key, at): starts of windows that also start in a document with a smaller doc_id.

    `docs` has doc_id, key and text as bytes; `key` tells rows with the same
    doc_id and different texts apart. `at` holds 32-bit word numbers. Only
    documents with such windows have a row. A null doc_id counts as larger than
    all others. `unit` is how many hashes a task compares at once, `bucket_bytes`
    the text whose hashes one receiver holds (`bucket_count`).
    """
    buckets = bucket_count(docs, bucket_bytes)
    found, before = None, None
    for length in lengths(size, seed):
        rows = docs if found is None else with_places(docs, found, "inner")
        asked = _send(rows, size, length, before, buckets, unit)
        answered = asked.groupBy("bucket").applyInArrow(_answer(length == size), MESSAGE)
        rows = answered.drop("bucket").groupBy("src").applyInArrow(_gather, "doc_id long, key long, at binary")
        found, before = stage(rows.groupBy("doc_id", "key").agg(F.first("at").alias("at")), "repeats"), length
        if length < size and found.isEmpty():
            break
    return found


def with_places(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["key"] == found["key"])
    return docs.join(found, same, how).select(docs["doc_id"], docs["key"], docs["text"], found["at"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text as bytes."""
    return T.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))


def remove(docs: DataFrame, size: int = 13, seed: int = 7, with_text: bool = False) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the digest of the kept words (and their text).

    A word goes if a window that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. A null or empty text has no
    words. Rows with the same doc_id are not earlier than each other. Other
    columns are ignored; an empty table gives no rows.
    """
    given = keyed(docs)
    joined = with_places(given, repeats(given, size, seed), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            n_words, n_removed, digest, kept = [], [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if at:
                    starts = np.frombuffer(at, "<i4")
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + size, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                kept += [left.decode()] * with_text
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), *[pa.array(kept, pa.string())] * with_text]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM d WHERE len(words) >= 13)),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY win) AS earliest FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM m WHERE earliest < doc_id),
left_words AS (
  SELECT p.doc_id, count(g.k) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.k) FILTER (WHERE g.k IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.k = p.k GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_words USING (doc_id)"""
