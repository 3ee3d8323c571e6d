"""Benchmark decontamination: words of documents inside windows of benchmark items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased. A window is `size` consecutive words of an item; an item
with fewer words, but not none, is one window. The windows go to every task as a
hash set of bounded size: a benchmark with more than `block_windows` of them is
cut into blocks, and the corpus is scanned once for each. A hash that meets the
set is held against the words themselves, so there are no false hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text as T
from tapeloom.llm.apart import set_apart
from tapeloom.session import stage

_WORD = re.compile(rb"\S+")
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, width, words): the windows of each item, as blank-separated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or b"").translate(T.ALNUM).split()
                width = min(size, len(words))
                rows += {(item, width, b" ".join(words[k : k + width])) for k in range(len(words) - width + 1 if words else 0)}
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "width", "words"])

    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "item_id long, width int, words binary").distinct()


class WindowSet:
    """Windows of one block with their items, and their hashes by width."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[int]] = defaultdict(list)
        widths: dict[int, list[bytes]] = defaultdict(list)
        for item, width, words in rows:
            if words not in self.items:
                widths[width].append(words)
            self.items[words].append(item)
        self.items, hashes = dict(self.items), T.WordHashes()
        self.hashes, self.there = {}, {}
        for width, all_words in sorted(widths.items()):
            one = [T.windows(hashes.of(w.split(b" ")), width)[0] for w in all_words]
            self.hashes[width] = np.unique(np.array(one, np.uint64))
            self.there[width] = np.zeros(1 << 20, bool)
            self.there[width][(self.hashes[width] >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, starts) whose hash is in the set."""
        for width, known in self.hashes.items():
            found = T.windows(hashes, width)
            at = np.flatnonzero(self.there[width][(found >> np.uint64(44)).view(np.int64)])
            yield width, at[np.isin(found[at], known)]


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(last, out[-1]["last"])
        else:
            out.append({"first": first, "last": last})
    return out


def without_hits(raw: bytes | None, hits: list[dict[str, int]]) -> bytes | None:
    """The text without its hit words and what stands between them."""
    if not raw or not hits:
        return raw
    words, out, at = [m.span() for m in _WORD.finditer(raw.translate(T.ALNUM))], [], 0
    for span in hits:
        out.append(raw[at : words[span["first"]][0]])
        at = words[span["last"] - 1][1]
    return b"".join([*out, raw[at:]])


def _scan(docs: DataFrame, windows: WindowSet, kept: list[str], most_hit: float | None = None) -> DataFrame:
    """Adds what one block of windows hits to `hits` and `items`, or cuts it out if `most_hit` is given."""
    shared_windows = docs.sparkSession.sparkContext.broadcast(windows)
    fresh = "hits" not in docs.columns
    own = [c for c in kept if c not in ("n_words", "hits", "items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cache = shared_windows.value, T.WordHashes()
        for batch in T.slices(batches, "text"):
            raw = batch.column("text").to_pylist()
            texts = [(t or b"").translate(T.ALNUM).split() for t in raw]
            words = [w for t in texts for w in t]
            ends = np.cumsum([len(t) for t in texts])
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            for width, starts in block.candidates(cache.of(words)):
                rows = np.searchsorted(ends, starts, "right")
                for start, row in zip(starts.tolist(), rows.tolist(), strict=True):
                    found = block.items.get(b" ".join(words[start : start + width])) if start + width <= ends[row] else None
                    if found:
                        first = start - (int(ends[row]) - len(texts[row]))
                        spans[row].append((first, first + width))
                        items[row].update(found)
            if not fresh:
                for row, (old, ids) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    spans[row] += [(x["first"], x["last"]) for x in old]
                    items[row].update(ids)
            every = range(batch.num_rows)
            hits = [_merged(spans[k]) if k in spans else [] for k in every]
            if most_hit is not None:
                share = [sum(h["last"] - h["first"] for h in hits[k]) <= most_hit * len(texts[k]) for k in every]
                cut = pa.array([without_hits(raw[k], hits[k]) for k in every], pa.binary())
                whole = pa.RecordBatch.from_arrays([cut if c == "text" else batch.column(c) for c in own], own)
                yield whole.filter(pa.array(share, pa.bool_()))
                continue
            made = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(hits, _SPANS),
                pa.array([sorted(items[k], key=lambda x: (x is None, x)) if k in items else [] for k in every], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], [*own, "n_words", "hits", "items"])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in own)
    if most_hit is not None:
        return docs.mapInArrow(run, schema.removesuffix(", "))
    return docs.mapInArrow(run, f"{schema}n_words long, hits array<struct<first:int,last:int>>, items array<long>")


def _scanned(docs: DataFrame, items: DataFrame, size: int, wanted: list[str], block_windows: int, most_hit: float | None) -> DataFrame:
    """One scan per block of windows; every scan but the last is written, so that one set is in memory at a time."""
    windows = stage(item_windows(items, size), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    docs = T.small_batches(docs.select(*[F.col(c) for c in wanted if c != "text"], F.col("text").cast("binary").alias("text")))
    all_columns = docs.columns
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("item_id", "width", "words")
        block = WindowSet([(r.item_id, r.width, bytes(r.words)) for r in own.collect()])
        if k < blocks - 1:
            docs = stage(_scan(docs, block, all_columns), "scan")
        else:
            docs = _scan(docs, block, wanted, most_hit)
    return docs.withColumn("text", F.col("text").cast("string")) if "text" in wanted else docs


def find(docs: DataFrame, items: DataFrame, size: int = 10, *, columns: list[str] | None = None, block_windows: int = 100_000) -> DataFrame:
    """The asked columns (all by default) with n_words, `hits` and `items`.

    `hits` are the merged word ranges [first, last) inside any occurrence of a
    window, `items` the ids with an occurring window. A null text, here or in
    the items, has no words. Columns of the same names are replaced. An empty
    benchmark hits nothing; repeated rows are judged one by one.
    """
    wanted = [c for c in (columns or docs.columns) if c not in ("n_words", "hits", "items")]
    return _scanned(docs, items, size, wanted, block_windows, None)


def remove(docs: DataFrame, items: DataFrame, size: int = 10, *, most_hit: float = 0.5, block_windows: int = 100_000) -> DataFrame:
    """The documents without their hit words; those with more than `most_hit` of their words hit go.

    Has the columns of `docs`, whatever their names; `n_chars`, if there is one,
    follows the new text.
    """
    given, restored = set_apart(docs)
    out = _scanned(given, items, size, given.columns, block_windows, most_hit)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return restored(out.select(given.columns))


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items per document, from the rows of `find`."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
items AS (SELECT item_id, words, least(10, len(words)) AS width FROM b WHERE len(words) > 0),
known AS (SELECT DISTINCT item_id, width, array_to_string(words[k:k + width - 1], ' ') AS win
  FROM (SELECT item_id, words, width, unnest(range(1, len(words) - width + 2)) AS k FROM items)),
places AS (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS k
  FROM d, (SELECT DISTINCT width FROM known) WHERE len(words) >= width),
hits AS (SELECT p.doc_id, p.k, p.width, n.item_id FROM places p
  JOIN known n ON n.width = p.width AND n.win = array_to_string(p.words[p.k:p.k + p.width - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS w FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""
