"""Near-duplicate classes by an inverted join of MinHash coordinates, confirmed on full sets.

1. Every text becomes the set of its word shingles, a digest of that set and a
   signature of `COORDINATES` minima. Texts with one set collapse to the one with
   the smallest doc_id; only these representatives go on.
2. Two sets of similarity 0.8 or more share at least `MATCHES` of 64 coordinates,
   but for one pair in 10^7 that lies exactly at 0.8. So they share one of any
   64 - MATCHES + 1 of them, if both use the same order: each representative is
   posted under that many (coordinate, value) pairs, the rarest first. The order
   comes from a sketch of 65,536 counters over all signatures. Values that very
   many texts share are thereby skipped, unless these texts are alike throughout.
3. Inside a list, collisions of whole signatures are counted. Representatives
   that reach each other over pairs with `MATCHES` collisions form a candidate
   group, kept as a tree: a list emits fewer links than it has members. Lists and
   groups beyond a block are compared block against block, in tasks of bounded
   size.
4. Groups are confirmed on full sets: from each member, all others not reached
   yet are counted over an inverted index of the group, so every pair across
   different classes is compared exactly and every link inside a class is either
   checked or implied.

Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text as T
from tapeloom.llm.components import components
from tapeloom.session import stage

COORDINATES, MATCHES = 64, 33
PREFIX = COORDINATES - MATCHES + 1
CELLS = 1 << 16

# Odd multipliers, one per coordinate, from one fixed seed.
_FACTORS = np.random.default_rng(20_240_229).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = T.mixed(_FACTORS)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer words than `size` are one shingle."""
    return np.unique(T.windows(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of coordinate values per non-empty set; values of different coordinates differ."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k], starts)
    return T.mixed(out ^ _SALTS)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n_shingles, set_digest and signature of every text (both null without words)."""
    names = ["doc_id", "key", "n_shingles", "set_digest", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = T.WordHashes()
        for batch in T.slices(batches, "text", 2 << 20):
            sets = [shingle_set(cache.of((t or b"").translate(T.LOWER).split()), size) for t in batch.column("text").to_pylist()]
            there = [s for s in sets if len(s)]
            rows = iter(signatures(there) if there else [])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            values = [next(rows).tobytes() if len(s) else None for s in sets]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], names)

    return docs.mapInArrow(run, "doc_id long, key long, n_shingles long, set_digest binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, COORDINATES)


def _cell(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(48)).astype(np.int64)


def sketch(reps: DataFrame) -> np.ndarray:
    """How many coordinate values fall into each of `CELLS` cells; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            seen += np.bincount(_cell(_matrix(batch.column("signature")).ravel()), minlength=CELLS)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in reps.select("signature").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def postings(reps: DataFrame) -> DataFrame:
    """(value, rep): each representative under its rarest coordinate values."""
    counts = reps.sparkSession.sparkContext.broadcast(sketch(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("signature"))
            order = np.lexsort((values, counts.value[_cell(values)]), axis=1)[:, :PREFIX]
            chosen = np.take_along_axis(values, order, 1)
            owners = np.repeat(np.array(batch.column("rep"), np.int64), PREFIX)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().view(np.int64)), pa.array(owners)], ["value", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "value long, rep long")


def _blocked(rows: DataFrame, blocks: Column) -> DataFrame:
    """One copy of each row per pair of blocks of its group that holds it (`pair`); one block is one pair."""
    own = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    last = F.col("_n") - 1
    pairs = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), last), lambda k: k != own), lambda k: F.least(k, own) * F.col("_n") + F.greatest(k, own)))
    return rows.withColumn("_n", blocks.cast("int")).withColumn("pair", F.explode(pairs)).drop("_n")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[tuple[list, pa.Table]]:
    """Runs of whole (key, pair) groups from sorted rows: the rows, and where each group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = [np.array(rows[k], np.int64) for k in keys]
        change = np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0)) + 1
        if len(change):
            yield change.tolist(), rows.slice(0, change[-1])
            held = rows.slice(change[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = [np.array(rows[k], np.int64) for k in keys]
        change = np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0)) + 1
        yield [*change.tolist(), len(rows)], rows


def _trees(labels: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each class's members to its smallest one."""
    order = np.lexsort((reps, labels))
    first = np.concatenate([[True], np.diff(labels[order]) != 0])
    root = reps[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    other = root != reps[order]
    return reps[order][other], root[other]


def reached(n: int, near) -> np.ndarray:
    """Class number of n members; `near(x, open)` gives the members of `open` that are linked to x."""
    label, left, classes = np.full(n, -1), np.arange(n), 0
    while len(left):
        label[left[0]], work, left = classes, [left[0]], left[1:]
        while work and len(left):
            found = near(work.pop(), left)
            if found.any():
                label[left[found]] = classes
                work += left[found].tolist()
                left = left[~found]
        classes += 1
    return label


def _links_of(rows: DataFrame, key: str, links) -> DataFrame:
    """Runs `links(table of one group)` over all groups of (key, pair): rows (a, b)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends, table in _groups(batches, (key, "pair")):
            found, start = [], 0
            for end in ends:
                if end - start > 1:
                    found.append(links(table.slice(start, end - start)))
                start = end
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition(n, key, "pair").sortWithinPartitions(key, "pair").mapInArrow(run, "a long, b long")


def _collisions(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Trees of the members of one list that collide in `MATCHES` coordinates; values are compared by their low byte."""
    reps = np.array(table["rep"], np.int64)
    values = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
    if len(reps) == 2:
        near = (values[0] == values[1]).sum() >= MATCHES and reps[0] != reps[1]
        return (reps.max(keepdims=True), reps.min(keepdims=True)) if near else (reps[:0], reps[:0])
    return _trees(reached(len(reps), lambda x, left: (values[left] == values[x]).sum(1) >= MATCHES), reps)


def candidates(reps: DataFrame, list_block: int = 2048) -> DataFrame:
    """Links (a, b) whose components are the candidate groups."""
    posted = stage(postings(reps), "postings")
    # Sizes are written first: a join with an aggregate of its own key could not split a long list.
    lists = stage(posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    members = posted.join(lists, "value")

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _matrix(batch.column("signature")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([r.tobytes() for r in made], pa.binary())], ["rep", "low"])

    lows = reps.select("rep", "signature").mapInArrow(low, "rep long, low binary")
    rows = _blocked(members.join(lows, "rep"), F.ceil(F.col("n") / list_block))
    return _links_of(rows.select("value", "pair", "rep", "low"), "value", _collisions)


def classes(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """Class numbers of sets that reach each other over pairs of that similarity (in hundredths)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, int(100 * both < similarity * (sizes.sum() - both))])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    index = {"n": -1}

    def build(left: np.ndarray) -> None:
        """Owners by shingle, for the members not reached yet."""
        there = np.zeros(len(sets), bool)
        there[left] = True
        kept = there[owner]
        order = np.argsort(shingle[kept], kind="stable")
        index.update(n=len(left), owners=owner[kept][order], edges=np.searchsorted(shingle[kept][order], np.arange(shingle.max() + 2)))

    def near(x: int, left: np.ndarray) -> np.ndarray:
        if 2 * len(left) < index["n"] or index["n"] < 0:
            build(left)
        own = shingle[ends[x] - sizes[x] : ends[x]]
        first, n = index["edges"][own], np.diff(index["edges"])[own]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(index["owners"][at], minlength=len(sets))[left]
        return 100 * both >= similarity * (sizes[left] + sizes[x] - both)

    return reached(len(sets), near)


def confirmed(docs: DataFrame, groups: DataFrame, size: int, similarity: int, block_shingles: int = 1_000_000) -> DataFrame:
    """Links (a, b) over full sets. `groups`: rep, key, n_shingles, group."""
    groups = stage(groups, "groups")
    totals = stage(groups.groupBy("group").agg(F.sum("n_shingles").alias("n")), "totals")
    rows = _blocked(groups.join(totals, "group"), F.ceil(F.col("n") / block_shingles)).select("group", "pair", "rep", "key")
    texts = docs.join(rows, (docs["doc_id"] == rows["rep"]) & (docs["key"] == rows["key"])).select("group", "pair", "rep", rows["key"], "text")

    def links(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # A row that is in the documents twice comes twice; one is enough.
        known = dict(zip(zip(table["rep"].to_pylist(), table["key"].to_pylist(), strict=True), table["text"].to_pylist(), strict=True))
        reps, cache = np.array([rep for rep, _ in known], np.int64), T.WordHashes()
        sets = [shingle_set(cache.of(text.translate(T.LOWER).split()), size) for text in known.values()]
        return _trees(classes(sets, similarity), reps) if len(sets) > 1 else (reps[:0], reps[:0])

    return _links_of(texts, "group", links)


def same_document(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (doc_id, rep) of documents with several rows whose sets differ, so that all their sets are one node."""
    several = known.groupBy("doc_id").agg(F.min("set_digest").alias("x"), F.max("set_digest").alias("y")).where("x <> y").select("doc_id")
    return known.join(several, "doc_id").join(reps.select("set_digest", "rep"), "set_digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80) -> DataFrame:
    """Per document doc_id, key, n_shingles, component_id (smallest doc_id reachable) and kept.

    Words are split at ASCII white space, A-Z lower-cased; a set has the shingles
    of `size` words. `similarity` is in hundredths and at least 80, for which
    `MATCHES` is made. Texts without words are linked with nothing. A null doc_id
    is linked with nothing and kept. Rows with the same doc_id are one document
    that is linked by each of its texts. Other columns are ignored; an empty table gives no rows.
    """
    if similarity < 80:
        raise ValueError("the match threshold is made for a similarity of 80 or more")
    given = T.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    rows = stage(described(given, size), "described")
    known = rows.where("doc_id is not null and set_digest is not null")
    reps = stage(known.groupBy("set_digest").agg(
        F.min("doc_id").alias("rep"), F.min_by("key", F.struct("doc_id", "key")).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "reps")
    groups = components(candidates(reps)).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    links = confirmed(given, reps.select("rep", "key", "n_shingles").join(groups, "rep"), size, similarity)
    found = components(links.unionByName(same_document(known, reps))).select(F.col("node").alias("rep"), "component")
    final = reps.select("set_digest", "rep").join(found, "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "key", "n_shingles", "set_digest").join(final, "set_digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY node) c USING (doc_id)"""
