"""Log-probabilities of texts from a model that mixes bit predictors.

A text is the stream of its lower-cased words, a blank after each, and an end
mark. Every byte is sent as the bits of a prefix code, and each bit is predicted
by several contexts: the last 2, 3 or 5 bytes of the word so far, known by their
64-bit hashes, with counts from all training texts. A logistic mixer adds up their
log-odds. Its weights are chosen by a gate (how many contexts were seen, first byte
of a word or not) and learn after every byte from the errors of its bits; an
adaptive map then corrects the result. A word's bits give its probability, which a
last gate, one per text and moved by every word, blends with the word's share of
the training words and of the text so far. Each text learns for itself, anew every
`LANE` bytes or words, so its score depends on the training counts and on its own
words, not on how rows are dealt.

Rows are taken in packs of some MB. A pack lists the hashes of its distinct words
and contexts, in order, with the bytes that follow each in training and their counts. These lists
are cut into ranges of hashes, as many as their length asks for; a range's lists are
summed over the corpus, and every pack gets back what is known of its own contexts.
Ranges that are still long, as of a context that every pack has, are summed in parts
first. The counts grow with the corpus and are never held whole. Inside a pack all
texts advance together, one byte of each at a time.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text as T
from tapeloom.session import stage

ORDERS = (2, 3, 5)
LANE = 4096  # bytes after which weights and memories start anew, and words after which the last gate does
END, GAP, WORD = 10, 32, 256  # the end mark's byte, the byte after a word, and what stands for a byte in the rows of whole words
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "n_bytes long, bits_per_byte double")
_PACKS = ("pack long, doc_id long, held_out boolean, n_tokens long, ids binary, words binary, histogram array<long>, "
          "size long, keys binary, sizes binary, values binary, counts binary")
_COLUMNS = ["keys", "sizes", "values", "counts"]
_LISTS = "bucket long, salt long, keys binary, sizes binary, values binary, counts binary"
RANGE = 1_000_000  # rows of a range of hashes that are summed together

# The mixer: its inputs are the contexts, in steps of 1 / 15.875, and a constant.
_FIRST = np.array([0.2, 0.35, 0.55, 0.0], np.float32)
_RATE, _STEP, _GATES = np.float32(0.005), np.float32(0.02), 2 * (len(ORDERS) + 1)
_LIMIT, _PRIOR, _SCALE, _CONSTANT = 8.0, 0.4, 15.875, 0.3
_BUCKETS = 33
_LANES = 4096  # of a group, as a lane's number has 12 bits
_SHARES, _MOVE = (0.5, 0.4, 0.1), 0.02  # the last gate at first, of training words, bits and the text so far; how fast it moves
_WINDOW = 192
_SHIFTS = np.array([[24], [16], [8], [0]], np.int32)  # bring one of a word's four bytes to its top
_BLOCK = 2048  # contexts whose bits are counted together
_U = np.uint64


def held_out(doc_id: int | None) -> bool:
    """Whether a document is left out of training; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Code:
    """A prefix code for bytes from their counts: bits and tree nodes on the way to each byte."""

    def __init__(self, histogram: np.ndarray):
        heap = [(int(n) + 1, b) for b, n in enumerate(histogram)]
        heapq.heapify(heap)
        sons, at = {}, 256
        while len(heap) > 1:
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            sons[at] = (a, b)
            heapq.heappush(heap, (n + m, at))
            at += 1
        ways: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo: list[tuple[int, list[tuple[int, int]]]] = [(at - 1, [])]
        while todo:
            node, way = todo.pop()
            if node < 256:
                ways[node] = way
            else:
                todo += [(son, [*way, (node - 256, bit)]) for bit, son in enumerate(sons[node])]
        self.length = np.array([len(w) for w in ways], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([n for w in ways for n, _ in w], np.int64)
        self.bit = np.array([b for w in ways for _, b in w], np.float32)


def spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run of the given size; all numbers fit 31 bits."""
    ends = np.cumsum(sizes)
    out = np.repeat((firsts - ends + sizes).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """The numbers, compressed byte by byte: all lowest bytes first."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending hashes by their distances: six bytes as they are, two that are nearly always zero compressed."""
    planes = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return len(keys).to_bytes(8, "little") + planes[:, :6].tobytes() + zlib.compress(planes[:, 6:].tobytes(), 1)


def unstepped(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.empty((n, 8), np.uint8)
    planes[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 8).reshape(-1, 6)
    planes[:, 6:] = np.frombuffer(zlib.decompress(data[8 + 6 * n :]), np.uint8).reshape(-1, 2)
    return np.cumsum(planes.view(_U).ravel(), dtype=_U)


class Lexicon:
    """The distinct words of a pack, the end mark first, byte by byte with the contexts of each byte.

    Per (context, byte) pair `key` has the context's hash and `value` the byte. `whole` has of each byte the pair of its
    longest context, which fixes the shorter ones: for those pairs, `used`, `pairs` has per order the pair's number.
    """

    def __init__(self, words: list[bytes]):
        data = b" \n" + b"".join([b" " + w + b" " for w in words])
        x = np.frombuffer(data, np.uint8)
        self.size = np.array([1, *[len(w) + 1 for w in words]], np.int64)  # bytes to predict
        begin = np.cumsum(self.size + 1) - self.size - 1
        self.first = np.cumsum(self.size) - self.size
        at, line_depth = spread(begin + 1, self.size), spread(np.zeros_like(self.size), self.size + 1)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [b"\n", *words]), np.uint64, len(words) + 1)
        self.word_key = T.mixed(hashes ^ _U(0xA5A5A5A5A5A5A5A5))
        # Bytes count from 1; those before the word are 0. Six of them and their places fit 64 bits.
        line = x.astype(np.int64) + 1
        packed, depth = line.copy(), line_depth[at]
        pairs, keys, values, done, last = [], [], [], 0, 0
        for order in ORDERS:
            for back in range(last + 1, order + 1):
                packed[back:] |= (line[:-back] << 9 * back) * (line_depth[back:] >= back)
            fresh = np.flatnonzero(depth > last)
            number, kinds = pd.factorize(packed[at[fresh]])
            own = pairs[-1].copy() if pairs else np.zeros(len(at), np.int32)
            own[fresh] = number + done
            pairs.append(own)
            keys.append(T.mixed(T.mixed((kinds >> 9).astype(_U) + _U(1))))
            values.append((kinds & 511) - 1)
            done, last = done + len(kinds), order
        self.key, self.value, self.whole = np.concatenate(keys), np.concatenate(values), pairs[-1]
        one = np.full(done, -1, np.int32)
        one[self.whole] = np.arange(len(at), dtype=np.int32)
        self.used = np.flatnonzero(one >= 0)
        one = one[self.used]
        self.pairs, self.initial = [pair[one] for pair in pairs], depth[one] == 1

    def counts(self, seen: np.ndarray) -> np.ndarray:
        """Of each pair, how often it is in the words, each taken `seen` times."""
        out = np.bincount(self.whole, np.repeat(seen, self.size), len(self.key))
        n = out[self.used]
        for pair, longer in itertools.pairwise(self.pairs):
            other = pair != longer
            out += np.bincount(pair[other], n[other], len(out))
        return out.astype(np.int64)

    def listed(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all contexts and words, ascending; of each how many bytes training has after it, and those bytes and their counts."""
        key = np.concatenate([self.word_key, self.key])
        value = np.concatenate([np.full(len(seen), WORD), self.value])
        n = np.concatenate([seen, self.counts(seen)])
        order = np.argsort(key)
        key, value, n = key[order], value[order], n[order]
        edge = np.flatnonzero(np.diff(key, prepend=key[:1] ^ _U(1)))
        found = n > 0
        return key[edge], np.add.reduceat(found, edge, dtype=np.int64), value[found], n[found]


def _lists(key: np.ndarray, size: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    return steps(key), squeezed(size.astype(np.uint16)), squeezed(value.astype(np.uint16)), squeezed(n.astype(np.int64))


def _read(keys: bytes, sizes: bytes, values: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unstepped(keys), *_pairs(sizes, values, counts)


def _pairs(sizes: bytes, values: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unsqueezed(sizes, np.uint16).astype(np.int64), unsqueezed(values, np.uint16).astype(np.int64), unsqueezed(counts, np.int64)


def split(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of lower-cased texts, and each text as numbers of its words from 1, closed by the end mark, number 0."""
    # Arrow's ASCII functions go by bytes; a blank at either end of a text leaves an empty word.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy()]
    ids = np.insert(coded.indices.to_numpy() + np.int32(1), ends[1:], np.int32(0))
    return coded.dictionary.view(pa.binary()).to_pylist(), np.split(ids, ends[1:-1] + np.arange(1, len(texts)))


class _Pack:
    """Documents that are scored together."""

    def __init__(self):
        self.ids, self.texts, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.texts.append(text)
        self.size += len(text)

    def rows(self, pack: int) -> pa.RecordBatch:
        """One row per document, and one with the pack's words, their training counts and the counts of bytes in training."""
        n, held = len(self.ids), [held_out(d) for d in self.ids]
        words, ids = split(self.texts)
        trained = [x for x, h in zip(ids, held, strict=True) if not h]
        seen = np.bincount(np.concatenate(trained), minlength=len(words) + 1) if trained else np.zeros(len(words) + 1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer(b"".join(words), np.uint8)
        histogram = np.bincount(chars, np.repeat(seen[1:], size), 256).astype(np.int64)
        histogram[GAP] += seen[1:].sum()
        histogram[END] += seen[0]
        lexicon = Lexicon(words)
        listed = lexicon.listed(seen.astype(np.int64))
        columns = {
            "pack": pa.array([pack] * (n + 1), pa.int64()),
            "doc_id": pa.array([*self.ids, None], pa.int64()),
            "held_out": pa.array([*held, None], pa.bool_()),
            "n_tokens": pa.array([*map(len, ids), None], pa.int64()),
            "ids": pa.array([*map(squeezed, ids), None], pa.binary()),
            "words": pa.array([*[None] * n, zlib.compress(b"\n".join(words), 1)], pa.binary()),
            "histogram": pa.array([*[None] * n, histogram.tolist()], pa.list_(pa.int64())),
            "size": pa.array([*[None] * n, max(len(listed[0]), len(listed[2]))], pa.int64()),
            **{c: pa.array([*[None] * n, x], pa.binary()) for c, x in zip(_COLUMNS, _lists(*listed), strict=True)},
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """The documents as word numbers, in packs of about `pack_bytes` (one document at least), and one row per pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, pack = TaskContext.get().partitionId() << 32, 0, _Pack()
        for batch in T.slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pack.add(doc_id, text or b"")
                if pack.size >= pack_bytes:
                    yield pack.rows(first + done)
                    pack, done = _Pack(), done + 1
        if pack.ids:
            yield pack.rows(first + done)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return T.small_batches(given).mapInArrow(run, _PACKS)


def _lexicon(words: bytes) -> Lexicon:
    plain = zlib.decompress(words)
    return Lexicon(plain.split(b"\n") if plain else [])


def asked(made: DataFrame, buckets: int, columns: list[str]) -> DataFrame:
    """(pack, bucket, size) and the given columns of each pack's lists, cut into equal ranges of hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, size = unstepped(row["keys"]), unsqueezed(row["sizes"], np.uint16)
                cuts, ends = [0, *np.searchsorted(key, edges).tolist(), len(key)], np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                own = [(k, a, b, int(ends[a]), int(ends[b])) for k, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
                made_of = {"keys": lambda a, b, c, d, key=key: steps(key[a:b]), "sizes": lambda a, b, c, d, size=size: squeezed(size[a:b])}
                if "values" in columns:
                    value, n = unsqueezed(row["values"], np.uint16), unsqueezed(row["counts"], np.int64)
                    made_of |= {"values": lambda a, b, c, d, value=value: squeezed(value[c:d]), "counts": lambda a, b, c, d, n=n: squeezed(n[c:d])}
                for at in range(0, len(own), 100):
                    some = own[at : at + 100]
                    numbers = [[row["pack"]] * len(some), [k for k, *_ in some], [max(b - a, d - c) for _, a, b, c, d in some]]
                    lists = [[made_of[name](*x) for _, *x in some] for name in columns]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(x, pa.binary()) for x in lists)], ["pack", "bucket", "size", *columns])

    rows = made.where("size IS NOT NULL").select("pack", *(_COLUMNS if "values" in columns else _COLUMNS[:2]))
    return rows.mapInArrow(run, ", ".join(["pack long, bucket long, size long", *(f"{c} binary" for c in columns)]))


def _summed(table: pa.Table) -> pa.Table:
    """The lists of a group as one, without the keys that no training text has."""
    key, size, value, n = (np.concatenate(x) for x in zip(*map(_read, *(table.column(c).to_pylist() for c in _COLUMNS)), strict=True))
    key = np.repeat(key, size)
    order = np.lexsort((value, key))
    key, value, n = key[order], value[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])])[: len(key)])
    n, key, value = np.add.reduceat(n, edge) if len(edge) else n, key[edge], value[edge]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    lists = _lists(key[first], np.diff(first, append=len(key)), value, n)
    columns = [table.column("bucket")[:1], table.column("salt")[:1], *(pa.array([x], pa.binary()) for x in lists)]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in _LISTS.split(", ")])


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each pack of a range: how many training pairs each of its keys has, and those pairs' bytes and counts."""
    known, size, value, n = _read(*(right.column(c)[0].as_py() for c in _COLUMNS)) if right.num_rows else (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
    # One more stands for what is not known.
    first, size = np.append(np.cumsum(size) - size, 0), np.append(size, 0)
    out = []
    for keys in left.column("keys").to_pylist():
        key = unstepped(keys)
        place = np.searchsorted(known, key)
        if len(known):
            place[known[np.minimum(place, len(known) - 1)] != key] = len(known)
        take = spread(first[place], size[place])
        out.append(_lists(key[:0], size[place], value[take], n[take])[1:])
    columns = [left.column("pack"), left.column("bucket"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))]
    return pa.Table.from_arrays(columns, ["pack", "bucket", *_COLUMNS[1:]])


def knowledge(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training lists by range of hashes, each pack's answers from them)."""
    size = made.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, int(size) // RANGE)
    parts = asked(made, buckets, []).groupBy("bucket").agg(F.ceil(F.sum("size") / (2 * RANGE)).alias("parts"))

    def salted(columns: list[str]) -> DataFrame:
        return asked(made, buckets, columns).join(parts, "bucket").withColumn("salt", F.pmod(F.hash("pack"), F.col("parts").cast("int")).cast("long"))

    first = salted(_COLUMNS).groupBy("bucket", "salt").applyInArrow(_summed, _LISTS)
    total = stage(first.groupBy("bucket").applyInArrow(_summed, _LISTS), "lm-counts")
    copies = total.join(parts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    asking = salted(["keys"]).select("pack", "bucket", "salt", "keys")
    answers = asking.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(
        _answered, "pack long, bucket long, sizes binary, values binary, counts binary")
    return total, answers


def training_size(total: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, value, n = _pairs(row["sizes"], row["values"], row["counts"])
                own = n[value == WORD]
                yield pa.RecordBatch.from_arrays([pa.array([int(own.sum())]), pa.array([len(own)])], ["n", "kinds"])

    found = total.select("sizes", "values", "counts").mapInArrow(run, "n long, kinds long").agg(F.sum("n"), F.sum("kinds")).first()
    return found[0] or 0, found[1] or 0


def log_odds(code: Code, lexicon: Lexicon, key: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of each pair of the lexicon: log-odds of a one in its context, and whether it was seen there; the pairs' first bits.

    The known pairs are in the order of their keys.
    """
    order = np.argsort(lexicon.key)
    asked, byte = lexicon.key[order], lexicon.value[order]
    fresh = np.diff(asked, prepend=asked[:1] ^ _U(1)) != 0
    contexts, own = asked[fresh], np.cumsum(fresh) - 1
    at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
    known = contexts[at] == key
    at, value, n = at[known], value[known], n[known].astype(np.float64)
    length = code.length[byte]
    odds, hit = np.zeros(int(length.sum()), np.float32), np.zeros(int(length.sum()), bool)
    firsts = np.empty(len(order), np.int32)
    firsts[order] = np.cumsum(length) - length
    blocks = np.arange(0, len(contexts) + _BLOCK, _BLOCK)
    done = 0
    for block, a, b, c, d in zip(blocks.tolist(), *(x for y in (at, own) for x in (np.searchsorted(y, blocks[:-1]), np.searchsorted(y, blocks[1:]))), strict=False):
        size = code.length[value[a:b]]
        way = spread(code.first[value[a:b]], size)
        cell, weight = np.repeat((at[a:b] - block) * 256, size) + code.node[way], np.repeat(n[a:b], size)
        total = np.bincount(cell, weight, _BLOCK * 256)
        one = np.bincount(cell, weight * code.bit[way], _BLOCK * 256)
        size = length[c:d]
        cell = np.repeat((own[c:d] - block) * 256, size) + code.node[spread(code.first[byte[c:d]], size)]
        total, one, to = total[cell], one[cell], slice(done, done + len(cell))
        hit[to] = total > 0
        odds[to] = np.log((one + _PRIOR) / (total - one + _PRIOR))
        done += len(cell)
    return np.clip(odds, -_LIMIT, _LIMIT), hit, firsts


class Bits:
    """The bits of the bytes of a lexicon, each byte of the same contexts once, those of most bits first.

    `tables` has a table for the first four bits of all, one for the next two of those
    that have them, and so on: four small numbers a bit, the contexts' log-odds and one,
    with a minus if the bit is zero, so that their sum speaks for the bit as it is.
    Bits that a byte does not have are zeros.
    """

    def __init__(self, lexicon: Lexicon, code: Code, odds: np.ndarray, hit: np.ndarray, firsts: np.ndarray):
        turn = np.argsort(-code.length[lexicon.value[lexicon.used]], kind="stable")
        number = np.zeros(len(lexicon.key), np.int32)
        number[lexicon.used[turn]] = np.arange(len(turn), dtype=np.int32)
        self.number, byte = number[lexicon.whole], lexicon.value[lexicon.used[turn]]
        self.size = code.length[byte]
        first = [firsts[pair[turn]] for pair in lexicon.pairs]
        self.gate = sum((hit[f].astype(np.int32) for f in first), lexicon.initial[turn] * np.int32(len(ORDERS) + 1))
        small = np.rint(odds * _SCALE).astype(np.int8)
        longest = int(self.size[0])
        having = np.searchsorted(-self.size, -np.arange(longest), "left").tolist()
        self.tables, self.slots, self.spare = [], [], -self.size
        for width in itertools.chain((4, 2, 2, 4), itertools.repeat(8)):
            slot = sum(t.shape[1] for t in self.tables)
            if slot >= longest:
                break
            made = np.zeros((having[slot], width, 4), np.int8)
            for at, n in enumerate(having[slot : slot + width]):
                own = made[:n, at]
                for k, f in enumerate(first):
                    own[:, k] = small[f[:n] + (slot + at)]
                own[:, 3] = 1
                own *= np.where(code.bit[code.first[byte[:n]] + (slot + at)] > 0, 1, -1).astype(np.int8)[:, None]
            self.tables.append(made.view("<i4")[:, :, 0])
            self.slots.append(slot)
            self.spare[: len(made)] += width


class Mixer:
    """Weights and correction maps of a group of lanes that advance together.

    The weights are those of inputs counted in their small steps, the maps hold how
    far a probability is from a half.
    """

    _UNIT = np.array([*[1 / _SCALE] * len(ORDERS), _CONSTANT])

    def __init__(self, lanes: int, width: int):
        self.weights = np.tile((_FIRST * self._UNIT).astype(np.float32), (lanes * _GATES, 1)).view(np.complex128).ravel()
        self.rates = (_RATE * self._UNIT**2).astype(np.float32)[:, None]
        middles = (np.arange(_BUCKETS) - _BUCKETS // 2) / 2
        # The first place is that of bits that bytes do not have.
        self.map = np.append(np.float32(0), np.tile((1 / (1 + np.exp(-middles)) - 0.5).astype(np.float32), lanes))
        self.raw, self.shifted = np.empty(lanes * width, np.int32), np.empty((4, lanes * width), np.int32)
        # A fifth row has the places of the maps' middles, later the logs of the probabilities.
        self.inputs, self.parts = (np.empty((5, lanes * width), np.float32) for _ in range(2))
        self.odds, self.p = (np.empty(lanes * width, np.float32) for _ in range(2))

    def byte(self, tables: list[np.ndarray], own: np.ndarray, where: np.ndarray, middle: np.ndarray, counts: list[int]) -> np.ndarray:
        """Log of the probability of one byte of each of some lanes, those of most bits first; learns afterwards.

        `own` numbers the bytes, `where` and `middle` are the places of the lanes' weights and maps, `counts` says how
        many bytes have bits in each table. Bits that a byte does not have count as even chances.
        """
        n, whole, bits = len(own), 0, []
        for table, k in zip(tables, counts, strict=True):
            if k:
                bits.append((k, table, slice(whole, whole := whole + k * table.shape[1]), (-1, table.shape[1], k)))
        raw, shifted, inputs, parts, odds, p = (x[..., :whole] for x in (self.raw, self.shifted, self.inputs, self.parts, self.odds, self.p))
        weights = np.empty((5, n), np.float32)
        weights[:4] = self.weights.take(where).view(np.float32).reshape(n, 4).T
        weights[4] = middle
        for k, table, to, shape in bits:
            raw[to].reshape(shape[1:])[...] = table.take(own[:k], axis=0).T
        np.left_shift(raw, _SHIFTS, out=shifted)
        np.right_shift(shifted, 24, out=inputs[:4], casting="unsafe")
        np.multiply(inputs[3], inputs[3], out=inputs[4])
        for k, _, to, shape in bits:
            np.multiply(inputs[:, to].reshape(shape), weights[:, None, :k], out=parts[:, to].reshape(shape))
        np.add.reduce(parts[:4], axis=0, out=odds)
        np.minimum(odds, np.float32(_LIMIT), out=odds)
        np.maximum(odds, np.float32(-_LIMIT), out=odds)
        np.exp(np.negative(odds, out=p), out=p)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        # Where two bits of a byte meet one place of the map, the later one counts.
        sign = inputs[3].copy()
        odds += odds
        np.rint(odds, out=odds)
        odds *= sign
        odds += parts[4]
        place = odds.astype(np.int64)
        mapped = self.map.take(place)
        self.map[place] = mapped * (1 - _STEP) + sign * (_STEP / 2)
        inputs[:4] *= np.subtract(np.float32(1), p, out=odds)
        mapped *= sign
        mapped += np.float32(0.5)
        mapped *= np.float32(0.25)
        p *= np.float32(0.75)
        p += mapped
        np.log(p, out=inputs[4])
        sums = np.add.reduce(inputs[:, bits[0][2]].reshape(bits[0][3]), axis=1)
        for k, _, to, shape in bits[1:]:
            sums[:, :k] += np.add.reduce(inputs[:, to].reshape(shape), axis=1)
        weights[:4] += sums[:4] * self.rates
        self.weights[where] = np.ascontiguousarray(weights[:4].T).view(np.complex128).ravel()
        return sums[4]


def byte_scores(bits: Bits, streams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log of the probability of each byte of the streams, which lanes from begin up to end cover; bytes are numbered as in `bits`."""
    score, order, width = np.zeros(len(streams), np.float32), np.argsort(begin - end, kind="stable"), sum(t.shape[1] for t in bits.tables)
    spare = (bits.spare * np.log(2)).astype(np.float32)
    for group in range(0, len(order), _LANES):
        lanes = order[group : group + _LANES]
        mixer, start, left = Mixer(len(lanes), width), begin[lanes], (end - begin)[lanes]
        for offset in range(0, int(left[0]), _WINDOW):
            # The first bytes of all lanes, then the second bytes of those that have them, and so on; in each such step, those of most bits first.
            active = np.searchsorted(-left, -np.arange(offset, min(offset + _WINDOW, int(left[0]))), "left")
            lane, step = spread(np.zeros_like(active), active), np.repeat(np.arange(len(active)), active)
            turn = streams[start[lane] + step + offset].astype(np.int64) << 12 | lane
            edges = [0, *np.cumsum(active).tolist()]
            for a, b in itertools.pairwise(edges):
                turn[a:b].sort()
            lane, own = turn & 4095, turn >> 12
            size = bits.size[own]
            counts = np.stack([np.add.reduceat(size > slot, edges[:-1], dtype=np.int64) for slot in bits.slots], 1).tolist()
            where, middle = lane * _GATES + bits.gate[own], (lane * _BUCKETS + (_BUCKETS // 2 + 1)).astype(np.float32)
            found = np.empty(len(own), np.float32)
            for a, b, having in zip(edges[:-1], edges[1:], counts, strict=True):
                found[a:b] = mixer.byte(bits.tables, own[a:b], where[a:b], middle[a:b], having)
            score[start[lane] + step + offset] = found + spare[own]
    return score


def cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the lanes of texts that lie one after another."""
    starts, lanes = np.cumsum(sizes) - sizes, -(-sizes // LANE)
    doc = np.repeat(np.arange(len(sizes)), lanes)
    begin = spread(np.zeros_like(lanes), lanes) * LANE + starts[doc]
    return begin, np.minimum(begin + LANE, (starts + sizes)[doc]), doc


def earlier(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How often the word came before in its lane; places are in order."""
    bits = len(word).bit_length()
    turn = np.sort(word.astype(np.int64) << bits | np.arange(len(word)))
    word, at = turn >> bits, turn & (1 << bits) - 1
    lane, place = lane[at], np.arange(len(at))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (lane[1:] != lane[:-1])
    out = np.empty(len(at), np.int64)
    out[at] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return out


def blended(bits: np.ndarray, share: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Log of each word's probability: that of its bits, its share of training words and of the lane so far, by the moving gate."""
    order = np.argsort(begin - end, kind="stable")
    size = (end - begin)[order]
    gate = np.repeat(np.array(_SHARES)[:, None], len(order), axis=1)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    # The first words of all lanes, then the second words of those that have them, and so on.
    step = np.repeat(np.arange(len(active)), active)
    at = begin[order][spread(np.zeros_like(active), active)] + step
    with np.errstate(divide="ignore"):
        parts = np.stack([np.log(share[at]), bits[at], np.log(before[at]) - np.log(np.maximum(step, 1))])
    # Relative to the largest, as a long word's probability is too small for a double.
    most = parts.max(axis=0)
    parts -= most
    np.exp(parts, out=parts)
    total, a = np.empty(len(at)), 0
    for n in active.tolist():
        own, now = parts[:, a : a + n], gate[:, :n]
        own *= now
        whole = np.add.reduce(own, axis=0, out=total[a : a + n])
        own /= whole
        own -= now
        own *= _MOVE
        now += own
        a += n
    out = np.zeros(len(bits))
    out[at] = np.log(total) + most
    return out


def _chunks(texts: list[np.ndarray], lexicon: Lexicon, most: int = 16 << 20) -> Iterator[list[np.ndarray]]:
    """The texts in groups of about `most` bytes."""
    own, held = [], 0
    for x in texts:
        own.append(x)
        held += int(lexicon.size[x].sum())
        if held >= most:
            yield own
            own, held = [], 0
    if own:
        yield own


def _finish(code: Code, tokens: int, kinds: int):
    """Scores of the documents of one pack, from what is known of its words and contexts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lexicon = _lexicon(left.filter(pc.is_valid(left.column("words"))).column("words")[0].as_py())
        docs = left.filter(pc.is_valid(left.column("ids")))
        key = np.sort(np.concatenate([lexicon.word_key, lexicon.key]))
        key = key[np.diff(key, prepend=key[:1] ^ _U(1)) != 0]
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        sizes, value, n = (np.concatenate(x) for x in zip(*(_pairs(r["sizes"], r["values"], r["counts"]) for r in rows), strict=True))
        if len(sizes) != len(key):
            raise ValueError("a pack has lost answers")
        del rows, left, right
        place, whole = np.repeat(np.arange(len(key)), sizes), value == WORD
        seen = np.zeros(len(key), np.int64)
        seen[place[whole]] = n[whole]
        seen = seen[np.searchsorted(key, lexicon.word_key)]
        base, share = np.log10((seen + 1) / (tokens + kinds + 1)), seen / max(tokens, 1)
        bits_of = Bits(lexicon, code, *log_odds(code, lexicon, key[place[~whole]], value[~whole], n[~whole]))
        out: dict[str, list] = {"n_known": [], "base_score": [], "score": [], "n_bytes": []}
        ids = [unsqueezed(x, np.int32) for x in docs.column("ids").to_pylist()]
        for words in _chunks(ids, lexicon):
            sizes = np.array([int(lexicon.size[w].sum()) for w in words], np.int64)
            flat = np.concatenate(words)
            streams = bits_of.number[spread(lexicon.first[flat], lexicon.size[flat])]
            begin, end, _ = cut(sizes)
            every = byte_scores(bits_of, streams, begin, end)
            bits = np.add.reduceat(every, np.cumsum(lexicon.size[flat]) - lexicon.size[flat], dtype=np.float64)
            begin, end, doc = cut(np.array([len(w) for w in words]))
            each = blended(bits, share[flat], begin, end, earlier(np.repeat(np.arange(len(begin)), end - begin), flat))
            out["score"] += (np.bincount(doc, np.add.reduceat(each, begin), len(words)) / np.log(10)).tolist()
            out["n_bytes"] += sizes.tolist()
            out["n_known"] += [int((seen[w] > 0).sum()) for w in words]
            out["base_score"] += [float(base[w].sum()) for w in words]
        per_byte = [-s / np.log10(2) / b for s, b in zip(out["score"], out["n_bytes"], strict=True)]
        columns = [
            docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(out["n_known"], pa.int64()),
            pa.array([tokens] * len(ids), pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64()),
            pa.array(out["n_bytes"], pa.int64()), pa.array(per_byte, pa.float64()),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def score(docs: DataFrame, pack_bytes: int = 8 << 20) -> DataFrame:
    """Per document the token counts, the unigram base score, the model's log10 probability and its bits per byte.

    Every row is a document, also a repeated one; a null text is empty and has the
    end mark alone. Without training documents nothing is known, and every word
    costs what the untrained model gives. Other columns are ignored, and an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    made = stage(packs(docs, pack_bytes), "lm-packs")
    counts = made.where("words IS NOT NULL").select(F.posexplode("histogram").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return spark.createDataFrame([], RESULT)
    histogram = np.zeros(256, np.int64)
    for r in counts:
        histogram[r["byte"]] = r["n"]
    total, answers = knowledge(made)
    own = made.select("pack", "doc_id", "held_out", "n_tokens", "ids", "words")
    run = _finish(Code(histogram), *training_size(total))
    return own.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, RESULT)
