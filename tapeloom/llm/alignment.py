"""Which ids of one tokenizer stand for the same bytes as which of another.

Both id lists of a text are given cumulative byte ends. The ends that both lists
share, found by intersecting two end-to-index dictionaries, cut both lists into
groups, and every id of a group is linked with every id opposite.

Neither tokenizer joins a letter or sign with a blank behind it, nor a letter with a
comma or stop, so a text is cut there, and each distinct part of a pack is encoded
and aligned once. Rows are taken in packs of some MB of text. A pack lists its
distinct id pairs, and in how many of its documents each is linked; these lists are
summed by pair over the corpus, and every pack gets back the totals of its own
pairs. A pair thus moves once per pack, however often it occurs, and no table of
pairs is held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.text import slices, small_batches
from tapeloom.session import stage

PIECE_BPE = "piece_bpe_32k.model"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SOLID = "!-~À-ÖØ-öø-ÿ"
# One part: any first character, then all up to a blank or line break behind a solid character, or a stop behind a letter.
_PART = re.compile(rf"(?s:.)(?:[^ \n.,;:!?]+|(?<![{_SOLID}])[ \n]|(?<![{_LETTER}])[.,;:!?])*+")
_CROSSING = re.compile(rf"[{_SOLID}][▁\n]|[{_LETTER}][.,;:!?]")
# Fixed value: how the byte-level vocabulary cuts a text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_TEXT = 1 << 20

Slice = tuple[int, int, int, int]


def align(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[Slice]:
    """(first, last + 1) of the A ids and of the B ids of each group, in order, from cumulative byte ends."""
    index_a = {end: k for k, end in enumerate(ends_a, 1)}
    index_b = {end: k for k, end in enumerate(ends_b, 1)}
    out, a, b = [], 0, 0
    for end in sorted(index_a.keys() & index_b.keys()):
        out.append((a, index_a[end], b, index_b[end]))
        a, b = index_a[end], index_b[end]
    return out


def links(ids_a: Sequence[int], ids_b: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(pair, times) for all links of one group; a pair is the A id times 2^32 plus the B id."""
    count_b = Counter(ids_b).items()
    for a, times in Counter(ids_a).items():
        for b, n in count_b:
            yield a << 32 | b, times * n


class Vocabulary:
    """Ids of both tokenizers for parts of texts, and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        vocabulary = json.loads(Path(path_a).read_text())
        names, special = vocabulary["model"]["vocab"], {t["content"] for t in vocabulary["added_tokens"]}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(_CROSSING.search(p) for p in pieces):
            raise ValueError("a piece of the second vocabulary reaches over a blank; texts cannot be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        # The byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in {*plain})}
        table = {chr(b): b for b in plain} | other
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes_a[k] = name.encode() if name in special else bytes(table[c] for c in name)
        # Its ids are in the order of its merges, so they are the ranks of the same byte-pair encoding.
        ranks = {self.bytes_a[k]: k for name, k in names.items() if name not in special}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in vocabulary["model"]["merges"]]
        if any(names[a] >= names[b] for a, b in pairwise(made)):
            raise ValueError("the ids of the first vocabulary are not in the order of its merges")
        self.a = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(k) for k in range(len(own))] for own in (self.bytes_a, self.bytes_b))
        self.mark = len(self.b.encode("a"))

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both id lists of each part."""
        ids_a = [*map(self.a.encode_ordinary, parts)]
        # The leading "a" takes the blank that B puts before a text; a part begins at a place where B cuts.
        return ids_a, [ids[self.mark :] for ids in self.b.encode(["a" + p for p in parts], num_threads=1)]

    def faithful(self, part: str, a: list[int], b: list[int]) -> bool:
        want = part.encode()
        return b"".join([self.bytes_a[k] for k in a]) == want == b"".join([self.bytes_b[k] for k in b])


def entries(vocabulary: Vocabulary, parts: list[str], wide: int = 4096) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts encoded and aligned together: their bytes are one line, on which both tokenizers end wherever a part does.

    Which parts' ids stand for their bytes; and of these parts their groups as text,
    (ids of A, of B, groups, links), how many pairs each has, the pairs and how
    often each is linked.
    """
    every_a, every_b = vocabulary.encode(parts)
    sound = np.array([vocabulary.faithful(*x) for x in zip(parts, every_a, every_b, strict=True)], bool)
    if not sound.all():
        every_a, every_b = ([ids for ids, fine in zip(own, sound, strict=True) if fine] for own in (every_a, every_b))
    n_a, n_b = (np.array([*map(len, own)], np.int64) for own in (every_a, every_b))
    flat_a, flat_b = (list(chain.from_iterable(own)) for own in (every_a, every_b))
    ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
    found = align(np.cumsum(vocabulary.size_a[ids_a]).tolist(), np.cumsum(vocabulary.size_b[ids_b]).tolist())
    place = np.array(found, np.int64).reshape(-1, 4)
    of = np.searchsorted(np.cumsum(n_a), place[:, 0], "right")
    size_a, size_b = place[:, 1] - place[:, 0], place[:, 3] - place[:, 2]
    # Small groups are spread into their links at once; in large ones, equal ids are counted first.
    small = size_a * size_b <= wide
    first, other, times = place[small, 0], place[small, 2], size_b[small]
    sizes = size_a[small] * times
    link, each = _spread(np.zeros_like(sizes), sizes), np.repeat(times, sizes)
    pairs = ids_a[np.repeat(first, sizes) + link // each] << 32 | ids_b[np.repeat(other, sizes) + link % each]
    part, count = np.repeat(of[small], sizes), np.ones(len(pairs), np.int64)
    if not small.all():
        for k in np.flatnonzero(~small).tolist():
            a0, a1, b0, b1 = found[k]
            more = np.array(list(links(flat_a[a0:a1], flat_b[b0:b1])), np.int64)
            pairs, part, count = np.append(pairs, more[:, 0]), np.append(part, np.full(len(more), of[k])), np.append(count, more[:, 1])
        order = np.argsort(part, kind="stable")
        pairs, part, count = pairs[order], part[order], count[order]
    n_groups = np.bincount(of, minlength=len(n_a))
    n_links = np.bincount(of, size_a * size_b, len(n_a)).astype(np.int64)
    text_a, text_b = [*map(vocabulary.text_a.__getitem__, flat_a)], [*map(vocabulary.text_b.__getitem__, flat_b)]
    shown = [text_a[a] + "|" + text_b[b] if c - a == 1 == d - b else ",".join(text_a[a:c]) + "|" + ",".join(text_b[b:d]) for a, c, b, d in found]
    last = np.cumsum(n_groups).tolist()
    texts = [";".join(shown[a:b]) for a, b in zip([0, *last], last, strict=False)]
    return sound, texts, np.stack([n_a, n_b, n_groups, n_links], 1), np.bincount(part, minlength=len(n_a)), pairs, count


class _Pack:
    """Documents of one pack, each a list of the numbers of its parts."""

    _open: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, path_a: str, path_b: str):
        # One vocabulary per worker process.
        if (path_a, path_b) not in self._open:
            self._open[path_a, path_b] = Vocabulary(path_a, path_b)
        self.vocabulary, self.number, self.texts, self.made = self._open[path_a, path_b], {}, [], []
        self.docs, self.size = [], 0

    def learn(self, found: Iterable[str], batch: int = 20_000) -> None:
        """Gives each part that is new to the pack a number, -1 to those without ids."""
        new = [p for p in dict.fromkeys(found) if p not in self.number]
        for at in range(0, len(new), batch):
            own = new[at : at + batch]
            sound, texts, *arrays = entries(self.vocabulary, own)
            numbers = np.where(sound, np.cumsum(sound) - 1 + len(self.texts), -1)
            self.number.update(zip(own, numbers.tolist(), strict=True))
            self.texts += texts
            self.made.append(arrays)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the parts of blank + text; none for a text that is empty or whose ids do not stand for its bytes."""
        cut = [_PART.findall(" " + t) if 0 < len(t) < _LONG_TEXT else [] for t in texts]
        self.learn(chain.from_iterable(cut))
        out = []
        for text, found in zip(texts, cut, strict=True):
            if len(text) < _LONG_TEXT:
                own = np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))
            else:
                self.learn(m[0] for m in _PART.finditer(" " + text))
                own = np.fromiter((self.number[m[0]] for m in _PART.finditer(" " + text)), np.int32)
            out.append(own if own.min(initial=0) >= 0 else own[:0])
        return out

    def shown(self, numbers: np.ndarray) -> str:
        return ";".join([self.texts[k] for k in numbers.tolist()])

    def digest(self, numbers: np.ndarray) -> str:
        if not len(numbers):
            return ""
        made, mark = hashlib.sha256(), ""
        for at in range(0, len(numbers), 100_000):
            made.update((mark + self.shown(numbers[at : at + 100_000])).encode())
            mark = ";"
        return made.hexdigest()

    def add(self, docs: list[tuple[int | None, str]]) -> None:
        for (doc_id, text), numbers in zip(docs, self.numbers([t for _, t in docs]), strict=True):
            self.docs.append((doc_id, numbers, self.digest(numbers)))
            self.size += len(text)

    def rows(self, pack: int) -> pa.RecordBatch:
        """One row per document, and one for the pack: its distinct pairs, in how many documents each is, and the parts' links."""
        sizes = np.array([len(n) for _, n, _ in self.docs], np.int64)
        every = np.concatenate([n for _, n, _ in self.docs]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        facts, each, flat, times = (np.concatenate(x) for x in zip(*self.made, strict=True)) if self.made else (np.zeros((0, 4), np.int64), *[np.zeros(0, np.int64)] * 3)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(facts[every], axis=0)])
        own = sums[starts[1:]] - sums[starts[:-1]]
        pairs, place = np.unique(flat, return_inverse=True)
        # Distinct (document, part), then distinct (document, pair).
        held = _distinct(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(each)) + every)
        doc, part = held // max(1, len(each)), held % max(1, len(each))
        where = _spread(np.cumsum(each)[part] - each[part], each[part]) if len(part) else part
        seen = _distinct(np.repeat(doc, each[part]) * max(1, len(pairs)) + place[where]) % max(1, len(pairs))
        tally = np.bincount(seen, minlength=len(pairs))
        blobs = [zlib.compress(n.tobytes(), 1) for _, n, _ in self.docs]
        shared = [x.astype(k).tobytes() for x, k in ((pairs, np.int64), (tally, np.int64))]
        csr = zlib.compress(b"".join(x.astype(np.int64).tobytes() for x in (np.array([len(each), len(flat)]), each, place, times)), 1)
        n = len(self.docs)
        columns = {
            "pack": pa.array([pack] * (n + 1), pa.int64()),
            "doc_id": pa.array([*(d for d, _, _ in self.docs), None], pa.int64()),
            **{c: pa.array([*own[:, k].tolist(), None], pa.int64()) for k, c in enumerate(COLUMNS[:4])},
            "groups_sha256": pa.array([*(s for _, _, s in self.docs), None], pa.string()),
            "parts": pa.array([*blobs, None], pa.binary()),
            "pairs": pa.array([*[None] * n, shared[0]], pa.binary()),
            "tally": pa.array([*[None] * n, shared[1]], pa.binary()),
            "links": pa.array([*[None] * n, csr], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_PACKS = "pack long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts binary, pairs binary, tally binary, links binary"


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run of the given size."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct numbers, none below 0, in order."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=-1))]


def packs(docs: DataFrame, path_a: str, path_b: str, pack_chars: int = 12 << 20) -> DataFrame:
    """The documents aligned, in packs of about `pack_chars` bytes (one document at least), and one row per pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, pack = TaskContext.get().partitionId() << 32, 0, _Pack(path_a, path_b)
        for batch in slices(batches, "text", min(pack_chars, 2 << 20)):
            texts = ((text or b"").decode() for text in batch.column("text").to_pylist())
            pack.add(list(zip(batch.column("doc_id").to_pylist(), texts, strict=True)))
            if pack.size >= pack_chars:
                yield pack.rows(first + done)
                pack, done = _Pack(path_a, path_b), done + 1
        if pack.docs:
            yield pack.rows(first + done)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return small_batches(given).mapInArrow(run, _PACKS)


def _asked(made: DataFrame) -> DataFrame:
    """(pack, a, b, n): the distinct pairs of every pack, and in how many of its documents each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, pairs, tally in zip(*(batch.column(c).to_pylist() for c in ("pack", "pairs", "tally")), strict=True):
                pairs, tally = np.frombuffer(pairs, np.int64), np.frombuffer(tally, np.int64)
                for at in range(0, len(pairs), 200_000):
                    own, n = pairs[at : at + 200_000], tally[at : at + 200_000]
                    columns = [pa.array(np.full(len(own), pack)), pa.array((own >> 32).astype(np.int32)), pa.array((own & 0xFFFFFFFF).astype(np.int32)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["pack", "a", "b", "n"])

    return made.where("pairs IS NOT NULL").select("pack", "pairs", "tally").mapInArrow(run, "pack long, a int, b int, n long")


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each pair is linked, and whether no pair of the same A id is in more."""
    counts = _asked(made).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pack's documents with sums over their links, from the totals of the pack's pairs."""
    shared = left.filter(pc.is_valid(left.column("links"))).to_pylist()
    docs = left.filter(pc.is_valid(left.column("parts")))
    csr = np.frombuffer(zlib.decompress(shared[0]["links"]), np.int64)
    n_parts, n_links = csr[:2].tolist()
    each, place, times = np.split(csr[2:], [n_parts, n_parts + n_links])
    pair = np.asarray(right.column("a")).astype(np.int64) << 32 | np.asarray(right.column("b"))
    order = np.argsort(pair)
    if shared[0]["n_pairs"] != len(order):
        raise ValueError("a pack has lost totals of its pairs")
    total, best = np.asarray(right.column("count"))[order], np.asarray(right.column("best"))[order]
    edge = np.concatenate([[0], np.cumsum(each)])

    def per_part(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[edge[1:]] - sums[edge[:-1]]

    score, hits = per_part(total[place] * times), per_part(best[place] * times)
    numbers = [np.frombuffer(zlib.decompress(x), np.int32) for x in docs.column("parts").to_pylist()]
    made = [(int(hits[k].sum()), int(score[k].sum())) for k in numbers]
    out = docs.select(["doc_id", *COLUMNS[:4]])
    out = out.append_column("n_best", pa.array([m[0] for m in made], pa.int64())).append_column("count_sum", pa.array([m[1] for m in made], pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def compare(docs: DataFrame, path_a: str, path_b: str, pack_chars: int = 12 << 20) -> DataFrame:
    """Per document: ids of A and B, groups, links, best links, the sum of the links' counts and a digest of the groups.

    Every row counts as a document, also one that is repeated or has no doc_id.
    Null and empty texts, and texts whose ids do not stand for their bytes, have
    no tokens: zeros and an empty digest. Other columns are ignored; an empty
    table gives no rows. Special tokens inside texts are plain text.
    """
    made = stage(packs(docs, path_a, path_b, pack_chars), "aligned")
    answers = _asked(made).select("pack", "a", "b").join(pair_counts(made), ["a", "b"])
    size = (F.length("pairs") / 8).cast("long").alias("n_pairs")
    own = made.select("pack", "doc_id", *COLUMNS, "parts", "links", size)
    return own.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_finish, RESULT)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`doc_id` and the groups themselves, as `a1,a2|b1;a3|b2`; empty for a text without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pack = _Pack(path_a, path_b)
            made = [pack.shown(n) for n in pack.numbers([(text or b"").decode() for text in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "groups"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return small_batches(given).mapInArrow(run, "doc_id long, groups string")
