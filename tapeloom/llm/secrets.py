"""Secrets in texts, and in what texts hold encoded.

Each text is the first layer of a worklist. In a layer, encoded parts are found
(percent escapes, \\u escapes, base64, and gzip or zlib inside base64), decoded
and put on the list unless the same layer was met before at the same place of
this text, which also ends cycles; the list runs until it is empty. Every layer is scanned by the
same patterns. A secret of an inner layer gets the span, in the whole text, of
the encoded part that holds it: each layer maps its characters to the text.

A base64 part may follow a path, a prefix or anything else that reads as base64,
and may be wrapped into lines.

A percent or \\u layer is the part with its escapes undone, mapped character by
character, so a secret that lies half inside keeps its own bounds. A base64
layer maps all its characters to the encoded part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.apart import set_apart
from tapeloom.llm.text import slices, small_batches

# The kinds in their order, each pattern, the group with the secret and its least length.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SIGN = re.compile(r"[:=]")

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}")
# A run of base64 digits may go on after line breaks with blanks around them.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
# In decoded bytes: starts of gzip and zlib streams, stretches of UTF-8 and of ASCII as UTF-16, byte order marks.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]", re.S)
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}+")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}+|(?:\0[\t\n\r\x20-\x7e]){12,}+")
_CUTS = "/+_-"
_MARKS = (b"\xff\xfe", b"\xfe\xff")

BROKEN = len(KINDS)  # a kind of its own: what cannot be read
_PIECE = 1 << 20
# Bytes that neither a secret, an escape nor base64 has, and blanks inside prose.
_BREAK = re.compile(
    rb"[,;()<>{}|!?#*&$@~^`\[\]\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]|\0(?=\0)"
    rb"|(?<=[A-Za-z0-9.,])\x20(?=[A-Za-z0-9])|(?<=[A-Za-z0-9.,]\0)\x20\0(?=[A-Za-z0-9])"
)
# Any number of blanks may stand before and after the sign of an assignment.
_BLANKS = re.compile(rb"(\x20\0?)\1{255,}")
_ZEROS = re.compile(rb"\0{3,}")
_ASCII = bytes(b if 32 <= b < 127 or b in b"\t\n\r" else 0 for b in range(256))
_OTHER = re.compile(rb"[^A-Za-z0-9+/_-]")

Span = tuple[int, int, int]  # start, end, number of the kind
Source = Callable[[], Iterable[bytes]]


def base_spans(text: str) -> list[Span]:
    """Secrets of one layer: leftmost non-overlapping matches per kind, failing ones dropped."""
    out: list[Span] = []
    if _SIGN.search(text):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return out


class _Places:
    """Where the characters of a layer come from in the whole text.

    Only decoded characters are listed, with what they came from; those between
    follow the listed one before them, one by one. Memory grows with the escapes,
    not with the text.
    """

    def __init__(self) -> None:
        self.at, self.start, self.end = array("q"), array("q"), array("q")

    def add(self, at: int, start: int, end: int) -> None:
        self.at.append(at)
        self.start.append(start)
        self.end.append(end)

    def of(self, k: int) -> tuple[int, int]:
        """Start and end, in the whole text, of what character k came from."""
        n = bisect_right(self.at, k) - 1
        if n < 0:
            return k, k + 1
        if self.at[n] == k:
            return self.start[n], self.end[n]
        place = self.end[n] + k - self.at[n] - 1
        return place, place + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.of(start)[0], self.of(end - 1)[1]

    def copy(self, other: _Places, first: int, last: int, shift: int) -> None:
        """Takes over the listed characters from first up to last of another layer, moved."""
        for n in range(bisect_left(other.at, first), bisect_left(other.at, last)):
            self.add(other.at[n] + shift, other.start[n], other.end[n])

    def digest(self) -> bytes:
        return hashlib.sha256(self.at.tobytes() + self.start.tobytes() + self.end.tobytes()).digest()


_HEX2, _HEX4 = re.compile(r"[0-9A-Fa-f]{2}"), re.compile(r"u([0-9A-Fa-f]{4})")


def _unit(text: str, at: int) -> tuple[bool, int, int]:
    """(percent or not, value, end) of the escape at a place, undone as long as what it gives begins a further one.

    A percent sign that is itself escaped, any number of times, is so read in one
    step over its characters, not in one copy of the text per level.
    """
    percent = text[at] == "%"
    value, end = (int(text[at + 1 : at + 3], 16), at + 3) if percent else (int(text[at + 2 : at + 6], 16), at + 6)
    while True:
        if value == 0x25 and (m := _HEX2.match(text, end)):
            percent, value, end = True, int(m[0], 16), m.end()
        elif value == 0x5C and (m := _HEX4.match(text, end)):
            percent, value, end = False, int(m[1], 16), m.end()
        else:
            return percent, value, end


def _undone(text: str, pattern: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Characters of the escapes that a pattern begins, each with its place; what is no character stays as it is."""
    at = 0
    while m := pattern.search(text, at):
        units, at = [], m.start()
        while at == m.start() or pattern.match(text, at):
            percent, value, end = _unit(text, at)
            units.append((percent, value, at, end))
            at = end
        k = 0
        while k < len(units):
            percent, value, start, end = units[k]
            size, char = 1, None
            if percent:
                size = 1 if value < 0x80 else 2 if value < 0xE0 else 3 if value < 0xF0 else 4
                own = units[k : k + size]
                if all(p for p, *_ in own):
                    with suppress(UnicodeDecodeError):
                        char = bytes(v for _, v, *_ in own).decode()
            elif not 0xD800 <= value < 0xE000:
                char = chr(value)
            elif value < 0xDC00 and k + 1 < len(units) and not units[k + 1][0] and 0xDC00 <= units[k + 1][1] < 0xE000:
                size, char = 2, chr(0x10000 + ((value - 0xD800) << 10) + units[k + 1][1] - 0xDC00)
            if char is None:
                k += 1
            else:
                yield char, start, units[k + size - 1][3]
                k += size


def _escapes(text: str, pattern: re.Pattern, outer: _Places | None = None) -> tuple[str, _Places] | None:
    """The text with its escapes undone, and the places of its characters in the whole text; None if nothing decodes."""
    parts, places, at, size, outer = [], _Places(), 0, 0, outer or _Places()
    for char, start, end in _undone(text, pattern):
        parts += (text[at:start], char)
        places.copy(outer, at, start, size - at)
        size += start - at
        places.add(size, *outer.span(start, end))
        size += 1
        at = end
    if not parts:
        return None
    parts.append(text[at:])
    places.copy(outer, at, len(text), size - at)
    return "".join(parts), places


_ESCAPES = (("%", _PERCENT), ("\\u", _UNICODE))


class _Inflated:
    """Content of a gzip or zlib stream and of all members after it, in pieces of at most 1 MB.

    After the pieces, `read` is the number of bytes that belong to it, `ended`
    whether the last member came to its end, `failed` whether bytes came that are
    none of such a stream, and `broken` whether a stream could not be read for them.
    """

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.read, self.got, self.ended, self.broken, self.failed = chunks, 0, 0, False, False, False

    def __iter__(self) -> Iterator[bytes]:
        stream, past, gzip = zlib.decompressobj(47), 0, None
        for chunk in self.chunks:
            gzip = chunk[:1] == b"\x1f" if gzip is None else gzip
            for first in range(0, len(chunk), 1 << 16):
                data = chunk[first : first + (1 << 16)]
                past += len(data)
                more = True
                while more:
                    before = stream.copy()
                    try:
                        out = stream.decompress(data, _PIECE)
                    except zlib.error:
                        # What lies before the fault is still content.
                        for k in range(len(data)):
                            try:
                                out = before.decompress(data[k : k + 1])
                            except zlib.error:
                                break
                            self.got += len(out)
                            yield out
                        # After a whole member, other bytes are no part of it. Wrong starts break soon.
                        self.failed, self.broken = True, not self.ended and (gzip or self.got > 4096)
                        return
                    if out:
                        self.got += len(out)
                        self.ended = False
                        yield out
                    if stream.eof:
                        data, self.ended = stream.unused_data, True
                        self.read = past - len(data)
                        stream, more = zlib.decompressobj(47), len(data) > 0
                    else:
                        data = stream.unconsumed_tail
                        more = len(data) > 0 or len(out) == _PIECE
        if not self.ended:
            self.read = past


def _joined(run: str) -> tuple[str, np.ndarray]:
    """The digits of a run without its line breaks, and the place of each."""
    lines = list(re.finditer(r"\S+", run))
    return "".join(m[0] for m in lines), np.concatenate([np.arange(*m.span(), dtype=np.int32) for m in lines])


def _digits(source: Source, start: int) -> Iterator[bytes]:
    """Bytes of the base64 digits from a place in a content on, over line breaks, in pieces."""
    held = b""
    for piece in source():
        skip = min(start, len(piece))
        start -= skip
        part = piece[skip:].translate(None, b" \t\r\n\0")
        end = _OTHER.search(part)
        held += part[: end.start()] if end else part
        whole = len(held) - (len(held) % 4 if not end else 0)
        yield _raw(held[:whole].decode())
        held = held[whole:]
        if end:
            return
    yield _raw(held.decode())


def _safe(data: bytes, whole: bool) -> int:
    """The last place, near the end or anywhere, where neither a secret nor an encoded part can reach over; 0 if there is none."""
    for first in (max(0, len(data) - (1 << 16)), 0)[: 1 + whole]:
        last = 0
        for m in _BREAK.finditer(data, first):
            last = m.end()
        if last:
            return last
    return 0


def _plain(raw: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 or UTF-16 with few control characters."""
    code = "utf-16" if raw[:2] in _MARKS else "utf-8" if raw.count(0) * 3 < len(raw) else "utf-16-le" if raw[1:2] == b"\0" else "utf-16-be"
    try:
        text = raw.decode(code)
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" for c in text)
    return text if text and 10 * odd <= len(text) else None


def _raw(body: str) -> bytes:
    """Bytes of base64 digits of either alphabet, as far as they give whole ones."""
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


class _Parts:
    """What the base64 parts of one text hold, at any depth; each layer is read once.

    Only the kinds inside a part matter, as all of them get the part's span. So
    the layers are a graph by digest, and a part holds the kinds of all layers
    that can be reached from its own: cycles end and no copy is lost.
    """

    def __init__(self, most: int):
        self.most, self.bombs, self.held = most, 0, 0
        self.nodes: dict[bytes, tuple[set[int], set[bytes]]] = {}
        self.work: list[tuple[bytes, bytes | str]] = []
        self.runs: dict[bytes, list[tuple[int, int, bytes, int, bytes]]] = {}
        self.reached: dict[bytes, set[int]] = {}
        self.long: set[bytes] = set()

    def node(self, layer: bytes | str) -> bytes:
        """The key of a layer, either text or a compressed stream, which is put on the list if it is new."""
        key = hashlib.sha256(layer.encode(errors="surrogatepass") if isinstance(layer, str) else b"\0packed" + layer).digest()
        if key not in self.nodes:
            self.nodes[key] = (set(), set())
            self.work.append((key, layer))
            self.held += len(layer)
        return key

    def kinds(self, key: bytes) -> set[int]:
        """All kinds in the layer and below."""
        if key not in self.reached:
            self.read_all()
            met, todo, out = {key}, [key], set()
            while todo:
                own, below = self.nodes[todo.pop()]
                out |= own
                todo += below - met
                met |= below
            self.reached[key] = out
        return self.reached[key]

    def read_all(self) -> None:
        while self.work:
            key, layer = self.work.pop()
            self.held -= len(layer)
            self.read(key, layer)

    def read(self, key: bytes, layer: bytes | str) -> None:
        kinds, below = self.nodes[key]
        if isinstance(layer, bytes):
            self.stream(lambda: _Inflated([layer]), kinds, below)
            return
        kinds |= {s[2] for s in base_spans(layer)}
        for mark, pattern in _ESCAPES:
            if mark in layer and (found := _escapes(layer, pattern)):
                below.add(self.node(found[0]))
        for m in _BASE64.finditer(layer):
            below |= {part[2] for part in self.run(m[0])}

    def stream(self, source: Source, kinds: set[int], below: set[bytes]) -> None:
        """Reads a content of any size, which can be had again and again, with bounded memory.

        It is cut where nothing can reach over. Where no such place comes, as in
        one endless run, pieces overlap, and compressed streams that reach over
        the end of a piece are read by themselves, from their first digit on.
        """
        piece = min(4 * _PIECE, self.most)
        data, total, fresh = b"", 0, True
        content = source()
        for chunk in content:
            self.bombs += total <= self.most < total + len(chunk)
            total += len(chunk)
            data += chunk
            if fresh and total > 2:
                fresh = False
                if _PACKED.match(data):
                    self.packed(source, kinds, below)
            if len(data) < piece:
                continue
            if cut := _safe(data, len(data) > 2 * piece):
                self.text(data[:cut], below)
                data = data[cut:]
            elif len(data) > 2 * piece and len(data := _BLANKS.sub(rb"\1", data)) > 2 * piece:
                for start in self.open(data):
                    self.stream(lambda first=total - len(data) + start: _Inflated(_digits(source, first)), kinds, below)
                self.text(data, below)
                data = data[-piece // 16 :]
        self.text(data, below)
        if content.broken:
            kinds.add(BROKEN)

    def packed(self, source: Source, kinds: set[int], below: set[bytes]) -> None:
        """A content that is a compressed stream itself: a layer, or if it is long, read from its source once."""
        chunks, size, digest = [], 0, hashlib.sha256()
        for chunk in source():
            size += len(chunk)
            digest.update(chunk)
            chunks = [*chunks, chunk] if size <= self.most else []
        if size <= self.most:
            below.add(self.node(b"".join(chunks)))
        elif digest.digest() not in self.long:
            self.long.add(digest.digest())
            self.stream(lambda: _Inflated(source()), kinds, below)

    def open(self, data: bytes) -> Iterator[int]:
        """Places of the first digits of compressed streams that do not end in the data."""
        for wide, pattern in ((1, _TEXT), (2, _WIDE)):
            for t in pattern.finditer(data):
                if t.end() < len(data) - wide:
                    continue
                for m in _BASE64.finditer(t[0].replace(b"\0", b"").decode("latin-1")):
                    chars, at = _joined(m[0])
                    for skip in range(4):
                        raw = _raw(chars.rstrip("=")[skip:])
                        for p in _PACKED.finditer(raw):
                            if p.start() % 3 == 0:
                                part = _Inflated([raw[p.start() :]])
                                for _ in part:
                                    pass
                                if part.got and not part.ended and not part.failed:
                                    yield t.start() + wide * (m.start() + int(at[skip + p.start() * 8 // 6]))

    def text(self, data: bytes, below: set[bytes]) -> None:
        """Puts the texts of a piece on the list as one layer, and reads the list when it holds much."""
        texts = [data.translate(_ASCII)]
        if b"\0" in data:
            data = _ZEROS.sub(b"\0\0", data)
            texts += [m[0].replace(b"\0", b"") for m in _WIDE.finditer(data)]
        if found := _ZEROS.sub(b"\0\0", b"\0".join(texts)).strip(b"\0"):
            below.add(self.node(found.decode()))
        if self.held > 4 * _PIECE:
            self.read_all()

    def streams(self, raws: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        """Alignment, start, end and layer of the compressed streams that start at a whole group; none inside another that ends."""
        past = 0
        starts = ((skip + m.start() * 8 // 6, skip, m.start()) for skip, raw in enumerate(raws) for m in _PACKED.finditer(raw) if m.start() % 3 == 0)
        for place, skip, first in sorted(starts):
            if place < past:
                continue
            part = _Inflated([raws[skip][first:]])
            for _ in part:
                pass
            if part.got or part.broken:
                last = first + part.read if part.ended else len(raws[skip])
                past = skip + last * 8 // 6 if part.ended else past
                yield skip, first, last, self.node(raws[skip][first:last])

    def stretches(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and layer of the stretches of text in bytes."""
        for m in _TEXT.finditer(raw):
            yield *m.span(), self.node(m[0].decode("latin-1"))
        if b"\0" in raw:
            for m in _WIDE.finditer(raw):
                start = m.start() - 2 if raw[max(0, m.start() - 2) : m.start()] in _MARKS else m.start()
                yield start, m.end(), self.node(m[0].replace(b"\0", b"").decode())

    def run(self, run: str) -> list[tuple[int, int, bytes, int, bytes]]:
        """Start, end and layer of the encoded parts of a run of base64 digits and line breaks.

        A part may start at any digit and end before the run does. All starts
        at one distance modulo 4 give the same bytes, so four alignments, both
        alphabets as one, hold every part. Digits before a part can happen to
        look like text, too, so a later start, after a separator, and the layer
        from there come with each part.
        """
        key = hashlib.sha256(run.encode()).digest()
        if key in self.runs:
            return self.runs[key]
        lines, (chars, at), out = list(re.finditer(r"\S+", run)), _joined(run), set()
        if len(lines) > 1:
            out = {(m.start() + a, m.start() + b, k, m.start() + c, d) for m in lines if len(m[0]) >= 16 for a, b, k, c, d in self.run(m[0])}
        body = chars.rstrip("=")
        raws = [_raw(body[skip:]) for skip in range(4)]
        if (text := _plain(raws[0])) is not None:
            layer = self.node(text)
            out.add((0, len(run), layer, 0, layer))
            raws[0] = b""
        parts = [*self.streams(raws), *((skip, *part) for skip, raw in enumerate(raws) for part in self.stretches(raw))]
        for skip, first, last, layer in parts:
            start, end = skip + first * 8 // 6, skip + -(-last * 8 // 6)
            end = len(chars) if end >= len(body) else end
            later, other = start, layer
            if start and body[start - 1] not in _CUTS:
                near = (k + 1 for k in range(start, min(start + 12, end - 16)) if body[k] in _CUTS and (k + 1 - skip) % 4 == 0)
                if found := next(near, 0):
                    later, other = found, self.node(raws[skip][(found - skip) * 6 // 8 : last].decode("latin-1"))
            out.add((int(at[start]), int(at[end - 1]) + 1, layer, int(at[later]), other))
        self.runs[key] = sorted(out)
        return self.runs[key]


def _key(layer: str, places: _Places) -> tuple[bytes, bytes]:
    """One layer at one place: digests of its text and of where it comes from."""
    return hashlib.sha256(layer.encode(errors="surrogatepass")).digest(), places.digest()


def scan(text: str, most: int = 64 << 20) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, number of compressed parts over `most` bytes) of one text.

    A part that unpacks to more than `most` bytes is counted, and read like the others.
    """
    return _scan(text, most)[:3]


def _scan(text: str, most: int = 64 << 20) -> tuple[list[Span], list[Span], int, list[Span]]:
    """What `scan` gives, and the spans of compressed parts that are broken, so that not all of them could be read."""
    base = base_spans(text)
    if not ("%" in text or "\\u" in text or _BASE64.search(text)):
        return base, base, 0, []
    found, parts = {*base}, _Parts(most)
    seen: set[tuple[bytes, bytes]] = set()
    work: list[tuple[str, _Places]] = [(text, _Places())]
    while work:
        layer, places = work.pop()
        for m in _BASE64.finditer(layer):
            for start, end, key, later, other in parts.run(m[0]):
                kinds = parts.kinds(key)
                start, end = (later if kinds <= parts.kinds(other) else start) + m.start(), end + m.start()
                where = places.span(start, end)
                found |= {(*where, kind) for kind in kinds}
        for mark, pattern in _ESCAPES:
            if not (mark in layer and (inner := _escapes(layer, pattern, places))):
                continue
            if (key := _key(*inner)) not in seen:
                seen.add(key)
                found |= {(*inner[1].span(start, end), kind) for start, end, kind in base_spans(inner[0])}
                work.append(inner)
    return base, sorted(s for s in found if s[2] != BROKEN), parts.bombs, sorted(s for s in found if s[2] == BROKEN)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{(*KINDS, 'broken')[kind]}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns with n_assign, n_access, n_hex, base_sha256, spans and n_oversize.

    A null text is empty. Spans count code points, the end exclusive. Columns of
    the same names are replaced; repeated rows are judged one by one.
    """
    fresh = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_oversize")
    kept = [c for c in dict.fromkeys(columns) if c not in fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
        for batch in slices(batches, "_raw"):
            rows = []
            for raw in batch.column("_raw").to_pylist():
                base, every, bombs = scan((raw or b"").decode())
                n = [sum(s[2] == k for s in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), bombs))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *fresh])

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in kept)
    given = docs.select(*kept, F.col("text").cast("binary").alias("_raw"))
    return small_batches(given).mapInArrow(run, schema + "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_oversize long")


def masked(text: str | None, spans: str, mark: str = "[secret]") -> str | None:
    """The text with each span of `find`, overlapping ones together, replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All documents, secrets and broken compressed parts replaced; `n_chars`, if there is one, follows a changed text."""
    docs, restored = set_apart(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = []
            for raw in batch.column("text").to_pylist():
                text = (raw or b"").decode()
                _, spans, _, broken = _scan(text)
                spans += broken
                made.append(masked(text, _listed(spans)).encode() if spans else raw)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if c == "text" else batch.column(c) for c in names], names)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {'binary' if c == 'text' else kinds[c]}" for c in names)
    out = small_batches(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kinds["n_chars"]))
    return restored(out)
