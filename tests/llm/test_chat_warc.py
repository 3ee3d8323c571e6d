import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from tapeloom.llm import chat, shared, warc

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yö"), (1, 3, None, None), (1, 3, "ann", ""), (1, 3, "ann", ""),
    (2, 0, "system", "alone"), (3, None, "ann", "no number"), (3, 7, "bob", "x"), (None, 1, "ann", "no id"), (None, 1, "bob", "no id"),
    *[(4, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(-3, 150)], *[(5, 1, "ann", "again")] * 140, (5, 2, "bob", "long " * 30_000),
]


def brute_blocks(turns, size):
    """(conv, block) -> ordered turns; blocks of turns without a number are put together as block None."""
    cells = defaultdict(list)
    for conv, turn, role, text in turns:
        speaker, text = (role or "unknown").replace("<|", "< |"), (text or "").replace("<|", "< |")
        cells[conv, None if turn is None else turn // size].append((turn, speaker, text))
    return {(conv, block, k // size): sorted(rows)[k : k + size] for (conv, block), rows in cells.items() for k in range(0, len(rows), size)}


def test_every_speaker_sees_every_block(spark):
    table = spark.createDataFrame([(*t, 1, "m") for t in TURNS], "conv_id long, turn int, role string, text string, part int, mask string")
    rows = chat.rotate(table).collect()
    speakers = defaultdict(set)
    for conv, _, role, _ in TURNS:
        if role != "system":
            speakers[conv].add(role or "unknown")
    expected = {}
    for (conv, block, part), said in brute_blocks(TURNS, 64).items():
        for me in speakers[conv]:
            text, mask = "", []
            for _, speaker, body in said:
                name = "assistant" if speaker == me else "system" if speaker == "system" else f"user name={speaker}"
                text += f"<|im_start|>{name}\n"
                if speaker == me:
                    mask.append((len(text), len(text) + len(body) + len("<|im_end|>")))
                text += f"{body}<|im_end|>\n"
            expected[conv, me, block, part] = (len(said), text, mask, sum(b - a for a, b in mask))
    got = {(r.conv_id, r.speaker, r.block if r.block >= -1 else None, r.part): (r.n_turns, r.rendered, [tuple(m) for m in r["mask"]], r.n_learn) for r in rows}
    assert len(rows) == len(got) and got == expected
    assert chat.rotate(table.limit(0)).count() == 0


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "u\r\nv", None), (4, "x", ""), (5, "é", "é" * 200_000), (6, "é", "é" * 200_000),
         (7, "y", "WARC/1.1\r\n\r\n"), (8, "z", "only"), (11, "t", "twice"), (11, "t", "twice"), (None, "n", "none"), (None, "n", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_from_archives(spark, least):
    table = spark.createDataFrame([(*p, 0, "x") for p in PAGES], "page_id long, url string, html string, size int, original string").repartition(3)
    archives = warc.write(table, least=least, archive_bytes=1 << 18)
    chunks = warc.read(archives, chunk_bytes=1000)
    rows = sorted((tuple(r) for r in warc.digests(chunks).collect()), key=str)
    payloads = [(p, (h or "").encode()) for p, _, h in PAGES]
    expected = []
    for page, data in payloads:
        top = max((p for p, d in payloads if d == data and p is not None), default=None)
        revisit = len(data) >= least and page is not None and page != top
        expected.append((page, len(data), sha(data), "revisit" if revisit else "response", top if revisit else None))
    assert rows == sorted(expected, key=str)
    parts = defaultdict(list)
    for c in chunks.where("record_type = 'response'").collect():
        assert len(c.data) <= 1000
        parts[c.page_id, c.declared_digest].append(c)
    for (_, digest), own in parts.items():
        if len({c.chunk for c in own}) == len(own):
            data = b"".join(c.data for c in sorted(own, key=lambda c: c.chunk))
            assert sha(data) == digest
            for c in own:
                assert c.digest_so_far == sha(data[: c.bytes_so_far])
    urls = {r.page_id: r.url for r in chunks.collect()}
    assert urls[3] == "u%0D%0Av" and urls[9] is None and urls[5] == "é"


def test_no_pages_no_archives(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(table)).count() == 0


def test_damaged_archives_are_refused(tmp_path):
    out = io.BytesIO()
    warc.write_record(out, 1, "u", memoryview(b"payload"), None, 3)
    whole = gzip.decompress(out.getvalue())
    assert [r[8] for r in warc.records(io.BytesIO(out.getvalue()), 4)] == [b"payl", b"oad"]
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(whole[:-8])), 4))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole.replace(b"Content-Length: 7", b"Content-Length: 5"))), 4))
    path = shared.new_file(f"{tmp_path}/deep/er", "x", ".gz")
    with shared.writer(path) as stream:
        stream.write(out.getvalue())
    with shared.reader(path) as stream:
        assert len(list(warc.records(stream, 100))) == 1
