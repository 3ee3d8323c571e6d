import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import packing, shared, tokenfile, tokens

WORD, BYTE = tokens.find(tokens.WORD_BPE), tokens.find(tokens.BYTE_BPE)
TEXTS = ["", None, "a", "the same", "the same", "  two  blanks\n\n\tand more ", "don't stop", "été ²𝟘 中文", "<|endoftext|> x", "a\x1cb",
         " ".join(f"word{i} of" for i in range(9000)), "x" * 50_000]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab é'st1 .\n\t  ,ßñ́\x85²𝟘中!-_ſ'llD<|")), max_size=30))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_ids_of_the_whole(path, text):
    encoder = tokens.Encoder.of(path)
    assert encoder.encode(text) == encoder.whole(text)


def brute_ids(path, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_places_every_id_once(docs_of):
    rows = packing.pack(docs_of(TEXTS), WORD, 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, text in enumerate(TEXTS):
        ids = brute_ids(WORD, text)
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + 64], "<u4").tobytes())
            assert r.length == len(ids[r.start : r.start + 64])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_sequences_hold_the_ids(docs_of):
    made = packing.sequences(packing.pack(docs_of(TEXTS[:8]), WORD, 64, keep_ids=True)).collect()
    assert sum(r.n_tokens for r in made) == sum(len(brute_ids(WORD, t)) for t in TEXTS[:8])
    assert all(len(r.ids) == 4 * r.n_tokens <= 256 for r in made)


def test_no_rows_no_sequences(docs_of):
    assert packing.pack(docs_of([]), WORD, 64).count() == 0
    assert tokenfile.read(tokenfile.write(docs_of([]), BYTE, 50_257)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30)))
def test_plan_uses_every_piece_and_wastes_little(counts):
    made = packing.plan(counts, 40)
    used = defaultdict(int)
    for pattern, n in made:
        assert n > 0 and sum(length * each for length, each in pattern) <= 40
        for length, each in pattern:
            used[length] += each * n
    assert dict(used) == counts
    assert sum(n for _, n in made) <= 11 / 9 * sum(k * n for k, n in counts.items()) / 40 * 1.5 + 2


def test_exact_complements_fill_sequences():
    # 30 + 10, 20 + 12 + 8 and 16 + 11 + 7 + 6 leave no room at all.
    made = packing.plan({30: 3, 10: 3, 20: 2, 12: 2, 8: 2, 16: 1, 11: 1, 7: 1, 6: 1}, 40)
    assert sum(n for _, n in made) == 6


def test_files_come_back_in_order(docs_of):
    rows = [(k * 7 % 12, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a repeated id"), (3, None)]
    files = tokenfile.write(docs_of(rows), BYTE, 50_257, shard_ids=3000, least=2)
    assert files.count() > 2
    got = tokenfile.read(files, block_ids=500, keep_ids=True).collect()
    got.sort(key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    at = 0
    for r, (_, text) in zip(got, order, strict=True):
        ids = np.array(brute_ids(BYTE, text), "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    assert files.agg({"symbols": "sum"}).first()[0] < at / 2  # the grammar shrinks the repeated text


def test_grammar_reads_any_document(tmp_path):
    rng = random.Random(5)
    lists = [[rng.randrange(6) for _ in range(rng.randrange(40))] + [0] for _ in range(200)]
    starts = np.cumsum([0, *map(len, lists)]).astype(np.int64)
    path = f"{tmp_path}/a.ids"
    symbols, rules = tokenfile.write_shard(path, [*range(199), None], np.array(sum(lists, []), "<u4"), starts, 6, 5, 300, 2)
    assert rules > 50 and symbols < starts[-1] * 0.7
    with shared.reader(path) as stream:
        shard = tokenfile.Shard(stream)
        assert shard.doc_ids == [*range(199), None]
        for k in rng.sample(range(200), 60):
            assert shard.documents(k, k + 1).tolist() == lists[k]
        for k, (a, b) in enumerate(shard.rules.tolist()):
            assert shard.sizes[k] == shard.length[a] + shard.length[b]
