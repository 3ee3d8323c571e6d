import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import alignment, tokens

A, B = tokens.find(tokens.BYTE_BPE), tokens.find(alignment.PIECE_BPE)
TEXTS = ["the same words", "the same words", "", None, "  two  blanks\n\n\tand a line \r\n end ", "naïve café 中文 🙂 é", "a▁b", "<|endoftext|><s> <0x41> x",
         "x" * 3000, "ab" * 700 + " tail", "a\x00b\x1c c\x85d　e", "don't we'll I'M", " ".join(f"Unhappily{i}" for i in range(400))]


@pytest.fixture(scope="module")
def plain():
    """Whole-text encoding and alignment by positions alone, without parts, dictionaries or caches."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in chars}
    for c in range(256):
        if c not in chars:
            table[chr(256 + len(table) - len(chars))] = c

    def of(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        out, j, at_a, at_b, own_a, own_b = [], 0, 0, 0, [], []
        for i, x in zip(ids_a, bytes_a, strict=True):
            own_a.append(i)
            at_a += len(x)
            while at_b < at_a:
                own_b.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                out.append((own_a, own_b))
                own_a, own_b = [], []
        return out

    return of


def shown(found):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found or [])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab eTh.\n\t\r  ,é́\x85ß中!-_ſ'llD<|>▁　\x1c0")), max_size=40))
def test_parts_give_the_groups_of_the_whole(plain, text):
    pack = alignment._Pack(A, B)
    assert pack.shown(pack.numbers([text])[0]) == shown(plain(text))


def test_documents_against_brute_force(spark, docs_of, plain):
    every = [plain(t) for t in TEXTS]
    counts, links = Counter(), []
    for found in every:
        own = Counter((x, y) for xs, ys in found or [] for x in xs for y in ys)
        counts.update(own.keys())
        links.append(own)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for size in (1, 500, 1 << 24):
        rows = {r.doc_id: r for r in alignment.compare(docs_of(TEXTS).repartition(3), A, B, size).collect()}
        assert len(rows) == len(TEXTS)
        for k, found in enumerate(every):
            r, own = rows[k], links[k]
            assert (r.n_a, r.n_b, r.n_groups) == (sum(len(x) for x, _ in found or []), sum(len(y) for _, y in found or []), len(found or []))
            assert r.n_links == sum(own.values())
            assert r.n_best == sum(n for p, n in own.items() if counts[p] == best[p[0]])
            assert r.count_sum == sum(n * counts[p] for p, n in own.items())
            assert r.groups_sha256 == (hashlib.sha256(shown(found).encode()).hexdigest() if found else "")


def test_groups_themselves(docs_of, plain):
    rows = {r.doc_id: r.groups for r in alignment.groups(docs_of(TEXTS), A, B).collect()}
    assert rows == {k: shown(plain(t)) for k, t in enumerate(TEXTS)}


def test_empty_tables_repeated_rows_and_no_ids(docs_of):
    assert alignment.compare(docs_of([]), A, B).count() == 0
    assert [r.n_links for r in alignment.compare(docs_of([None, ""]), A, B).collect()] == [0, 0]
    rows = alignment.compare(docs_of([(7, "word"), (7, "word"), (None, "word")]), A, B).collect()
    assert {r.count_sum for r in rows} == {3} and len(rows) == 3


def test_slices_of_shared_ends():
    assert alignment.align([2, 5, 9], [5, 7, 9]) == [(0, 2, 0, 1), (2, 3, 1, 3)]
    assert alignment.align([], []) == []
