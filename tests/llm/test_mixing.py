import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import mixing

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) + [b"\n"]


def brute(docs):
    """The model bit after bit and word after word, from dictionaries; rows of (n_tokens, n_known, base, score)."""
    train = [words_of(t) for d, t in docs if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2]
    seen = Counter(w for ws in train for w in ws)
    n, kinds = sum(seen.values()), len(seen)

    def sent(w):
        return w if w == b"\n" else w + b" "

    histogram = np.zeros(256, np.int64)
    follows = defaultdict(Counter)
    for w, c in seen.items():
        for i, b in enumerate(sent(w)):
            histogram[b] += c
            for context in {(b" " + w)[max(0, i + 1 - o) : i + 1] for o in mixing.ORDERS}:
                follows[context][b] += c
    code = mixing.Code(histogram)
    way = [[(int(code.node[k]), int(code.bit[k])) for k in range(code.first[b], code.first[b] + code.length[b])] for b in range(256)]
    counts = defaultdict(lambda: [0, 0])
    for context, found in follows.items():
        for b, c in found.items():
            for node, bit in way[b]:
                counts[context, node][bit] += c
    out = []
    for _, text in docs:
        ws = words_of(text)
        base = sum(math.log10((seen[w] + 1) / (n + kinds + 1)) for w in ws)
        total, sent_bytes, at = 0.0, b"", 0
        for k, w in enumerate(ws):
            if k % mixing.LANE == 0:
                gate, before = list(mixing._SHARES), Counter()
            bits = 0.0
            for i, b in enumerate(sent(w)):
                if at % mixing.LANE == 0:
                    weights, fixed = defaultdict(lambda: [float(x) for x in mixing._FIRST]), {}
                at += 1
                contexts = [(b" " + w)[max(0, i + 1 - o) : i + 1] for o in mixing.ORDERS]
                own = weights[sum((context, way[b][0][0]) in counts for context in contexts), i == 0]
                change, moved = [0.0] * 4, {}
                for node, bit in way[b]:
                    x = []
                    for context in contexts:
                        zero, one = counts[context, node] if (context, node) in counts else (0, 0)
                        x.append(round(max(-8.0, min(8.0, math.log((one + 0.4) / (zero + 0.4)))) * 15.875) / 15.875)
                    x.append(0.3)
                    odds = max(-8.0, min(8.0, sum(a * b for a, b in zip(x, own, strict=True))))
                    p = 1 / (1 + math.exp(-odds))
                    change = [c + float(mixing._RATE) * (bit - p) * v for c, v in zip(change, x, strict=True)]
                    bucket = round(odds * 2)
                    mapped = fixed.get(bucket, 1 / (1 + math.exp(-bucket / 2)))
                    moved[bucket] = mapped + float(mixing._STEP) * (bit - mapped)
                    p = 0.75 * p + 0.25 * mapped
                    bits += math.log(p if bit else 1 - p)
                own[:] = [a + c for a, c in zip(own, change, strict=True)]
                fixed |= moved
            place = k % mixing.LANE
            parts = [gate[0] * seen[w] / max(n, 1), gate[1] * math.exp(bits), gate[2] * before[w] / max(place, 1)]
            whole = sum(parts)
            total += math.log(whole)
            gate = [g + mixing._MOVE * (part / whole - g) for g, part in zip(gate, parts, strict=True)]
            before[w] += 1
        out.append((len(ws), sum(seen[w] > 0 for w in ws), base, total / math.log(10)))
    return out


@pytest.fixture
def texts():
    rng = random.Random(5)
    syllables = ["ba", "to", "ki", "re", "lun", "é", "中"]
    return [
        "", None, " \n\t ", "One", "one ONE one.",
        *[" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 90))) for _ in range(40)],
        "same line\n" * 30,
    ]


@pytest.mark.parametrize("pack", [1, 1 << 20])
def test_scores_against_brute_force(spark, docs_of, texts, pack):
    found = {r.doc_id: r for r in mixing.score(docs_of(texts).repartition(3), pack).collect()}
    assert len(found) == len(texts)
    tokens = sum(len(words_of(t)) for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2)
    for k, (n, known, base, score) in enumerate(brute(list(enumerate(texts)))):
        r = found[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-8 * max(1, -base)
        assert abs(r.score - score) < 1e-4 * max(1, -score), (k, r.score, score)


def test_lanes_start_anew(monkeypatch):
    monkeypatch.setattr(mixing, "LANE", 64)
    lanes = mixing.cut(np.array([1, 64, 130]))
    assert [x.tolist() for x in lanes] == [[0, 1, 65, 129, 193], [1, 65, 129, 193, 195], [0, 1, 2, 2, 2]]


def test_probabilities_of_all_bytes_add_up_to_one():
    code = mixing.Code(np.arange(256))
    assert abs(sum(2.0 ** -code.length) - 1) < 1e-12
    assert len({tuple(zip(code.node[f : f + n], code.bit[f : f + n], strict=True)) for f, n in zip(code.first, code.length, strict=True)}) == 256


def test_small_ranges_and_parts_give_the_same_scores(docs_of, texts, monkeypatch):
    def scores():
        return {r.doc_id: (r.score, r.base_score, r.n_known) for r in mixing.score(docs_of(texts).repartition(3), 1).collect()}

    whole = scores()
    monkeypatch.setattr(mixing, "RANGE", 40)
    assert scores() == whole


def test_a_pack_lists_each_hash_once_and_short(docs_of, texts):
    rows = mixing.packs(docs_of(texts).repartition(1), 1 << 20).collect()
    (pack,) = [r for r in rows if r.words is not None]
    known = Counter(w for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2 for w in words_of(t))
    contexts, pairs = set(), set()
    for w in {w for t in texts for w in words_of(t)}:
        own = b" " + w + (b"" if w == b"\n" else b" ")
        found = {(own[max(0, i - o) : i], own[i]) for i in range(1, len(own)) for o in mixing.ORDERS}
        contexts |= {context for context, _ in found} | {(w,)}
        pairs |= found | {((w,), 256)} if known[w] else set()
    assert len(pack["keys"]) < 8 * len(contexts)
    assert len(zlib.decompress(pack["values"])) == 2 * len(pairs)
    key, size, value, n = mixing._read(pack["keys"], pack["sizes"], pack["values"], pack["counts"])
    assert len(key) == len(contexts) and (key[1:] > key[:-1]).all()
    assert size.sum() == len(value) == len(n) == len(pairs) and n[value == mixing.WORD].sum() == known.total()


def test_hashes_and_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert (mixing.unstepped(mixing.steps(keys)) == keys).all()
        numbers = rng.integers(-(2**62), 2**62, n)
        assert (mixing.unsqueezed(mixing.squeezed(numbers), np.int64) == numbers).all()


def test_words_of_odd_texts():
    texts = [b"", b" ", b"A\x0bb\x1cC\xc2\x85d\xc2\xa0e", "Ä ä\u2003É".encode(), b"\xff\xfe Z\x00z", b"\t a a\r\n", b"".join(bytes([b, 32]) for b in range(256))]
    words, ids = mixing.split(texts)
    assert [[words[i - 1] for i in x[:-1]] for x in ids] == [t.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() for t in texts]
    assert [x[-1] for x in ids] == [0] * len(texts) and len(set(words)) == len(words)


def test_bytes_of_the_same_contexts_are_kept_once():
    lexicon = mixing.Lexicon([b"abcdefghij" + bytes([k]) for k in range(97, 122)])
    code = mixing.Code(np.arange(256))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = mixing.Bits(lexicon, code, *mixing.log_odds(code, lexicon, *none))
    assert len(bits.number) == int(lexicon.size.sum()) and len(bits.tables[0]) == int(bits.number.max()) + 1 == 1 + 10 + 2 * 25


def test_edges(docs_of):
    assert mixing.score(docs_of([])).count() == 0
    held = next(k for k in range(100) if mixing.held_out(k))
    (r,) = mixing.score(docs_of([(held, "unknown words")])).collect()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0
    rows = mixing.score(docs_of([(None, "a b"), (None, "a b"), (3, None)])).collect()
    assert len(rows) == 3 and {r.train_tokens for r in rows} == {7}


def test_long_text_and_long_word(docs_of):
    rows = mixing.score(docs_of(["ab " * 9000, "x" * 30_000, "ab"])).collect()
    assert all(math.isfinite(r.score) for r in rows)
    assert [r.n_bytes for r in sorted(rows, key=lambda r: r.doc_id)] == [27_001, 30_002, 4]


def test_known_language_costs_less(docs_of):
    """Held-out texts of the trained language cost fewer bits a byte than texts of shuffled letters."""
    rng = random.Random(1)
    syllables = ["ba", "to", "ki", "re", "lun", "sa", "mi"]
    docs = [(k, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60))) for k in range(150)]
    odd = [(k + 1000, "".join(rng.sample(t, len(t)))) for k, t in docs if mixing.held_out(k + 1000)]
    rows = mixing.score(docs_of(docs + odd)).collect()
    plain = [r.bits_per_byte for r in rows if r.held_out and r.doc_id < 1000]
    assert max(plain) < min(r.bits_per_byte for r in rows if r.doc_id >= 1000)
