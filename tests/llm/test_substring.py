import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import substring

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WS.findall(t or "") for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for own, doc in zip(words, ids, strict=True):
        for k in range(len(own) - size + 1):
            win = tuple(own[k : k + size])
            first[win] = min(first.get(win, doc), doc)
    out = []
    for (doc_id, _), own, doc in zip(rows, words, ids, strict=True):
        gone = {k + j for k in range(len(own) - size + 1) if first[tuple(own[k : k + size])] < doc for j in range(size)}
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.choice([4, 5, 9, 13, 14, 40]))] for k in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abc") + rng.choice("é12") for _ in range(rng.randrange(12))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[3][1]), (None, rows[4][1]), (7, rows[9][1] + " x"), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(-5, rows[11][1]), (n + 3, "same " * 3000), (n + 4, "same " * 40), (n + 5, " ".join(p for x in passages for p in x) * 2)]


@pytest.mark.parametrize(("size", "seed", "unit"), [(13, 7, 4_000_000), (13, 3, 50), (5, 5, 10), (14, 1, 500)])
def test_removal_against_brute_force(docs_of, size, seed, unit, monkeypatch):
    rows = corpus(size)
    found = substring.repeats
    monkeypatch.setattr(substring, "repeats", lambda docs, a, b: found(docs, a, b, unit=unit))
    got = substring.remove(docs_of(rows).repartition(5), size, seed, with_text=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size)


def test_buckets_follow_the_text_and_stay_small(docs_of, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 900}" for j in range(200))) for k in range(200)]
    docs = docs_of(rows)
    given = substring.keyed(docs)
    some = substring.bucket_count(given, 2000)
    assert substring.bucket_count(given.unionAll(given), 2000) in (2 * some - 1, 2 * some) and substring.bucket_count(given, 10**9) == 32
    sent = substring._send(given, 13, 7, None, some, 1000).where(f"kind = {substring.ASK}")
    held = [r[1] for r in sent.selectExpr("bucket", "length(hashes) / 8 AS n").groupBy("bucket").sum("n").collect()]
    assert max(held) <= 1000 and len(held) > some // 2
    found = substring.repeats
    monkeypatch.setattr(substring, "repeats", lambda docs, a, b: found(docs, a, b, bucket_bytes=2000))
    assert sorted((tuple(r) for r in substring.remove(docs, with_text=True).collect()), key=str) == brute(rows, 13)


def test_nothing_repeated(docs_of):
    assert substring.remove(docs_of([])).count() == 0
    assert [r.n_removed for r in substring.remove(docs_of(["a b c", None, "d " * 5])).collect()] == [0, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 12))
def test_representatives(values, width):
    hashes = np.array(values, np.uint64)
    starts = np.arange(max(0, len(values) - width + 1))
    if len(starts):
        assert substring.representatives(hashes, width, starts).tolist() == [int(k + np.argmin(values[k : k + width])) for k in starts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1 << 30), unique=True))
def test_places_survive_packing(places):
    places = np.array(sorted(places), np.int64)
    assert substring.unpacked(substring.packed(places), len(places)).tolist() == places.tolist()
    assert substring.lengths(50, 7) == [7, 14, 28, 50] and substring.lengths(13, 7) == [7, 13]
