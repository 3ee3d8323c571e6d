import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import neardup
from tapeloom.llm.components import components

WS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, size, similarity):
    """Component of each doc_id over pairs of texts, rows of one doc_id being one node."""
    sets = []
    for _, text in rows:
        words = WS.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, a), (y, b) in combinations(zip([i for i, _ in rows], sets, strict=True), 2):
        if x is not None and y is not None and a and b and 100 * len(a & b) >= similarity * len(a | b):
            x, y = sorted((root(x), root(y)))
            parent[y] = x
    smallest = {}
    for i in parent:
        smallest[root(i)] = min(i, smallest.get(root(i), i))
    out = [(i, len(s), None if i is None else smallest[root(i)], i is None or smallest[root(i)] == i) for (i, _), s in zip(rows, sets, strict=True)]
    return sorted(out, key=str)


def corpus(seed, groups=12, most=14, words=60):
    rng = random.Random(seed)
    rows, common = [], [f"c{k}" for k in range(25)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}é" for _ in range(rng.randrange(5, words))] + common * (g % 3)
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            text = rng.choice([" ", "\n"]).join(own)
            rows.append(text.upper() if rng.random() < 0.1 and "é" not in text else text)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (9003, "one two"), (9004, "ONE two"), (9005, "one two three"), (9006, "one"), (None, rows[0][1]),
                   (9007, rows[1][1]), (9007, rows[1][1]), (9008, rows[2][1]), (9008, rows[5][1]), (9009, "long text " * 4000)]


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_classes_against_brute_force(docs_of, seed, size):
    rows = corpus(seed)
    got = neardup.near_duplicates(docs_of(rows), size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, 80)


def test_blocks_give_the_same_classes(docs_of, monkeypatch):
    rows = corpus(7, groups=3, most=40)
    lists, full = neardup.candidates, neardup.confirmed
    monkeypatch.setattr(neardup, "candidates", lambda reps: lists(reps, list_block=7))
    monkeypatch.setattr(neardup, "confirmed", lambda *a: full(*a, block_shingles=300))
    got = neardup.near_duplicates(docs_of(rows), 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 80)


def test_nothing_to_link(docs_of):
    assert neardup.near_duplicates(docs_of([])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(docs_of([None, "", "alone here"])).collect()] == [True] * 3
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs_of([]), similarity=70)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=12))
def test_classes_of_one_group(sets):
    got = neardup.classes([np.array(sorted(s), np.uint64) for s in sets], 80)
    parent = list(range(len(sets)))
    for x, y in combinations(range(len(sets)), 2):
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            a, b = parent[x], parent[y]
            parent = [a if p == b else p for p in parent]
    assert len({*zip(parent, got.tolist(), strict=True)}) == len({*parent}) == len({*got.tolist()})


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])  # 1800 of 2200 in common
    hits = []
    for k in range(40):
        salt = np.uint64(k * 7919)
        x, y = neardup.signatures([neardup.T.mixed(a ^ salt), neardup.T.mixed(b ^ salt)])
        hits.append(int((x == y).sum()))
    assert 0.78 < np.mean(hits) / neardup.COORDINATES < 0.86 and min(hits) > neardup.MATCHES


def test_groups_are_whole_over_batches():
    batches = [pa.RecordBatch.from_pydict({"g": g, "pair": [0] * len(g), "x": g}) for g in ([1], [1, 1], [2, 3], [3], [3, 4])]
    seen = []
    for ends, table in neardup._groups(iter(batches), ("g", "pair")):
        start = 0
        for end in ends:
            seen.append(table["g"].to_pylist()[start:end])
            start = end
    assert seen == [[1, 1, 1], [2], [3, 3, 3], [4]]


@pytest.mark.parametrize("seed", range(2))
def test_components_of_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(10**9), 400)
    links = list(zip(nodes[:150], nodes[1:151], strict=True)) + [(nodes[200], x) for x in nodes[201:300]] + [(nodes[300], nodes[301]), (nodes[302], nodes[302])]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(None, 1)], "a long, b long")).collect()}
    expected = {x: min(nodes[:151]) for x in nodes[:151]} | {x: min(nodes[200:300]) for x in nodes[200:300]} | {x: min(nodes[300:302]) for x in nodes[300:302]}
    assert got == expected
