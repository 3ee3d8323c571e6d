import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import decontam, quality, secrets, urls
from tapeloom.llm import text as T

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 17))
def test_window_hashes_are_equal_where_windows_are(words, size):
    found = T.windows(T.WordHashes(limit=3).of([w.encode() for w in words]), size)
    real = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
    assert len(found) == len(real) and len({*zip(real, found.tolist(), strict=True)}) == len({*real}) == len({*found.tolist()})


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aB9 é\x0b\x1c\x85\n#*!İK")), max_size=60))
def test_words_are_the_contracts_words(text):
    assert [w.decode() for w in text.encode().split()] == WS.findall(text)
    assert [w.decode() for w in text.encode().translate(T.ALNUM).split()] == ALNUM.findall(text.translate(LOWER))
    assert text.encode().translate(T.LOWER).decode() == text.translate(LOWER)


def brute_hits(text, items, size):
    words, hit, names = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        width = min(size, len(own))
        wins = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if own else set()
        for k in range(len(words) - width + 1 if wins else 0):
            if tuple(words[k : k + width]) in wins:
                hit.update(range(k, k + width))
                names.add(item)
    return words, hit, names


@pytest.mark.parametrize("block", [2, 100_000])
def test_decontamination_against_brute_force(spark, docs_of, block):
    rng = random.Random(3)
    vocabulary = ["Été", "b", "c3", "D"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([0, 1 + 4, 6, 9, 12, 30])] + [(7, None), (2, "c3 c3 c3 D D"), (9, "--- !")]
    texts = [None, "", "?", "été.b"] + [rng.choice("- \n").join(rng.choices(vocabulary, k=rng.choice([3, 20, 60]))) for _ in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(docs_of(texts + texts[:3]), bench, 6, block_windows=block)
    for r in decontam.report(found).collect():
        words, hit, names = brute_hits((texts + texts[:3])[r.doc_id], items, 6)
        listed = ",".join(sorted(map(str, names)))
        assert tuple(r)[1:] == (len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)), r
    left = decontam.remove(docs_of(texts + texts[:3]), bench, 6, block_windows=block)
    assert left.columns == docs_of([]).columns and left.dtypes == docs_of([]).dtypes
    got = {r.doc_id: r.text for r in left.collect()}
    for k, text in enumerate(texts):
        words, hit, _ = brute_hits(text, items, 6)
        assert (k in got) == (2 * len(hit) <= len(words))
        if k in got:
            assert ALNUM.findall((got[k] or "").translate(LOWER)) == [w for i, w in enumerate(words) if i not in hit]


def test_no_benchmark_hits_nothing(spark, docs_of):
    rows = decontam.find(docs_of(["a b", None]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.n_words, r.hits, r["items"]) for r in rows] == [(2, [], []), (0, [], [])]
    assert decontam.find(docs_of([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


URLS = [None, "", "no scheme", "HTTP://A.Net/x?://", "http://net/", "http://net", "https://x.example.net/en/1?ads=1&track=2", "https://example.net/de/free-win",
        "https://xexample.com/de/", "https://a.example.com/de/é#x", "http://org/fr/casino", "http://a.io/Casino!", "http://a.io/casinos/xporn", "http://a.io/free-FREE",
        "http://a.io/free?win", "http://a.io/éfree/ßwin", "a://b://c/d?e#f", "http://evil.org?/fr/"]


def test_urls_against_plain_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(URLS)] + [(None, URLS[6], "h", "y")], "page_id long, url string, html string, host string")
    for r in urls.judge(pages).collect():
        url = URLS[6 if r.page_id is None else r.page_id] or ""
        host, path = "", ""
        if m := re.search(r"://([^/?#]*)([^?#]*)", url):
            host, path = m[1].translate(LOWER), m[2]
        fits = [(len(x), x, v) for v, x in urls.RULES for h, p in [x.split("/", 1)] if f".{host}".endswith(f".{h}") and path.startswith(f"/{p}")]
        words = re.split(r"[^a-z0-9]+", url.translate(LOWER))
        strict, soft = {*words} & {*urls.STRICT}, {*words} & {*urls.SOFT}
        _, rule, verdict = max(fits, default=(0, None, "block" if strict or len(soft) > 1 else "allow"))
        assert (r.host, r.path, r.rule, r.verdict, r.n_strict, r.n_soft) == (host, path, rule, verdict, len(strict), len(soft)), url
    assert urls.judge(pages.limit(0)).count() == 0


def brute_counts(text):
    words = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside),
            len(lines), sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B!", "é#", "\n", "\n\n", " \t", "\x0b", "a b c d e f g h", "x\x85y"]), max_size=40))
def test_counts_against_brute_force(parts):
    text = " ".join(parts)
    assert quality.counts(text.encode(), T.WordHashes()) == brute_counts(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.floats(0.005, 0.2), st.floats(0.001, 0.2), st.integers(0, 10**6))
def test_cutoffs_keep_their_bound(n, risk, level, seed):
    values = np.random.default_rng(seed).integers(0, 1001, n)
    grid, counts = np.unique(values, return_counts=True)
    cut = quality.cutoff(grid, counts, risk, level)

    def proven(at):
        k = int((values >= at).sum())
        exact = sum(np.exp(quality.lgamma(n + 1) - quality.lgamma(i + 1) - quality.lgamma(n - i + 1)) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        return k < n and exact <= level * (1 + 1e-9)

    best = next((t for t in range(1, 1001) if proven(t)), 1001)
    assert cut == best if proven(1001) else cut == 1001


def test_quality_keeps_good_documents(spark, docs_of):
    rng = random.Random(1)

    def good(k):
        return " ".join(f"word{rng.randrange(10**6)}" for _ in range(30 + k % 9))

    texts = [good(k) for k in range(3000)] + [f"## {good(k)} ## {'#' * 150}" for k in range(40)] + ["", None, "short", "a b c d e f g h " * 30]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(k, 1 if k < 3000 else 0, None) for k in range(3040)] + [(None, 1, 0), (5, None, 0), (3001, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(docs, labels, risk=0.03).collect()}
    assert len(rows) == len(texts)
    assert sum(not rows[k].kept for k in range(3000)) <= 90
    assert not any(rows[k].kept for k in range(3000, 3040))
    assert all(rows[k].base_failed and not rows[k].kept for k in range(3040, 3044))
    few = quality.judge(docs, labels.where("doc_id < 40"), risk=0.03).where("not kept").count()
    assert few == 4  # nothing can be proven from 40 documents, so only the base rules reject
    assert quality.judge(docs_of([]), labels).count() == quality.judge(docs, labels.limit(0)).count() - len(texts) == 0


def brute_base(text):
    kinds = ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("AKIA[A-Z0-9]+", 0, 0, 20), ("[0-9a-f]+", 0, 0, 24))
    return [(m.start(), m.end(), k) for k, (p, flags, group, least) in enumerate(kinds) for m in re.finditer(p, text, flags) if len(m[group]) >= least]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_KEY", "ſecret", ":", "=", '"', " ", "abc", "AKIA", "Z9" * 8, "0a" * 12, "f", "é", "%41", "\\u0041", "\n"]), max_size=14))
def test_base_secrets_against_the_patterns(parts):
    text = "".join(parts)
    base, every, _ = secrets.scan(text)
    assert sorted(base) == sorted(brute_base(text)) and {*base} <= {*every}


PLAIN = "password=abcdef99"
WRAPS = {
    "url": lambda s: quote(s, safe="").replace("p", "%70"),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_layers_are_unwrapped(outer, inner):
    part = WRAPS[outer](WRAPS[inner](PLAIN))
    text = f"é before {part} after"
    base, every, bombs = secrets.scan(text)
    assert base == sorted(brute_base(text)) and bombs == 0
    found = {(a, b) for a, b, kind in every if kind == 0}
    assert found and all(text.index(part) <= a and b <= text.index(part) + len(part) for a, b in found)
    assert "abcdef99" not in secrets.masked(text, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in every))


def test_cycles_end_and_bombs_are_counted():
    assert secrets.scan("%25" * 3000)[1] == []
    assert secrets.scan("%2525252541 \\u005cu0041")[2] == 0
    bomb = base64.b64encode(zlib.compress(bytes(1 << 22))).decode()
    later = base64.b64encode(PLAIN.encode()).decode()
    assert secrets.scan(f"{bomb} {later}", most=1 << 20)[1:] == ([(len(bomb) + 1, len(bomb) + 1 + len(later.rstrip('=')) + later.count('='), 0)], 1)


def test_every_copy_of_an_encoded_secret_is_found():
    one, two = WRAPS["base64"](PLAIN), WRAPS["gzip"](PLAIN)
    nested = WRAPS["base64"](WRAPS["base64"](PLAIN))
    text = f"k1: {one} k2: {two} k3: {one} k4: {nested} k5: {quote(PLAIN, safe='').replace('p', '%70')} k6: {nested}"
    found = {(a, b) for a, b, _ in secrets.scan(text)[1]}
    parts = [m.span() for part in (one, two, nested) for m in re.finditer(rf"(?<!\S){re.escape(part)}", text)]
    assert len(parts) == 5 and {*parts} <= found and len(found) == 6


def wrapped(raw: bytes, width: int = 76) -> str:
    flat = base64.b64encode(raw).decode()
    return "\n".join(flat[k : k + width] for k in range(0, len(flat), width))


NOISE = random.Random(5).randbytes(600).hex(" ").encode()


@pytest.mark.parametrize("prefix", ["https://h.example/cb/", "x/", "sk_", "sk-", "a+", "Basic", "v1/ab/cde_", "=", ""])
@pytest.mark.parametrize("raw", [PLAIN.encode(), gzip.compress(PLAIN.encode()), zlib.compress(PLAIN.encode()), PLAIN.encode("utf-16"), PLAIN.encode("utf-16-le"), PLAIN.encode("utf-16-be")])
def test_encoded_parts_are_found_after_a_prefix(prefix, raw):
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        for end in ("", "/more_path-x", "\nnext"):
            part = encode(raw).decode() if not end else encode(raw).decode().rstrip("=")
            text = f"see {prefix}{part}{end} after"
            spans = [(a, b) for a, b, kind in secrets.scan(text)[1] if kind == 0]
            at = text.index(part)
            assert any(at - 6 <= a <= at + 4 and b >= at + 4 * 16 // 3 for a, b in spans), (text, spans)
            if prefix in ("https://h.example/cb/", "x/", "sk_", "=", "") and not end and raw == PLAIN.encode():
                assert spans == [(at, at + len(part))]


@pytest.mark.parametrize("raw", [NOISE + b" " + PLAIN.encode(), gzip.compress(NOISE + PLAIN.encode()), b"x" * 48 + PLAIN.encode(), (NOISE.decode() + PLAIN).encode("utf-16")])
def test_wrapped_base64_is_one_part(raw):
    for brk in ("\n", "\r\n", "\n    "):
        part = wrapped(raw).replace("\n", brk)
        text = f"key: {part}\n-- after"
        assert (5, 5 + len(part), 0) in secrets.scan(text)[1]


BULK = b"ab, \n" * 40_000
TIGHT = base64.b64encode(random.Random(6).randbytes(120_000))


@pytest.mark.parametrize("most", [1 << 14, 64 << 20])
@pytest.mark.parametrize("content", [
    BULK + PLAIN.encode() + BULK, BULK + wrapped(PLAIN.encode() * 9).encode(), gzip.compress(BULK + PLAIN.encode()), TIGHT + b" " + PLAIN.encode(),
    TIGHT + WRAPS["base64"](PLAIN).encode(), b" ".join([BULK, base64.b64encode(gzip.compress(random.Random(7).randbytes(90_000) + b" " + PLAIN.encode()))]),
    (BULK.decode() + PLAIN + BULK.decode()).encode("utf-16"), b"0" * 90_000 + b"password" + b" " * 90_000 + b"=" + b" " * 9 + b"abcdef99",
])
def test_contents_of_any_size_are_read(monkeypatch, content, most):
    if most < 1 << 20:
        monkeypatch.setattr(secrets, "_PIECE", most // 4)
    for packed in (gzip.compress(content), zlib.compress(content), gzip.compress(content[:40]) + gzip.compress(content[40:]) + gzip.compress(b" last")):
        part = base64.b64encode(packed).decode()
        assert (4, 4 + len(part), 0) in secrets.scan(f"see {part} after", most=most)[1]


def test_broken_streams_are_masked_and_circles_end(docs_of):
    good = gzip.compress(random.Random(8).randbytes(9000) + PLAIN.encode())
    bad = base64.b64encode(good[:5000] + b"\xff" * 40 + good[5040:]).decode()
    early = base64.b64encode(gzip.compress(PLAIN.encode() + random.Random(8).randbytes(90_000))[:-50_000] + b"\xff" * 90_000).decode()
    out = sorted(secrets.mask(docs_of([f"a {bad} b", f"a {early} b", "a plain text"])).collect())
    assert [r.text for r in out] == ["a [secret] b", "a [secret] b", "a plain text"]
    assert (2, 2 + len(early), 0) in secrets.scan(f"a {early} b")[1]
    parts = secrets._Parts(1 << 20)
    circle = b"\x1f\x8b\x08 a stream that holds itself"
    real, secrets._Inflated = secrets._Inflated, type("Circle", (secrets._Inflated,), {"__iter__": lambda self: iter([circle])})
    try:
        assert parts.kinds(parts.node(circle)) == set()
    finally:
        secrets._Inflated = real


def test_secret_table_and_masks(docs_of):
    texts = [None, "", "x " * 50_000 + PLAIN, PLAIN, PLAIN, f"AKIA{'Q' * 20} {'0f' * 20}", "token: ab"]
    docs = docs_of(texts)
    rows = {r.doc_id: r for r in secrets.find(docs, "doc_id").collect()}
    assert [(r.n_assign, r.n_access, r.n_hex) for _, r in sorted(rows.items())] == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 1), (0, 0, 0)]
    for k, r in rows.items():
        spans = sorted(brute_base(texts[k] or ""), key=lambda s: (s[0], s[2]))
        listed = ",".join(f"{secrets.KINDS[x]}:{a}:{b}" for a, b, x in spans)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(listed.encode()).hexdigest(), listed)
    out = secrets.mask(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert left[0] == (None, None) and left[3] == ("[secret]", 8) and left[5][0] == "[secret] [secret]" and left[6][0] == "token: ab"
    assert secrets.find(docs_of([]), "doc_id").count() == 0
