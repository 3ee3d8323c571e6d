"""Nested encodings against a plain unwrapping that copies whole texts, and the cost of hostile texts."""

import base64
import gzip
import random
import time
import tracemalloc
import urllib.parse

import pytest

from tapeloom.llm import secrets

SECRET = "password=abcdef99"
WRAPS = {
    "percent": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
    "partly": lambda t: urllib.parse.quote(t, safe=""),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
}


@pytest.mark.parametrize("seed", range(40))
def test_any_nesting_is_found_at_its_place(seed):
    rng = random.Random(seed)
    inner = f"note {SECRET} end"
    names = [rng.choice(list(WRAPS)) for _ in range(rng.randint(1, 4))]
    for name in names:
        inner = WRAPS[name](inner)
    text = f"some words before, ({inner}) and after"
    base, spans, _ = secrets.scan(text)
    assert any(kind == 0 and 20 <= start and end <= 20 + len(inner) for start, end, kind in spans), names
    assert {*base} <= {*spans}


@pytest.mark.parametrize("levels", [1, 2, 5, 9])
def test_escaped_escapes_map_to_the_whole_escape(levels):
    """Every level by itself, as a copy of the whole text, gives the same place as one step over all levels."""
    text = SECRET.replace("d=", "%" + "25" * (levels - 1) + "64=")
    (start, end, kind), *more = secrets.scan(f"x {text} y")[1]
    assert (start, end, kind) == (2, 2 + len(text), 0) and not more
    for _ in range(levels):
        text = urllib.parse.unquote(text)
    assert text == SECRET


def test_hostile_texts_stay_cheap():
    begin = time.perf_counter()
    head = "%" + "25" * 8000 + "41 "
    assert (len(head), len(head) + len(SECRET), 0) in secrets.scan(head + SECRET)[1]
    secrets.scan("%5Cu0025" + "5Cu0025" * 3000 + "41")
    secrets.scan("\\u005cu005c" * 3000 + "u0041")
    assert time.perf_counter() - begin < 10


@pytest.mark.parametrize("escape", ["%41", "%2541", "\\u0041"])
def test_one_escape_in_a_long_text_costs_little_memory(escape):
    text = ("lorem ipsum dolor sit amet " * 320_000)[: 8 << 20] + escape + " "
    tracemalloc.start()
    secrets.scan(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
