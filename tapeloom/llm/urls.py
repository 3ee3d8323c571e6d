"""URL filter: rules by host and path first, a weighted vocabulary for the rest.

All terms are found in one pass of an Aho-Corasick automaton over the URL with
A-Z lower-cased. A hit counts where no letter or digit of ASCII touches it. One
strict term, or `soft_limit` different soft ones, block the page.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the production filter.
STRICT = ("casino", "porn", "xxx", "viagra", "malware", "phishing", "torrent")
SOFT = ("ads", "track", "click", "popup", "bet", "free", "win", "cheap", "loan", "promo", "coupon")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_TOUCH = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty without `://`; the host with A-Z lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    at = min(ends, default=len(rest))
    path = rest[at:].split("?", 1)[0].split("#", 1)[0]
    return rest[:at].translate(_LOWER), path


class Rules:
    """Rules of a host and its subdomains with a path prefix; the longest that fits wins, block before allow."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[int, bool, str, str, str]]] = defaultdict(list)
        for verdict, rule in rules:
            host, mark, path = rule.partition("/")
            self.by_host[host].append((len(rule), verdict == "block", rule, verdict, mark + path))

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        fits, at = [], 0
        while at >= 0 and host:
            fits += [r for r in self.by_host.get(host[at:], ()) if path.startswith(r[4])]
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return max(fits)[2:4] if fits else (None, None)


class Vocabulary:
    """Strict and soft terms of letters in one automaton."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.machine, self.any = ahocorasick.Automaton(), bool(strict or soft)
        for is_strict, terms in ((False, soft), (True, strict)):
            for term in terms:
                low = term.translate(_LOWER)
                self.machine.add_word(low, (low, is_strict))
        if self.any:
            self.machine.make_automaton()

    def hits(self, url: str | None) -> tuple[set[str], set[str]]:
        """Different (strict, soft) terms that stand alone in the URL."""
        found: tuple[set[str], set[str]] = set(), set()
        low = (url or "").translate(_LOWER)
        for end, (term, is_strict) in self.machine.iter(low) if self.any else ():
            start = end - len(term)
            if (start < 0 or low[start] not in _TOUCH) and (end + 1 == len(low) or low[end + 1] not in _TOUCH):
                found[not is_strict].add(term)
        return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft of every page.

    Only `page_id` and `url` are read. A null URL has an empty host and path and
    is allowed; repeated rows are judged one by one.
    """
    names = ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, words = Rules(rules), Vocabulary(strict, soft)
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = by_rule.of(host, path)
                hard, weak = words.hits(url)
                rejected = hard or len(weak) >= soft_limit
                rows.append((host, path, rule, verdict or ("block" if rejected else "allow"), len(hard), len(weak)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *made], names)

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return given.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int")


def _alone(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_A_Z = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH urls AS (
  SELECT page_id, {_A_Z.format("coalesce(url, '')")} AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, low, {_A_Z.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {" + ".join(f"CAST({_alone(t)} AS INTEGER)" for t in STRICT)} AS n_strict,
    {" + ".join(f"CAST({_alone(t)} AS INTEGER)" for t in SOFT)} AS n_soft FROM urls),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
fit AS (
  SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || split_part(r.rule, '/', 1))
    AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM parts p LEFT JOIN fit f USING (page_id)"""
