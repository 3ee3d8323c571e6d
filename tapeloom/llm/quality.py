"""Quality rules whose cutoffs come with a bound on rejected good documents.

Every document gets whole-text counts and, from them, one number per rule in
thousandths. The rules' cutoffs move down together along one fixed sequence: a
document's severity is the largest of its rules' numbers, each times a fixed
weight, and step t rejects whatever has severity t or more by any rule.

Documents labelled good are the holdout. In each stratum the step moves down from
"reject nothing" as long as an exact binomial test shows that all rules together
reject at most the share `risk` of good documents. Along the sequence the rejected
good documents only grow, so its steps need no correction; the strata share
`level` between them. All bounds then hold together with probability 1 - level.
One per cent at 95 % takes 436 good documents per stratum if there are four;
strata with fewer have no cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text as T
from tapeloom.llm.apart import HELD, PLAIN, set_apart
from tapeloom.session import stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_BLANK, _SYMBOL, _MARK = b" \t\n\v\f\r", b"#*$%&|<>", b"!?"
_UPPER = bytes(range(65, 91))


def repeated_words(hashes: np.ndarray, size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more, the first included."""
    found = T.windows(hashes, size)
    if len(found) < 2:
        return 0
    order = np.sort(found)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(found, twice))
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return int((np.cumsum(change) > 0).sum())


def counts(text: bytes, cache: T.WordHashes) -> tuple[int, ...]:
    """The numbers of `COUNTS` for one text."""
    words = text.split()
    solid = text.translate(None, _BLANK)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def of(chars: bytes) -> int:
        return len(solid) - len(solid.translate(None, chars))

    repeats = repeated_words(cache.of(words)) if len(words) > 8 else 0
    return len(words), len(solid.decode()), of(_SYMBOL), len(lines) - len({*lines}), repeats, len(lines), of(_UPPER), of(_MARK)


def measure(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns and `COUNTS` of the whole text (null: no words); columns of the same names are replaced."""
    names = [c for c in columns if c not in COUNTS]
    kept = ["_raw" if c == "text" else c for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = T.WordHashes()
        for batch in T.slices(batches, "_raw"):
            rows = [counts(t or b"", cache) for t in batch.column("_raw").to_pylist()]
            made = [pa.array(c, pa.int64()) for c in np.array(rows, np.int64).reshape(-1, len(COUNTS)).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *COUNTS])

    kinds = dict(docs.dtypes) | {"_raw": "binary"}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} long" for c in COUNTS)])
    given = docs.select(*[c for c in names if c != "text"], F.col("text").cast("binary").alias("_raw"))
    out = T.small_batches(given).mapInArrow(run, schema)
    return out.select(*[F.col("_raw").cast(kinds["text"]).alias("text") if c == "text" else F.col(c) for c in names], *COUNTS)


def _share(part: Column, whole: Column) -> Column:
    return F.least(F.expr("1000L"), F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0)).cast("long")


def rules() -> dict[str, Column]:
    """Each rule as a number from 0 to 1000; high is bad."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _share(F.col("n_symbols"), chars),
        "dup_lines": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": _share(F.col("n_repeat_words"), words),
        "upper": _share(F.col("n_upper"), chars),
        "marks": _share(F.col("n_marks"), chars),
        "long_words": F.when(words > 0, F.least(F.lit(1000), F.floor(chars * 10 / words))).otherwise(0).cast("long"),
    }


#: What a rule's number is multiplied by, so that 1000 is clearly bad under each: a tenth of symbols or marks,
#: a third of repeats, half of the words' letters upper case, half of the lines repeated, words of 25 letters.
WEIGHTS = {"symbols": 10, "dup_lines": 2, "repeats": 3, "upper": 2, "marks": 10, "long_words": 4}


def severity() -> Column:
    """The largest weighted rule, from 0 to 1000."""
    return F.least(F.expr("1000L"), F.greatest(*[c * WEIGHTS[n] for n, c in rules().items()]))


def base_failed() -> Column:
    """Too short, or too much of it repeated: no cutoff can save such a document."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def tail(n: int, k: int, risk: float) -> float:
    """Probability of k or fewer of n independent events of probability `risk` each."""
    if k >= n:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(risk) + (n - i) * log1p(-risk) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def cutoff(values: np.ndarray, good: np.ndarray, risk: float, level: float) -> int:
    """Smallest value from which a rule may reject; 1001 (reject nothing) if nothing is proven.

    `good` counts good documents by value. The number rejected grows as the
    cutoff falls, and with it the tail, so the last cutoff that passes is found
    by bisection over the allowed number of rejections.
    """
    n = int(good.sum())
    if n == 0 or tail(n, 0, risk) > level:
        return 1001
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if tail(n, middle, risk) <= level else (low, middle)
    by_value = np.bincount(values, weights=good, minlength=1002)[:1002]
    rejected = by_value[::-1].cumsum()[::-1]
    return max(1, int(np.argmax(rejected <= low)))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: float, level: float) -> DataFrame:
    """One row per stratum, (`_stratum`, `_cut`), from every labelled document.

    A document is good if all its labels say quality 1. Documents that fail the
    base rules are no part of the holdout.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    found = measured.where(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    seen = found.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), severity().alias("value"))
    seen = stage(seen.groupBy("_stratum", "value").agg(F.count(F.lit(1)).alias("n")), "holdout")
    tests = max(1, seen.select("_stratum").distinct().count())

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cut = cutoff(rows["value"].to_numpy(), rows["n"].to_numpy(), risk, level / tests)
        return pd.DataFrame([{"_stratum": rows["_stratum"].iloc[0], "_cut": cut}])

    return seen.groupBy("_stratum").applyInPandas(choose, "_stratum string, _cut int")


def judge(docs: DataFrame, labels: DataFrame, *columns: str, stratum: str = "lang", risk: float = 0.01, level: float = 0.05) -> DataFrame:
    """The columns with `COUNTS`, the rules' values, severity, base_failed and kept.

    A document is kept if it passes the base rules and stays under its stratum's
    cutoff. A null stratum is one of its own; a stratum without labels has no
    cutoff. Repeated rows are judged alike; empty tables give no rows. Asked
    columns that are called like a result are replaced by it.
    """
    wanted = list(dict.fromkeys(["doc_id", stratum, *columns]))
    names = [c for c in docs.columns if c in wanted or c == "text"]
    given, restored = set_apart(docs.select(*[F.col(f"`{c}`") for c in names]), (*PLAIN, stratum))
    carried = [c for c in given.columns if c in wanted or c == HELD]
    measured = stage(measure(given, *dict.fromkeys(["doc_id", stratum, *carried])), "measured")
    cuts = cutoffs(measured, labels, stratum, risk, level)
    named = measured.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    judged = named.withColumns({f"rule_{n}": c for n, c in rules().items()} | {"severity": severity()}).join(cuts, "_stratum", "left")
    over = F.col("severity") >= F.coalesce(F.col("_cut"), F.lit(1001))
    out = judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)
    return restored(out.drop("_stratum", "_cut"))
