"""The verdict against a plain count over all labelled documents."""

import math
import random
from collections import defaultdict

from tapeloom.llm import quality
from tapeloom.llm import text as T


def value_of(text):
    """Severity and base verdict of one text, by whole numbers."""
    words, chars, symbols, dups, repeats, lines, upper, marks = quality.counts((text or "").encode(), T.WordHashes())

    def share(part, whole):
        return min(1000, part * 1000 // whole) if whole else 0

    values = {"symbols": share(symbols, chars), "dup_lines": share(dups, lines), "repeats": share(repeats, words), "upper": share(upper, chars), "marks": share(marks, chars),
              "long_words": min(1000, chars * 10 // words) if words else 0}
    return min(1000, max(v * quality.WEIGHTS[n] for n, v in values.items())), words < 20 or repeats * 100 > words * 30


def tail(n, k, risk):
    return sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))


def test_kept_against_all_labelled_documents(spark):
    rng = random.Random(3)
    texts = []
    for k in range(1500):
        words = " ".join(rng.choice(["word", "Longer", "text", "a", "number"]) + str(rng.randrange(10**5)) for _ in range(rng.randint(15, 40)))
        texts.append(words + " " + rng.choice(["", "", "", "!", "###", "$ # | " * rng.randint(1, 30), "WHAT " * rng.randint(1, 9)]))
    texts += ["", None]
    lang = [("a", "b", "c", None)[k % 20 // 6 if k < 1480 else 2] for k in range(len(texts))]
    label = {k: rng.random() < 0.8 for k in range(0, len(texts), 2)}
    docs = spark.createDataFrame([(k, t, s, 5) for k, (t, s) in enumerate(zip(texts, lang, strict=True))], "doc_id long, text string, lang string, severity int")
    labels = spark.createDataFrame([(k, int(q)) for k, q in label.items()] + [(0, 1)], "doc_id long, quality int")
    risk, level, held = 0.03, 0.1, defaultdict(list)
    values = [value_of(t) for t in texts]
    for k, good in label.items():
        if good and not values[k][1]:
            held[lang[k] or ""].append(values[k][0])
    cut = {}
    for s, own in held.items():
        proven = [t for t in range(1, 1002) if tail(len(own), sum(v >= t for v in own), risk) <= level / len(held)]
        first = 1001
        while first - 1 in proven and first in proven:
            first -= 1
        cut[s] = first if 1001 in proven else 1001
    assert len({*cut.values()}) > 1 and min(cut.values()) < 1001
    rows = {r.doc_id: r for r in quality.judge(docs, labels, risk=risk, level=level).collect()}
    assert len(rows) == len(texts)
    for k, (value, failed) in enumerate(values):
        assert (rows[k].severity, rows[k].base_failed) == (value, failed)
        assert rows[k].kept == (not failed and value < cut.get(lang[k] or "", 1001)), k


def test_rules_reject_labelled_bad_documents_of_the_given_table(spark):
    """English, German and French have enough good documents for a cutoff; Spanish has not."""
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.measure(docs, "doc_id", "lang")
    cuts = {r["_stratum"]: r["_cut"] for r in quality.cutoffs(measured, labels, "lang", 0.01, 0.05).collect()}
    assert all(cuts[s] < 1001 for s in ("en", "de", "fr")) and cuts["es"] == 1001
    judged = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed")
    bad, good = (judged.where(f"quality = {q} and lang <> 'es'") for q in (0, 1))
    assert bad.where("not kept").count() > 0.8 * bad.count()
    assert good.where("not kept").count() <= 0.01 * good.count()
