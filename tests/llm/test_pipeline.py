import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_filters import ALNUM, LOWER, brute_counts, brute_hits
from test_neardup import brute
from test_tokens import WORD, brute_ids

from tapeloom.llm import quality, secrets


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))

    items = [(k, prose(30)) for k in range(6)]
    texts = [prose(rng.randrange(40, 300)) for _ in range(60)]
    texts += [t.replace(t.split()[5], "edit", 1) for t in texts[:20]] + texts[20:30]
    texts += [f"{prose(60)} {items[k][1]} {prose(50)}" for k in range(5)] + [items[5][1] + " and more"]
    texts += [f"{prose(40)}\npassword=abcdef{k}99 {prose(20)}" for k in range(5)]
    texts += [None, "", "too short", "again and again " * 200, prose(3000)]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, None if k % 9 == 0 else "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)] + [(3, texts[3], "en", "again", len(texts[3]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_does_its_part(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    seen = {}
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, docs, root)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        given, seen[name] = rows_of(docs), rows_of(out)
        if name == "quality_rules":
            counts = [brute_counts(r[1] or "") for r in given]
            expected = [r for r, c in zip(given, counts, strict=True) if c[0] >= 20 and 100 * c[4] <= 30 * c[0]]
        elif name == "near_dedup":
            kept = {i for i, _, _, own in brute([(r[0], r[1]) for r in given], 5, 80) if own}
            expected = [r for r in given if r[0] in kept]
            assert len({r[0] for r in expected}) < len({r[0] for r in given}) - 20
        elif name == "decontamination":
            expected = [r for r in given if 2 * len(brute_hits(r[1], items, 10)[1]) <= len(brute_hits(r[1], items, 10)[0])]
            assert [r[0] for r in seen[name]] == [r[0] for r in expected] and len(expected) < len(given)
            for before, after in zip(expected, seen[name], strict=True):
                words, hit, _ = brute_hits(before[1], items, 10)
                assert ALNUM.findall(after[1].translate(LOWER)) == [w for k, w in enumerate(words) if k not in hit]
                assert after[4] == len(after[1]) and (hit or after == before)
            expected = seen[name]
        else:
            expected = given
            assert not any(secrets.scan(r[1])[1] for r in seen[name]) and sum("[secret]" in r[1] for r in seen[name]) == 5
            assert [r for r in seen[name] if "[secret]" not in r[1]] == [r for r in given if not secrets.scan(r[1])[1]]
            expected = seen[name]
        assert seen[name] == expected
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert sorted(map(tuple, packed), key=str) is not None
    by_doc = defaultdict(int)
    for r in packed:
        by_doc[r.doc_id] += r.length
    expected = defaultdict(int)
    for r in seen["secret_masks"]:
        expected[r[0]] += len(brute_ids(WORD, r[1]))
    assert dict(by_doc) == dict(expected)
    again = corpus_pipeline.run(spark, root).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in again} == dict(by_doc)


def test_an_empty_table_passes_all_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage_of in corpus_pipeline.STAGES:
        docs = stage_of(spark, docs, root)
    assert docs.count() == 0


CLASHING = ["n_words", "hits", "items", "_raw", "_stratum", "_cut", "cut_symbols", "kept", "rule_symbols", "severity", "base_failed", "_key", "key", "_held", "n_symbols", "a.b", "a b"]


def test_columns_of_any_name_come_through_every_stage(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    wide = docs.select(*[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASHING[:9]], *docs.columns,
                       *[F.array(F.col("doc_id"), F.lit(k)).alias(c) for k, c in enumerate(CLASHING[9:])])
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, wide, root)
        assert out.columns == wide.columns and out.dtypes == wide.dtypes
        rows = out.collect()
        assert rows_of(out.select(docs.columns)) == rows_of(stage_of(spark, docs, root)), name
        for r in rows:
            assert [r[c] for c in CLASHING[:9]] == [f"{c}-{r['doc_id']}" for c in CLASHING[:9]]
            assert [r[c] for c in CLASHING[9:]] == [[r["doc_id"], k] for k in range(len(CLASHING[9:]))]
    assert corpus_pipeline.STAGES[-1][1](spark, wide, root).count() > 0


def test_judge_replaces_asked_columns_by_its_results(spark, root):
    docs, labels = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels"))
    wide = docs.withColumns({"kept": F.lit("x"), "_stratum": F.lit("y"), "_raw": F.lit("z")})
    out = quality.judge(wide, labels, "kept", "_stratum", "_raw")
    assert {(r["_stratum"], r["_raw"]) for r in out.collect()} == {("y", "z")}
    assert rows_of(out.select("doc_id", "kept")) == rows_of(quality.judge(docs, labels).select("doc_id", "kept"))
