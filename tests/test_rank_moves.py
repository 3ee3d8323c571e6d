"""Ranks in many ranges move rows once per value; rows of factors meet again across Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom import skew
from tapeloom.operators import blending, evaluation


def test_rows_move_once_for_a_rank(spark):
    rows = spark.range(0, 5_000, 1, 4).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(700)) / 7.0).alias("v"))
    ranked = skew.average_rank(rows, ["g"], "v", "r", per_range=100)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    got = ranked.toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["r"], got.groupby("g")["v"].rank(), equal_nan=True)


def test_no_rank_is_joined_to_the_rows_of_factors(spark):
    rng = np.random.default_rng(5)
    names = [f"f{k}" for k in range(5)]
    pdf = pd.DataFrame(np.round(rng.normal(size=(900, 5)), 1), columns=names)
    pdf["f4"] = np.where(pdf["f4"] > 0, 0.0, pdf["f4"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = evaluation.factor_correlations(spark.createDataFrame(pdf).repartition(3), names, per_range=150).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pdf.corr(method="spearman").abs()
    assert len(got) == 10 and all(np.isclose(r.corr, want.loc[r.a, r.b]) for r in got.itertuples())


def test_a_blend_groups_its_keys_once(spark):
    """The dates' rows are counted on what is written, not by a second grouping of the keys."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 400, 1, 4).selectExpr("date_add(date'2024-01-01', int(id % 8)) AS dt", "id AS instrument", "double(id * 37 % 101) AS score")
    table = rows.mapInArrow(look, rows.schema)
    out = blending.weighted_blend([table, rows], [3, 1], per_range=1_000).toPandas()
    assert seen.value == 400
    want = out.assign(score=out["s0"]).groupby("dt")["score"].rank(ascending=False)
    np.testing.assert_allclose(out["r0"], want)
