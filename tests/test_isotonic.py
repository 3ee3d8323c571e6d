"""The increasing map against the min-max formula, over many ranges and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.models import isotonic


def min_max(x, y):
    """Value at each distinct score: the largest, over beginnings, of the smallest mean from there to any end behind it."""
    grid = np.unique(x)
    s, n = np.array([y[x == g].sum() for g in grid]), np.array([(x == g).sum() for g in grid], float)
    cs, cn = np.concatenate([[0], s.cumsum()]), np.concatenate([[0], n.cumsum()])
    return grid, np.array([max(min((cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a]) for b in range(i, len(grid))) for a in range(i + 1)) for i in range(len(grid))])


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "waves"])
def test_map_against_the_formula(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 150, 600).astype(float)
    y = {"noise": rng.random(600) < 0.3, "falling": -x, "rising": x * x, "waves": np.sin(x / 9) + x / 90}[kind].astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (3.0, None)], "s double, y double").repartition(6)
    blocks = isotonic.fit_blocks(df, "s", "y", classes=False)
    grid, want = min_max(x, y)
    asked = [*grid, *(grid[:-1] + 0.25), -5.0, 500.0]
    frame = spark.createDataFrame([(k, float(a)) for k, a in enumerate(asked)] + [(-1, None)], "id int, s double")
    for size in (100_000, 7):
        got = {r["id"]: r["p"] for r in isotonic.apply_blocks(blocks, frame, "s", "p", size).collect()}
        assert len(got) == len(asked) + 1 and got[-1] is None
        np.testing.assert_allclose([got[k] for k in range(len(asked))], np.interp(asked, grid, want), atol=1e-9)
    assert blocks.agg(F.sum("n")).first()[0] == 600


def test_insufficient_calibrations_are_refused(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(200)], "s double, y double")
    for rows in (df, df.limit(0), df.limit(50), df.withColumn("s", F.lit(1.0))):
        with pytest.raises(ValueError, match="insufficient"):
            isotonic.fit_blocks(rows, "s", "y")


def test_columns_and_rows_stay(spark):
    df = spark.createDataFrame([(float(i), float(i % 3 == 0 or i > 150)) for i in range(200)], "s double, y double")
    blocks = isotonic.fit_blocks(df, "s", "y")
    frame = spark.createDataFrame([(-5.0, "a", 9.0), (0.0, "b", 9.0), (60.0, "c", 9.0), (60.0, "c", 9.0), (500.0, "d", 9.0)], "s double, name string, p double")
    out = isotonic.apply_blocks(blocks, frame, "s", "p")
    assert out.columns == ["s", "name", "p"]
    got = [r["p"] for r in out.orderBy("s").collect()]
    assert got == sorted(got) and len(got) == 5 and got[0] == got[1]
