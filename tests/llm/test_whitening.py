import math

import numpy as np
import pytest

from tapeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, _row int, n long"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2) for k, v in rows], SCHEMA)


def brute(vectors):
    """Exact deviations, covariance and its eigenvalues, by whole numbers and NumPy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[(n * r[k] - sums[k]) / n for k in range(d)] for r in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return deviation, centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_all_rows_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(150, 6)) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist()
    data[10] = data[11]
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0] * 5)]
    rows = [*enumerate(data), *bad]
    found = whitening.whiten(table(spark, rows).repartition(5), 4, block_rows=block_rows, part_blocks=2).collect()
    deviation, centred, values, vectors = brute(data)
    assert len(found) == 150 * 4
    got = np.zeros((150, 4))
    for r in found:
        assert r.n == 150 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
        got[r.vec_id, r.component - 1] = r.whitened
    for k in range(4):
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-9


def test_no_rows_and_no_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    rows = whitening.whiten(table(spark, [(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(r.component, 0, 0.0, None, None) for r in rows]
    assert len(rows) == 6


def test_a_flat_dimension_has_no_component(spark):
    rows = whitening.whiten(table(spark, [(k, [float(k), 1.0, float(k * k % 7)]) for k in range(20)])).collect()
    assert {r.whitened for r in rows if r.component == 3} == {0.0}
    assert all(r.identity_error < 1e-9 for r in rows)


def test_large_entries_stay_exact(spark):
    """Entries whose products leave 64 bits are counted by exact whole numbers; sums beyond 64 bits come out as null."""
    rows = [(1, [float(2**40), 1.0]), (2, [-float(2**40), 2.0]), (3, [float(2**50), 0.0])]
    found = {r.vec_id: r for r in whitening.whiten(table(spark, rows), 1).collect()}
    assert found.keys() == {1, 2}
    assert found[1].deviation is None
    small = [(1, [float(2**15), 1.0]), (2, [0.0, 2.0])]
    assert {r.deviation for r in whitening.whiten(table(spark, small), 1).collect()} == {(2**21) ** 2 + 64**2}
