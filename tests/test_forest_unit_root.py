"""Forest and unit-root test against plain recursion and least squares."""

import numpy as np
import pytest
from conftest import PLAIN, blocked, panel_of, sorted_frame, wavy
from pyspark.sql import functions as F

from tidepanel.operators import iforest, stationarity
from tidepanel.operators.layout import per_block
from tidepanel.session import materialize


def plain_tree(rows: np.ndarray, code: int, depth: int, limit: int, key) -> tuple | float:
    low, high = rows.min(axis=0), rows.max(axis=0)
    opened = np.flatnonzero(high > low)
    if len(rows) <= 1 or not len(opened) or depth == limit:
        return depth + iforest.average_path(len(rows))
    h1, h2 = iforest._pairs(np.array([key]), np.array([iforest.CUT_NUMBERS + code]))
    f = opened[(int(h1[0]) * len(opened)) >> 32]
    cut = low[f] + float(h2[0]) / 2**32 * (high[f] - low[f])
    cut = low[f] if cut >= high[f] else cut
    left = rows[:, f] <= cut
    return f, cut, plain_tree(rows[left], 2 * code, depth + 1, limit, key), plain_tree(rows[~left], 2 * code + 1, depth + 1, limit, key)


def path(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize("n", [1, 2, 5, 100, 256, 300, 3000])
def test_trees_grown_together_equal_plain_recursion(n):
    points = np.random.default_rng(n).normal(size=(n, 4)).round(1)
    if n == 100:
        points[:, :3] = 1.0
    keys = iforest.tree_keys(42, "s", "v", np.arange(7))
    samples = iforest.sample_positions(keys, n)
    size = min(n, iforest.SAMPLE_ROWS)
    assert samples.shape == (7, size) and all(len(set(row)) == size for row in samples)
    limit = int(np.ceil(np.log2(max(size, 2))))
    trees = [plain_tree(points[samples[k]], 1, 0, limit, keys[k]) for k in range(7)]
    some = points[:150]
    want = [np.mean([path(tree, x) for tree in trees]) for x in some]
    np.testing.assert_allclose(iforest.depths(some, iforest.grow(points, samples, keys)), want)


def test_draws_are_even_and_differ_by_tree():
    keys = iforest.tree_keys(42, "s", "v", np.arange(400))
    drawn = iforest.sample_positions(keys, 5000)
    counts = np.bincount(drawn.ravel(), minlength=5000)
    expected = 400 * iforest.SAMPLE_ROWS / 5000
    assert abs(counts.mean() - expected) < 1e-9 and counts.std() < 1.3 * np.sqrt(expected)
    assert len({tuple(sorted(row)) for row in drawn}) == 400
    other = iforest.sample_positions(iforest.tree_keys(42, "s", "w", np.arange(400)), 5000)
    assert not (drawn == other).all(axis=1).any()


def test_forest_does_not_depend_on_parts_or_blocks(spark, monkeypatch):
    panel = materialize(panel_of(spark, {"long": list(wavy(900, 1)), "short": list(wavy(60, 2))}))
    whole = sorted_frame(iforest.detect_isolation_forest(panel, trees=24, layout=PLAIN))
    monkeypatch.setattr(iforest, "SHORT_ROWS", 300)
    parts = sorted_frame(iforest.detect_isolation_forest(panel, trees=24, layout=blocked(70)))
    np.testing.assert_allclose(parts["score"], whole["score"], atol=1e-12)
    assert parts["is_anomaly"].tolist() == whole["is_anomaly"].tolist()


def test_large_rows_reach_all_blocks_in_two_steps(spark):
    values = spark.createDataFrame([("s", "v", 1000), ("s", "w", 3)], "series_id string, variable string, n bigint")
    layout = blocked(7)
    got = sorted((r["variable"], r["block"]) for r in per_block(values, layout, spread=True).collect())
    assert got == sorted((r["variable"], r["block"]) for r in per_block(values, layout).collect())
    assert len(got) == 143 + 1


def least_squares(y: np.ndarray, start: int, lags: int) -> tuple[float, float]:
    x = stationarity._unit_root_design(y, start, len(y), lags)
    beta, *_ = np.linalg.lstsq(x[:, 1:], x[:, 0], rcond=None)
    rest = x[:, 0] - x[:, 1:] @ beta
    variance = rest @ rest / (len(rest) - x.shape[1] + 1)
    return float(rest @ rest), float(beta[0] / np.sqrt(variance * np.linalg.inv(x[:, 1:].T @ x[:, 1:])[0, 0]))


SERIES = {
    "noise": lambda rng, n: rng.normal(size=n),
    "walk": lambda rng, n: np.cumsum(rng.normal(size=n)),
    "wave": lambda rng, n: np.sin(np.arange(n) / 5) + rng.normal(size=n) * 0.1,
}


@pytest.mark.parametrize("n", [10, 12, 30, 200, 2500])
@pytest.mark.parametrize("kind", list(SERIES))
def test_every_lag_from_one_factor(n, kind):
    y = SERIES[kind](np.random.default_rng(n), n)
    y = y - y.mean()
    limit = stationarity.lag_limit(n)
    design = stationarity._unit_root_design(y, limit + 1, n, limit)
    sums = stationarity._lag_sums(y, limit + 1, n, limit)
    system = stationarity.unit_root_system(sums, y[: limit + 1], y[n - 1 - limit :], n - 1 - limit)
    direct = design.T @ design
    np.testing.assert_allclose(system, direct, rtol=1e-8, atol=1e-8 * np.abs(direct).max())
    want = [least_squares(y, limit + 1, lags)[0] for lags in range(limit + 1)]
    np.testing.assert_allclose(stationarity.residual_squares(system), want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("layout", [PLAIN, blocked(90)], ids=["plain", "blocked"])
def test_unit_root_statistic_equals_least_squares(spark, layout):
    made = {kind: list(make(np.random.default_rng(3), 600) + 100) for kind, make in SERIES.items()}
    panel = panel_of(spark, {**made, "flat": [5.0] * 50, "few": [1.0] * 4})
    got = {r["variable"]: r for r in stationarity.adf(panel, layout=layout).collect()}
    assert set(got) == set(SERIES)
    limit = stationarity.lag_limit(600)
    for kind, values in made.items():
        y = np.array(values) - np.mean(values)
        rows = 600 - 1 - limit
        best = min((stationarity._criterion(least_squares(y, limit + 1, k)[0], rows, k + 2), k) for k in range(limit + 1))[1]
        assert got[kind]["n_lags_used"] == best and got[kind]["n_obs"] == 599 - best
        assert got[kind]["adf_statistic"] == pytest.approx(least_squares(y, best + 1, best)[1], rel=1e-7)
    assert got["walk"]["adf_pvalue"] > 0.05 > got["noise"]["adf_pvalue"]


def test_sums_do_not_grow_with_the_square_of_the_lags(spark):
    panel = panel_of(spark, {"v": list(wavy(3000, 9))})
    assert len(stationarity._lag_sums(np.arange(3000.0), 29, 3000, 28)) == 60
    assert stationarity.adf(panel.where(F.lit(True)), max_lag=5, layout=PLAIN).first()["n_lags_used"] <= 5
