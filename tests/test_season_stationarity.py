import math

import numpy as np
import pytest
from conftest import PLAIN, blocked, panel_of, sorted_frame, wavy
from pyspark.sql import functions as F

from tidepanel.functions import loess, tails
from tidepanel.operators import decompose, season, stationarity
from tidepanel.operators.layout import Layout


def plain_loess(y, span, places, weights=None):
    """One window at a time, straight from the definition."""
    n, out = len(y), []
    width = min(span, n)
    for x in places:
        left = min(max(x - (span - 1) // 2, 0), n - width)
        idx = np.arange(left, left + width)
        reach = max(x - left, left + width - 1 - x) + (max(span - n, 0)) // 2
        r = np.abs(idx - x) / reach
        w = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**3) ** 3, 0))
        if weights is not None:
            w = w * weights[idx]
        design = np.column_stack([np.ones(width), idx - x])
        root = np.sqrt(w)[:, None]
        beta, *_ = np.linalg.lstsq(design * root, y[idx] * root[:, 0], rcond=None)
        out.append(beta[0])
    return np.array(out)


@pytest.mark.parametrize("n,span", [(80, 7), (80, 31), (20, 31), (200, 13)])
def test_smoother_equals_definition(n, span):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n)
    np.testing.assert_allclose(loess.smooth(y, span), plain_loess(y, span, range(n)), atol=1e-9)
    w = rng.uniform(0.2, 1, n)
    np.testing.assert_allclose(loess.smooth(y, span, w), plain_loess(y, span, range(n), w), atol=1e-9)
    outside = loess.smooth_at(y, np.array([-1, n]), span)
    np.testing.assert_allclose(outside, plain_loess(y, span, [-1, n]), atol=1e-9)


def plain_stl(y, p, rounds=5):
    n = len(y)
    ns, nt, nl = loess.spans_for(p)
    trend = np.zeros(n)
    for _ in range(rounds):
        d = y - trend
        c = np.empty(n + 2 * p)
        for k in range(p):
            part = d[k::p]
            c[k::p] = plain_loess(part, ns, range(-1, len(part) + 1))
        low = c
        for width in (p, p, 3):
            low = np.convolve(low, np.ones(width) / width, "valid")
        season_ = c[p : p + n] - plain_loess(low, nl, range(n))
        trend = plain_loess(y - season_, nt, range(n))
    return season_, trend


def test_decomposition_equals_definition():
    y = wavy(150, 7, period=12)
    want = plain_stl(y, 12)
    got = loess.seasonal_trend(y, 12, 5)
    np.testing.assert_allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("robust", [False, True])
def test_chunks_give_the_whole_decomposition(spark, robust, monkeypatch):
    if robust:
        monkeypatch.setattr(decompose, "ROBUST_PASSES", 2)
    df = panel_of(spark, {"a": list(wavy(1200, 1, period=4)), "b": list(wavy(60, 2, period=6))})
    periods = spark.createDataFrame([("s", "a", 4), ("s", "b", 6)], "series_id string, variable string, period int")
    whole, notes = decompose.stl(df, periods, robust, PLAIN)
    parts, _ = decompose.stl(df, periods, robust, blocked(100))
    left, right = sorted_frame(parts), sorted_frame(whole)
    for column in ("observed", "trend", "seasonal", "resid"):
        np.testing.assert_allclose(left[column], right[column], atol=1e-9)
    np.testing.assert_allclose(right["trend"] + right["seasonal"] + right["resid"], right["observed"])
    assert notes.count() == 0
    strength = {r["variable"]: r for r in decompose.stl_strength(whole).collect()}
    resid, observed = right[right.variable == "a"]["resid"], right[right.variable == "a"]
    want = 1 - resid.var(ddof=0) / (observed["observed"] - observed["trend"] + resid).var(ddof=0)
    assert strength["a"]["trend_strength"] == pytest.approx(min(max(want, 0), 1))


def test_smoother_in_slices_is_the_same(monkeypatch):
    values = wavy(300)
    weights = np.linspace(0.1, 1, 300)
    whole = loess.smooth(values, 121, weights)
    monkeypatch.setattr(loess, "SLICE_CELLS", 500)
    np.testing.assert_array_equal(loess.smooth(values, 121, weights), whole)


def test_no_period_is_too_long(spark):
    sized = spark.createDataFrame([("s", "x", 10**9, 10**7)], "series_id string, variable string, n bigint, period bigint")
    assert decompose.decomposable(sized, 5, 1000).first()["reason"] is None


def test_undecomposable_groups_are_noted(spark):
    df = panel_of(spark, {"tiny": [1.0] * 5, "ok": list(wavy(60))})
    periods = spark.createDataFrame([("s", "tiny", 2), ("s", "ok", 7)], "series_id string, variable string, period int")
    rows, notes = decompose.stl(df, periods, layout=PLAIN)
    assert [r["variable"] for r in notes.collect()] == ["tiny"]
    assert {r[0] for r in rows.select("variable").distinct().collect()} == {"ok"}


def test_reach_agrees_with_kernel(spark):
    df = spark.createDataFrame([(p,) for p in range(2, 200)], "period bigint")
    got = df.select("period", decompose._reach(5).alias("r")).collect()
    assert all(r["r"] >= 5 * loess.reach_per_round(r["period"]) for r in got)


def test_period_from_peaks(spark):
    df = panel_of(spark, {"wave": list(wavy(600, 3, slope=0.0)), "short": list(wavy(90)), "flat": [1.0] * 500})
    got = {r["variable"]: r["period"] for r in season.estimate_period(df, layout=PLAIN).collect()}
    assert got["wave"] % 24 == 0 and got["short"] == 9 and got["flat"] == 12


def test_tails(spark):
    cases = [(18.307, 10, 0.05), (16.919, 9, 0.05), (3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05)]
    df = spark.createDataFrame([(q, m) for q, m, _ in cases], "q double, m bigint")
    got = [r[0] for r in df.select(tails.chi_square_tail(F.col("q"), F.col("m"))).collect()]
    np.testing.assert_allclose(got, [p for *_, p in cases], atol=2e-5)
    for name, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
        assert tails.unit_root_pvalue(tails.TAU_CRITICAL[name][0]) == pytest.approx(p, abs=2e-4)


def plain_adf(y):
    n = len(y)
    limit = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    step = np.diff(y)

    def fit(lags, start):
        target = step[start:]
        columns = [y[start:-1]] + [step[start - i : len(step) - i] for i in range(1, lags + 1)]
        design = np.column_stack([*columns, np.ones(len(target))])
        beta, *_ = np.linalg.lstsq(design, target, rcond=None)
        rss = ((target - design @ beta) ** 2).sum()
        m, k = design.shape
        aic = m * (math.log(2 * math.pi) + math.log(rss / m) + 1) + 2 * k
        cov = np.linalg.inv(design.T @ design) * rss / (m - k)
        return aic, beta[0] / math.sqrt(cov[0, 0]), m

    best = min((fit(k, limit)[0], k) for k in range(limit + 1))[1]
    return (*fit(best, best)[1:], best)


def test_unit_root_statistic(spark):
    rng = np.random.default_rng(5)
    series = {"walk": np.cumsum(rng.normal(size=1000)), "noise": rng.normal(size=1000) + 50, "wave": wavy(400, 3)}
    df = panel_of(spark, {k: list(v) for k, v in series.items()})
    for rows in (10_000, 150):
        got = {r["variable"]: r for r in stationarity.adf(df, layout=Layout(1000, rows)).collect()}
        for name, y in series.items():
            tau, used, lags = plain_adf(y)
            assert got[name]["adf_statistic"] == pytest.approx(tau, rel=1e-6)
            assert (got[name]["n_obs"], got[name]["n_lags_used"]) == (used, lags)
    assert got["noise"]["adf_pvalue"] < 0.01 < 0.05 < got["walk"]["adf_pvalue"]


def test_stationarity_table(spark):
    rng = np.random.default_rng(6)
    df = panel_of(spark, {"noise": list(rng.normal(size=300)), "walk": list(np.cumsum(rng.normal(size=300))), "tiny": [1.0, 2.0, 3.0]})
    got = {r["variable"]: r for r in stationarity.stationarity(df).collect()}
    assert set(got) == {"noise", "walk"}
    assert got["noise"]["is_stationary"] == 1 and got["walk"]["is_stationary"] == 0
    assert got["walk"]["has_autocorrelation"] == 1
    assert set(got["noise"]["adf_critical_values"]) == {"1%", "5%", "10%"}
    odd = stationarity.ljung_box(panel_of(spark, {"v": list(rng.normal(size=45))}), 10).first()
    assert odd["lb_lags"] == 9 and 0 < odd["lb_pvalue"] <= 1


def test_unit_root_does_not_depend_on_the_layout(spark):
    df = panel_of(spark, {"noise": list(np.random.default_rng(3).normal(0, 1, 600)), "wave": list(wavy(500))})
    kinds = (PLAIN, blocked(100), Layout(600, 1000))
    one, two, three = (sorted_frame(stationarity.adf(df, layout=x)) for x in kinds)
    for other in (two, three):
        assert list(one["n_lags_used"]) == list(other["n_lags_used"])
        np.testing.assert_allclose(one["adf_statistic"], other["adf_statistic"], rtol=1e-8)


def test_long_kernels_smooth_like_short_ones(monkeypatch):
    rng = np.random.default_rng(6)
    values, weights = np.cumsum(rng.normal(size=9000)) + 1e4, rng.random(9000)
    for span in (513, 1909, 3001):
        fast = loess.smooth(values, span), loess.smooth(values, span, weights)
        monkeypatch.setattr(loess, "LONG_KERNEL", 1 << 40)
        slow = loess.smooth(values, span), loess.smooth(values, span, weights)
        monkeypatch.undo()
        for a, b in zip(fast, slow):
            np.testing.assert_allclose(a, b, rtol=1e-9)
