"""The block-wise forms give the same results as the plain windows."""

import numpy as np
import pandas as pd
import pytest
from conftest import PLAIN, blocked, panel_of, sorted_frame, wavy
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators import clean, detect, evaluate, explain, forecast, iforest, quality, scorers, season
from tidepanel.operators import stationarity as tests_of_unit_root
from tidepanel.operators import windows
from tidepanel.operators.layout import exact_quantiles, nearest_known, running, running_at, with_position
from tidepanel.session import materialize


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    heavy = rng.standard_cauchy(301)
    gappy = [None if rng.random() < 0.4 else float(v) for v in wavy(257, 2)]
    gappy[:5] = [None] * 5
    gappy[60:130] = [None] * 70
    gappy[-3:] = [None] * 3
    return materialize(
        panel_of(spark, {"heavy": list(heavy), "gappy": gappy, "none": [None] * 40, "one": [3.0]})
    )


@pytest.fixture(scope="module")
def full(spark):
    return materialize(
        panel_of(spark, {"a": list(wavy(310, 3)), "b": list(wavy(290, 4, period=12)), "c": list(wavy(45, 5))})
    )


def same(left: pd.DataFrame, right: pd.DataFrame, **options):
    pd.testing.assert_frame_equal(left[sorted(left)], right[sorted(right)], check_dtype=False, **options)


@pytest.mark.parametrize("rows", [7, 50])
def test_positions(panel, rows):
    bare = panel.drop("pos", "n")
    got = sorted_frame(with_position(bare, blocked(rows)))
    same(got, sorted_frame(panel))


def test_positions_of_crowded_instants(spark):
    """Most instants lie in a sliver of the time range: the second cut has to split them."""
    crowded = [2**i for i in range(20)] + list(range(2**20, 2**20 + 400))
    rows = [("s", "v", int(m)) for m in crowded]
    df = spark.createDataFrame(rows, "series_id string, variable string, o bigint").withColumn(
        "ts", F.expr("timestampadd(SECOND, o, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    )
    got = with_position(df, blocked(16)).orderBy("o").toPandas()
    assert list(got["pos"]) == list(range(len(crowded)))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(panel, descending):
    values = panel.where("value is not null").groupBy(*KEYS, "value").agg(F.count("*").alias("c"))
    measures = {"m": F.col("c"), "v": F.col("c") * F.col("value")}
    plain = running(values, KEYS, "value", measures, PLAIN, descending)
    split = running(values, KEYS, "value", measures, blocked(20), descending)
    order = ("variable", "value")
    same(sorted_frame(split, order), sorted_frame(plain, order), rtol=1e-9)


@pytest.mark.parametrize("rows", [1, 9, 64])
def test_nearest_known(panel, rows):
    def flat(layout):
        found = nearest_known(panel, layout)
        return sorted_frame(
            found.select(
                "variable", "pos", *[F.col(f"{s}.{c}").alias(s + c) for s in ("prev", "next") for c in ("pos", "value")]
            )
        )

    same(flat(blocked(rows)), flat(PLAIN))


@pytest.mark.parametrize("method", clean.FILL_METHODS)
def test_fill(panel, method):
    plain = sorted_frame(clean.fill(panel, method, PLAIN))
    for rows in (3, 40):
        same(sorted_frame(clean.fill(panel, method, blocked(rows))), plain)
    frame = panel.toPandas()
    for name, part in frame.groupby("variable"):
        series = part.sort_values("pos")["value"].astype(float)
        want = {
            "interpolate_linear": series.interpolate("linear", limit_direction="both"),
            "ffill": series.ffill().bfill(),
            "bfill": series.bfill().ffill(),
            "moving_average": series.fillna(
                series.rolling(5, min_periods=1, center=True).mean()
            ).interpolate("linear", limit_direction="both"),
        }[method].fillna(0.0)
        got = plain[plain["variable"] == name]["value"]
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


def test_rolling_features(full):
    plain = sorted_frame(windows.rolling_features(full, PLAIN).drop("block"))
    split = sorted_frame(windows.rolling_features(full, blocked(13)).drop("block"))
    same(split, plain)
    a = full.where("variable = 'a'").toPandas().sort_values("pos")["value"].reset_index(drop=True)
    around = a.rolling(10, min_periods=1, center=True)
    got = plain[plain["variable"] == "a"].reset_index(drop=True)
    np.testing.assert_allclose(got["dev_from_rolling_mean"], a - around.mean())
    np.testing.assert_allclose(got["rolling_std"], around.std().fillna(0), atol=1e-9)
    np.testing.assert_allclose(got["diff"], a.diff().fillna(0))


def test_even_window_leans_to_the_past(spark):
    df = panel_of(spark, {"v": list(range(20))})
    got = sorted_frame(windows.rolling_features(df, PLAIN))
    assert got["dev_from_rolling_mean"][6] == pytest.approx(6 - np.mean(range(1, 11)))


def test_quantiles(panel):
    points = [0.0, 0.1, 0.5, 0.95, 1.0]
    plain = sorted_frame(exact_quantiles(panel, "value", points, PLAIN))
    split = sorted_frame(exact_quantiles(panel, "value", points, blocked(25)))
    assert list(plain["variable"]) == list(split["variable"])
    for a, b in zip(plain["quantiles"], split["quantiles"]):
        np.testing.assert_allclose(a, b)
    heavy = panel.where("variable = 'heavy'").toPandas()["value"]
    row = plain[plain["variable"] == "heavy"]["quantiles"].iloc[0]
    np.testing.assert_allclose(row, heavy.quantile(points))


def test_quantiles_with_many_ties(spark):
    values = [0.0] * 200 + [1.0] * 5 + list(np.linspace(2, 3, 30))
    df = panel_of(spark, {"v": values})
    got = exact_quantiles(df, "value", [0.5, 0.9, 0.95], blocked(10)).first()["quantiles"]
    np.testing.assert_allclose(got, pd.Series(values).quantile([0.5, 0.9, 0.95]))


def test_frequency_and_lags(full):
    axis = full.select(F.col("variable").alias("series_id"), "ts")
    plain = sorted_frame(quality.infer_frequency(axis, PLAIN), ("series_id",))
    same(sorted_frame(quality.infer_frequency(axis, blocked(11)), ("series_id",)), plain)
    assert set(plain["freq"]) == {"h"}
    left = windows.lag_matrix(full, blocked(10), 14).orderBy("variable", "pos").collect()
    right = windows.lag_matrix(full, PLAIN, 14).orderBy("variable", "pos").collect()
    assert [r["lags"] for r in left] == [r["lags"] for r in right]
    same(
        sorted_frame(windows.recent_mean(full, blocked(6))),
        sorted_frame(windows.recent_mean(full, PLAIN)),
    )


def test_autocorrelation(full):
    order = ("variable", "lag")
    plain = sorted_frame(season.acf(full, 60, PLAIN), order)
    same(sorted_frame(season.acf(full, 60, blocked(17)), order), plain, rtol=1e-9, atol=1e-12)
    x = full.where("variable = 'a'").toPandas().sort_values("pos")["value"].to_numpy()
    x = x - x.mean()
    want = [x[k:] @ x[: len(x) - k] / (x @ x) for k in range(61)]
    np.testing.assert_allclose(plain[plain["variable"] == "a"]["acf"], want)
    assert plain[plain["variable"] == "c"]["lag"].max() == 44


def test_unit_root(full):
    plain = sorted_frame(tests_of_unit_root.adf(full, layout=PLAIN), ("variable",))
    # the number of lags tried follows the largest group, so a blocked layout has to know it
    from tidepanel.operators.layout import Layout

    split = sorted_frame(
        tests_of_unit_root.adf(full, layout=Layout(max_group_rows=310, block_rows=40)), ("variable",)
    )
    whole = sorted_frame(
        tests_of_unit_root.adf(full, layout=Layout(max_group_rows=310, block_rows=400)), ("variable",)
    )
    np.testing.assert_allclose(split["adf_statistic"], whole["adf_statistic"], rtol=1e-7)
    assert list(split["n_lags_used"]) == list(whole["n_lags_used"])
    assert len(plain) == 3


@pytest.fixture(scope="module")
def rest(full):
    return materialize(forecast.residuals(full, 0.3, "linear", layout=PLAIN))


def test_residuals(full, rest):
    split = sorted_frame(forecast.residuals(full, 0.3, "linear", layout=blocked(40)))
    same(split, sorted_frame(rest), rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("key", list(scorers.SCORERS))
@pytest.mark.parametrize("window_agg", [False, True])
def test_scores(rest, key, window_agg):
    def scored(layout):
        train, test = rest.where("is_train"), rest.where("not is_train")
        state = {k: materialize(v) for k, v in scorers.SCORERS[key].fit(train, layout).items()}
        return sorted_frame(scorers.SCORERS[key].score(test, state, layout, window_agg))

    plain, split = scored(PLAIN), scored(blocked(40))
    assert plain["error"].isna().all() and split["error"].isna().all()
    same(split.drop(columns="error"), plain.drop(columns="error"), rtol=1e-6, atol=1e-9)


def test_running_sums_at_rows_with_many_ties(spark):
    steps = spark.createDataFrame([("a", "v", x / 4, k) for k, x in enumerate(range(-8, 40), 1)], "series_id string, variable string, x double, c bigint")
    rows = [("a", "v", i, 1.0 if i % 3 else i / 50) for i in range(600)] + [("a", "v", 900, -5.0), ("a", "v", 901, 99.0)]
    probes = spark.createDataFrame(rows, "series_id string, variable string, pos bigint, x double")
    got = {r["pos"]: r["total"] for r in running_at(steps, probes, KEYS, "x", {"total": "c"}, blocked(20)).collect()}
    known = steps.collect()
    assert got == {pos: sum(s["c"] for s in known if s["x"] <= x) for _, _, pos, x in rows}


def test_forest(full):
    plain = sorted_frame(iforest.detect_isolation_forest(full, trees=20, layout=PLAIN))
    split = sorted_frame(iforest.detect_isolation_forest(full, trees=20, layout=blocked(50)))
    same(split, plain, rtol=1e-9, atol=1e-9)


def test_ranking(full):
    rows = full.select(
        *KEYS,
        F.lit("x").alias("scorer"),
        F.round("value", 1).alias("score"),
        (F.col("pos") % 7 == 0).cast("int").alias("y"),
    )
    order = ("variable",)
    plain = sorted_frame(evaluate.ranking_metrics(rows, PLAIN), order)
    same(sorted_frame(evaluate.ranking_metrics(rows, blocked(8)), order), plain, rtol=1e-9)


def test_large_groups_are_joined_apart(full, monkeypatch):
    """Flags, common ranges, severity and agreement with some groups broadcast and some shuffled."""
    rows = full.select(
        *KEYS, F.explode(F.array(F.lit("norm"), F.lit("kmeans"))).alias("scorer"), "ts", "pos", "n", "value"
    ).withColumn("score", F.abs("value") * F.when(F.col("scorer") == "norm", 1).otherwise(F.col("pos") % 5))
    rows = materialize(rows.where("scorer = 'norm' or pos > 7"))

    def run(layout):
        flagged = materialize(detect.flag(rows, 0.9, layout))
        severity = explain.severity(flagged, layout)
        agreement = evaluate.scorer_agreement(flagged, layout)
        tables = [flagged, severity, agreement, detect.combine_scorers(flagged, layout)]
        keys = [["variable", "scorer", "pos"], ["variable", "pos"], ["variable", "scorer_a", "scorer_b"], ["variable", "ts"]]
        return [sorted_frame(t, k) for t, k in zip(tables, keys)]

    plain = run(PLAIN)
    for share in (0.3, 1e-5, 1.0):
        monkeypatch.setattr("tidepanel.operators.layout.SHARE", share)
        for left, right in zip(run(blocked(60)), plain):
            same(left, right, rtol=1e-9)
