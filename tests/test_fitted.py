"""Models as tables, and detections in which a part fails."""

import numpy as np
import pandas as pd
import pytest
from conftest import PLAIN, blocked, panel_of, sorted_frame, wavy
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators import detect, fitted, forecast, scorers
from tidepanel.session import intermediates, materialize

ORDER = ("scorer", "variable", "pos")


@pytest.fixture(scope="module")
def series():
    y = wavy(700, 21)
    y[600:605] += 9
    return {"a": list(y), "b": list(wavy(700, 22, period=12))}


@pytest.fixture(scope="module")
def found(spark, series):
    return detect.detect(materialize(panel_of(spark, series)), 0.3, layout=PLAIN)


CUT = int(699 * 0.7)


def parts(spark, series):
    first = panel_of(spark, {k: v[:CUT] for k, v in series.items()})
    return materialize(first), materialize(panel_of(spark, {k: v[CUT:] for k, v in series.items()}))


@pytest.mark.parametrize("layout", [PLAIN, blocked(60)], ids=["plain", "blocked"])
def test_a_model_read_back_scores_as_the_whole_run(spark, series, found, tmp_path, layout):
    first, rest = parts(spark, series)
    model = fitted.fit(first, layout=layout)
    assert model.notes.count() == 0
    version = fitted.save(model, str(tmp_path))
    again = fitted.load(spark, str(tmp_path), version)
    assert again.scorers == model.scorers and set(again.tables) == set(model.tables)
    flagged, notes = fitted.score(rest, again, layout)
    assert notes.count() == 0
    got, want = sorted_frame(flagged, ORDER), sorted_frame(found.scores, ORDER)
    assert (got["pos"] + CUT).tolist() == want["pos"].tolist()
    np.testing.assert_allclose(got["score"], want["score"], rtol=1e-6, atol=1e-8)
    own, _ = fitted.score(first, again, layout)
    own = sorted_frame(own, ORDER)
    limits = own.groupby(["scorer", "variable"])["score"].quantile(0.95)
    for (scorer, variable), rows in got.groupby(["scorer", "variable"]):
        np.testing.assert_allclose(rows["threshold"], limits[scorer, variable], rtol=1e-9)
        assert (rows["is_anomaly"] == (rows["score"] > rows["threshold"])).all()


def test_only_published_versions_are_read(spark, series, tmp_path):
    first, _ = parts(spark, series)
    with pytest.raises(Exception):
        fitted.load(spark, str(tmp_path / "none"))
    old = fitted.fit(first, ["norm"], version="old")
    fitted.save(old, str(tmp_path))
    # tables of a version whose manifest row was never written
    old.tables["thresholds"].write.parquet(str(tmp_path / "broken" / "thresholds"))
    assert fitted.load(spark, str(tmp_path)).version == "old"
    with pytest.raises(ValueError, match="broken"):
        fitted.load(spark, str(tmp_path), "broken")
    fitted.save(fitted.fit(first, ["norm"], 0.9, version="new"), str(tmp_path))
    newest = fitted.load(spark, str(tmp_path))
    assert (newest.version, newest.threshold_quantile) == ("new", 0.9)
    assert fitted.load(spark, str(tmp_path), "old").threshold_quantile == 0.95


def test_rows_the_model_cannot_score_have_notes(spark, series):
    first, rest = parts(spark, series)
    model = fitted.fit(first)
    holes = [None if i == 7 else v for i, v in enumerate(series["b"][CUT:])]
    new = panel_of(spark, {"a": series["a"][CUT : CUT + 10], "b": holes, "c": [1.0, 2.0]})
    flagged, notes = fitted.score(new, model)
    assert flagged.count() == 0
    told = notes.groupBy("variable").agg(F.collect_list("note").alias("notes")).collect()
    told = {r["variable"]: r["notes"] for r in told}
    assert len(told["a"]) == 3 and all("not longer than the lags" in n for n in told["a"])
    assert "left out: missing values remain" in told["b"]
    assert "left out: the model does not know it" in told["c"]
    with pytest.raises(ValueError):
        fitted.fit(first, ["no such scorer"])


def test_one_broken_variable_leaves_the_others_alone(spark, series):
    broken = list(series["b"])
    broken[5] = float("inf")
    panel = materialize(panel_of(spark, {**series, "inf": broken}))
    got = detect.detect(panel, 0.3, layout=PLAIN)
    notes = [(r["variable"], r["note"]) for r in got.notes.collect()]
    assert len(notes) == 3 and {v for v, _ in notes} == {"inf"}
    assert all("no forecast: values that are not finite" in n for _, n in notes)
    assert {r["variable"] for r in got.scores.select("variable").distinct().collect()} == {"a", "b"}
    model = fitted.fit(panel)
    assert [r["variable"] for r in model.notes.collect()] == ["inf"]
    _, told = fitted.score(panel, model)
    assert {(r["variable"]) for r in told.collect()} == {"inf"}


def test_short_test_parts_have_a_note_for_each_scorer(spark):
    panel = materialize(panel_of(spark, {"v": list(wavy(40, 3)), "w": list(wavy(150, 4))}))
    got = detect.detect(panel, 0.1, layout=PLAIN)
    notes = sorted((r["variable"], r["note"].split(": left out, ")[1]) for r in got.notes.collect())
    none, part = "the test part is not longer than the lags", "no whole window in the test part"
    assert notes == [("v", none)] * 3 + [("w", part)] * 2
    assert {r["scorer"] for r in got.scores.collect()} == {"norm"}


def test_an_error_inside_a_group_becomes_a_row():
    rows = pd.DataFrame(
        {"series_id": "s", "variable": "v", "ts": pd.Timestamp(0), "pos": range(6), "n": 6, "window": 2}
        | {"core": True, "x": 1.0, "cnt": np.nan, "mass": np.nan}
    )
    known = pd.DataFrame({"grid": [None], "xs": [[1.0]], "cnts": [[1.0]], "masses": [[1.0]], "total": [1]})
    got = scorers._transport((), rows, known)
    assert len(got) == 1 and "Error" in got["error"].iloc[0]
    bad = pd.DataFrame({"series_id": ["s"], "variable": ["v"], "x": [[1.0, 2.0]], "window": [2], "first_pos": [0], "low": [[1.0]], "high": [[1.0, 2.0, 3.0]]})
    (out,) = scorers._nearest([bad])
    assert len(out) == 1 and "ValueError" in out["error"].iloc[0]


def test_a_failing_boosted_fit_is_told(spark, series, monkeypatch):
    class Broken(forecast.GBTRegressor):
        def fit(self, rows):
            raise RuntimeError("no trees today")

    monkeypatch.setattr(forecast, "GBTRegressor", Broken)
    got = detect.detect(materialize(panel_of(spark, {"a": series["a"][:120]})), 0.3, forecaster="gbt", layout=PLAIN)
    assert got.scores.count() == 0
    notes = [r["note"] for r in got.notes.select("note").collect()]
    assert len(notes) == 3 and all("no forecast: no trees today" in n for n in notes)


def test_models_know_their_keys(spark, series):
    first, _ = parts(spark, series)
    model = fitted.fit(first, ["kmeans", "wasserstein"])
    assert set(model.tables) == {"forecast", "kmeans.centres", "wasserstein.quantiles", "thresholds"}
    for table in model.tables.values():
        assert set(KEYS) <= set(table.columns)


def test_intermediate_tables_go_with_their_scope(spark):
    outside = materialize(spark.range(2))
    with intermediates(spark):
        inside = materialize(spark.range(3))
        files = inside.inputFiles()
        assert inside.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()
    assert outside.count() == 2
