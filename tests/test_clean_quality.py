import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import PLAIN, START, blocked, panel_of, sorted_frame
from pyspark.sql import functions as F

from tidepanel.functions import frequency as freq_names
from tidepanel.functions.scalar import duration_text
from tidepanel.model import frame_to_panel, panel_to_frame
from tidepanel.operators import clean, quality, season
from tidepanel.operators.layout import Layout
from tidepanel.plans.pipeline import prepare


def test_linear_fill_counts_rows_not_time(spark):
    days = [0, 1, 2, 9, 10, 11]
    values = [None, 1.0, None, None, 4.0, None]
    rows = [("s", "v", START + dt.timedelta(days=d), i, 6, v) for i, (d, v) in enumerate(zip(days, values))]
    df = spark.createDataFrame(
        rows,
        "series_id string, variable string, ts timestamp_ntz, pos bigint, n bigint, value double",
    )
    got = sorted_frame(clean.fill(df, layout=PLAIN))["value"]
    assert list(got) == [1, 1, 2, 3, 4, 4]
    timed = sorted_frame(clean.fill(df, layout=PLAIN, by="time"))["value"]
    np.testing.assert_allclose(timed, [1, 1, 1 + 3 / 9, 1 + 3 * 8 / 9, 4, 4])


def test_fill_rejects_unknown_method(spark):
    with pytest.raises(ValueError):
        clean.fill(panel_of(spark, {"v": [1.0]}), "guess", PLAIN)


def test_fill_takes_nan_for_missing(spark):
    frame = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0)], "i int, v double")
    panel = frame_to_panel(
        frame.withColumn("ts", F.expr("timestampadd(DAY, i, TIMESTAMP_NTZ'2024-01-01 00:00:00')")), ["v"]
    )
    assert panel.where("value is null").count() == 1


def test_repeated_instants(spark):
    ts = START
    rows = spark.createDataFrame(
        [("s", "v", ts, 1.0), ("s", "v", ts, 4.0)], "series_id string, variable string, ts timestamp_ntz, value double"
    )
    assert clean.merge_repeated(rows).first()["value"] == 2.5
    labels = spark.createDataFrame([("s", ts, 0), ("s", ts, 1), ("s", ts, None)], "series_id string, ts timestamp_ntz, y int")
    assert clean.merge_labels(labels).first()["y"] == 1


def test_constant_variables(spark):
    panel = panel_of(spark, {"const": [2.0] * 5, "none": [None] * 5, "moves": [1, 2, 1, 2, 1]})
    kept = clean.drop_constant(panel)
    assert {r[0] for r in kept.select("variable").distinct().collect()} == {"moves"}


@pytest.mark.parametrize(
    "code,start,periods",
    [
        ("min", "2024-01-01", 50), ("15min", "2024-01-01", 50), ("h", "2024-01-01", 30),
        ("6h", "2024-01-01", 30), ("D", "2024-01-01", 40), ("3D", "2024-01-01", 20),
        ("B", "2024-01-01", 30), ("W-SUN", "2024-01-07", 12), ("ME", "2023-01-31", 14),
        ("MS", "2023-01-01", 14), ("QS-OCT", "2022-01-01", 9), ("QE-DEC", "2022-03-31", 9),
        ("YS-JAN", "2015-01-01", 8), ("YE-DEC", "2015-12-31", 8), ("2MS", "2020-01-01", 9),
        ("250ms", "2024-01-01", 20), ("BME", "2023-01-31", 14),
    ],
)
def test_frequency_codes(spark, code, start, periods):
    index = pd.date_range(start, periods=periods, freq=code)
    axis = spark.createDataFrame([("s", t.to_pydatetime()) for t in index], "series_id string, ts timestamp_ntz")
    got = quality.infer_frequency(axis, PLAIN).first()
    assert got["freq"] == pd.infer_freq(index)
    panel = axis.withColumn("variable", F.lit("v")).withColumn("value", F.lit(1.0))
    grid = clean.regular_grid(panel, got["freq"])
    assert [r["ts"] for r in grid.orderBy("ts").collect()] == [t.to_pydatetime() for t in index]


def test_frequency_falls_back_on_commonest_gap(spark):
    minutes = [0, 5, 10, 15, 22, 27, 34, 39]
    axis = spark.createDataFrame(
        [("s", START + dt.timedelta(minutes=m)) for m in minutes] + [("t", START)], "series_id string, ts timestamp_ntz"
    )
    got = {r["series_id"]: r["freq"] for r in quality.infer_frequency(axis, PLAIN).collect()}
    assert got == {"s": "5min", "t": None}


def test_grid_inserts_and_drops(spark):
    minutes = [0, 10, 13, 30]
    panel = spark.createDataFrame(
        [("s", "v", START + dt.timedelta(minutes=m), float(m)) for m in minutes],
        "series_id string, variable string, ts timestamp_ntz, value double",
    )
    got = sorted_frame(clean.regular_grid(panel, "10min"))
    assert got["value"].tolist()[:2] == [0.0, 10.0]
    assert np.isnan(got["value"][2]) and got["value"][3] == 30.0
    small_steps = sorted_frame(clean.regular_grid(panel, "10min", block_rows=2))
    assert small_steps["pos"].tolist() == [0, 1, 2, 3]


def test_default_periods(spark):
    cases = [("D", 14, 7), ("D", 13, None), ("15min", 120, 60), ("W-SUN", 500, 50), (None, 9, 2), (None, 3, None), ("h", 48, 24)]
    df = spark.createDataFrame([(c, n) for c, n, _ in cases], "freq string, n bigint")
    got = [r["period"] for r in season.period_from_frequency(df).collect()]
    assert got == [p for _, _, p in cases]


def test_duration_texts(spark):
    df = spark.createDataFrame([(400 * 86400,), (5 * 86400 + 7,), (5400,)], "s bigint")
    got = [r[0] for r in df.select(duration_text(F.col("s"))).collect()]
    assert got == ["약 1.1년 (400일)", "5일", "약 1.5시간"]
    assert freq_names.step_micros("15min") == 15 * 60 * 10**6


def test_quality_counts_raw_rows(spark):
    frame = spark.createDataFrame(
        [(START, 1.0, None), (START, 2.0, 5.0), (START + dt.timedelta(hours=3), None, 5.0)],
        "ts timestamp_ntz, a double, b double",
    )
    got = quality.quality_summary(frame, ["a", "b"]).first()
    assert (got["n_rows"], got["n_cols"], got["n_missing"], got["n_duplicated_ts"]) == (3, 2, 2, 1)
    assert got["missing_ratio"] == pytest.approx(2 / 6)
    cols = {r["variable"]: (r["n_missing"], r["is_constant"]) for r in quality.quality_columns(frame, ["a", "b"]).collect()}
    assert cols == {"a": (1, 0), "b": (1, 1)}


def test_describe_like_pandas(spark):
    values = [1.0, 2.0, None, 4.0, 8.0]
    got = quality.describe(panel_of(spark, {"v": values}), PLAIN).first()
    want = pd.Series(values, dtype=float).describe()
    np.testing.assert_allclose([got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")], want)


def test_wide_and_long(spark):
    panel = panel_of(spark, {"a": [1, 2], "b": [3, None]})
    wide = panel_to_frame(panel, ["a", "b"]).orderBy("ts").collect()
    assert [(r["a"], r["b"]) for r in wide] == [(1, 3), (2, None)]
    sparse = panel.where("value is not null")
    assert clean.complete(sparse, PLAIN).where("value is null").count() == 1


def test_completion_gives_each_series_its_own_names(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = {(f"s{rng.integers(6)}", f"v{rng.integers(5)}", START + dt.timedelta(hours=int(rng.integers(20)))) for _ in range(150)}
    panel = spark.createDataFrame([(*r, 1.0) for r in rows], "series_id string, variable string, ts timestamp_ntz, value double")
    names, instants = {}, {}
    for s, v, t in rows:
        names.setdefault(s, set()).add(v)
        instants.setdefault(s, set()).add(t)
    want = {(s, v, t, 1.0 if (s, v, t) in rows else None) for s in names for v in names[s] for t in instants[s]}
    for layout, share in ((PLAIN, 1e-5), (blocked(10), 0.2), (blocked(10), 0.9)):
        monkeypatch.setattr("tidepanel.operators.layout.SHARE", share)
        got = [tuple(r) for r in clean.complete(panel, layout).collect()]
        assert len(got) == len(want) and set(got) == want


def test_uneven_series_get_their_own_grid(spark):
    rows = [("even", "v", START + dt.timedelta(hours=i), float(i % 3)) for i in range(30)]
    rows += [("uneven", "v", START + dt.timedelta(minutes=m), float(m)) for m in [0, 5, 10, 25, 30]]
    panel = spark.createDataFrame(rows, "series_id string, variable string, ts timestamp_ntz, value double")
    filled, layout = prepare(panel)
    freq = quality.infer_frequency(panel.select("series_id", "ts").distinct(), layout)
    got = sorted_frame(clean.regularise_many(filled, freq, layout), ("series_id", "pos"))
    uneven = got[got["series_id"] == "uneven"]
    assert uneven["value"].tolist() == [0, 5, 10, 15, 20, 25, 30]
    assert (got["series_id"] == "even").sum() == 30


def test_each_series_gets_the_grid_of_its_code(spark):
    """One plan for all codes, against pandas."""
    codes = ["5h", "90min", "D", "2D", "W-TUE", "MS", "2MS", "ME", "BMS", "BME", "B", "QS-FEB", "QE-DEC", "YS-MAR", "BYE-JUN"]
    rows, want = [], {}
    for i, code in enumerate(codes):
        at = pd.date_range("2021-02-01", periods=40, freq=code) + pd.Timedelta(hours=0 if i % 2 else 7)
        keep = [t for k, t in enumerate(at) if k in (0, len(at) - 1) or k % 3]
        rows += [(code, "v", t.to_pydatetime(), float(k)) for k, t in enumerate(at) if t in keep]
        want[code] = [t.to_pydatetime() for t in at]
    panel = spark.createDataFrame(rows, "series_id string, variable string, ts timestamp_ntz, value double")
    given = spark.createDataFrame([(c, c) for c in codes] + [("none", None)], "series_id string, freq string")
    got = clean.regular_grid(panel, frequencies=given).toPandas().sort_values(["series_id", "pos"])
    for code in codes:
        mine = got[got["series_id"] == code]
        assert [t.to_pydatetime() for t in mine["ts"]] == want[code], code
        assert mine["pos"].tolist() == list(range(len(mine))) and (mine["n"] == len(mine)).all()
        assert mine["value"].isna().sum() == len(mine) - sum(r[0] == code for r in rows)
    for code in codes:
        one = clean.regular_grid(panel.where(F.col("series_id") == code), code)
        assert [r["ts"] for r in one.orderBy("pos").collect()] == want[code]


def test_uneven_series_beside_even_and_unknown_ones_in_large_groups(spark):
    rows = [("even", "v", START + dt.timedelta(hours=i), float(i)) for i in range(50)]
    rows += [("uneven", "v", START + dt.timedelta(hours=5 * i), float(i)) for i in range(80) if i % 7 != 3]
    rows += [("short", "v", START, 1.0), ("short", "v", START + dt.timedelta(days=3), 2.0)]
    panel = spark.createDataFrame(rows, "series_id string, variable string, ts timestamp_ntz, value double")
    results = []
    for layout in (PLAIN, blocked(16)):
        positioned = clean.with_position(panel, layout)
        freq = quality.infer_frequency(panel.select("series_id", "ts"), layout)
        results.append(sorted_frame(clean.regularise_many(positioned, freq, layout), ("series_id", "pos")))
    pd.testing.assert_frame_equal(*results)
    assert results[0].groupby("series_id").size().to_dict() == {"even": 50, "uneven": 80, "short": 2}
    with pytest.raises(Exception, match="unknown frequency code"):
        given = spark.createDataFrame([("even", "3fortnights")], "series_id string, freq string")
        clean.regular_grid(panel, frequencies=given).collect()


@pytest.mark.parametrize("method", ["interpolate_linear", "ffill", "bfill"])
def test_filled_grids_are_dealt_by_rows_and_equal_grid_then_fill(spark, monkeypatch, method):
    monkeypatch.setattr(clean, "GRID_ROWS", 8)
    rng = random.Random(3)
    rows = []
    for s in range(30):
        for v in ("a", "b"):
            for i in sorted(rng.sample(range(200), 12)):
                value = None if rng.random() < 0.2 or (s == 4 and v == "b") else float(rng.randint(0, 99))
                seconds = 30 if rng.random() < 0.1 else 0  # not on the grid
                rows.append((f"s{s}", v, START + dt.timedelta(hours=i, seconds=seconds), value))
    rows += [("one", "a", START, 1.0), ("bad", "a", START, float("nan")), ("s1", "a", None, 5.0)]
    panel = spark.createDataFrame(rows, "series_id string, variable string, ts timestamp_ntz, value double")
    codes = [(f"s{s}", "h" if s % 3 else "2h") for s in range(29)] + [("one", "h"), ("bad", "min"), ("s29", "B")]
    frequencies = spark.createDataFrame(codes, "series_id string, freq string")
    want = clean.fill(clean.regular_grid(panel, frequencies=frequencies), method, PLAIN)
    got = clean.regularise(panel, None, PLAIN, method, frequencies)
    by = ("series_id", "variable", "pos")
    pd.testing.assert_frame_equal(sorted_frame(got, by), sorted_frame(want, by))
    # before, the few bytes that describe the grids made one partition
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 16
