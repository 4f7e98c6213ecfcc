import datetime as dt

import numpy as np
import pytest
from conftest import PLAIN, START, blocked, panel_of, sorted_frame, wavy
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators import detect, evaluate, explain, forecast, iforest, results, scorers
from tidepanel.plans import detect_queries
from tidepanel.plans.registry import QUERIES
from tidepanel.session import materialize

SPIKES = [620, 655, 700, 741, 790]


@pytest.fixture(scope="module")
def spiky(spark):
    y = wavy(800, 11, slope=0.0)
    for i, at in enumerate(SPIKES):
        y[at] += 12 * (-1) ** i
    return materialize(panel_of(spark, {"a": list(y), "b": list(wavy(800, 12))}))


@pytest.fixture(scope="module")
def found(spiky):
    return detect.detect(spiky, 0.3)


@pytest.fixture(scope="module")
def rest(spiky):
    return materialize(forecast.residuals(spiky, 0.3, layout=PLAIN))


def test_linear_forecast_equals_least_squares(spiky, rest):
    y = spiky.where("variable = 'a'").toPandas().sort_values("pos")["value"].to_numpy()
    cut = int(799 * 0.7)
    z = (y - y[:cut].mean()) / y[:cut].std()

    def design(part):
        rows = [np.r_[part[t - 14 : t][::-1], 1] for t in range(14, len(part))]
        return np.array(rows), part[14:]

    x, target = design(z[:cut])
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    want = []
    for part in (z[:cut], z[cut:]):
        x, target = design(part)
        want.append(target - x @ beta)
    got = sorted_frame(rest.where("variable = 'a'"))["resid"]
    np.testing.assert_allclose(got, np.concatenate(want), atol=1e-9)


def test_wasserstein_equals_sorted_distance(rest):
    rows = sorted_frame(rest.where("variable = 'a'"))
    w = int(rows["window"].iloc[0])
    x = rows["resid"].abs().to_numpy()
    train = np.sort(x[rows["is_train"]])
    test = x[~rows["is_train"]]
    got = sorted_frame(scorers.wasserstein_scores(rest, PLAIN).where("variable = 'a'"))["score"]
    grid = np.union1d(np.arange(len(train) + 1) / len(train), np.arange(w + 1) / w)
    mid, length = (grid[1:] + grid[:-1]) / 2, np.diff(grid)
    t = train[(mid * len(train)).astype(int)]
    want = []
    for end in range(w, len(test) + 1):
        win = np.sort(test[end - w : end])[(mid * w).astype(int)]
        want.append((np.abs(win - t) * length).sum())
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_signed_wasserstein_differs(rest):
    signed = scorers.wasserstein_scores(rest, PLAIN, signed=True).agg(F.sum("score")).first()[0]
    size = scorers.wasserstein_scores(rest, PLAIN).agg(F.sum("score")).first()[0]
    assert signed > 0 and signed != pytest.approx(size)


def test_two_means_equal_plain_rounds(rest):
    rows = sorted_frame(rest.where("variable = 'a'"))
    w = int(rows["window"].iloc[0])
    x = rows["resid"].abs().to_numpy()
    is_train = rows["is_train"].to_numpy()
    train = np.lib.stride_tricks.sliding_window_view(x[is_train], w)
    test = np.lib.stride_tricks.sliding_window_view(x[~is_train], w)
    mean, var = train.mean(axis=0), train.var(axis=0)
    centres = [mean - np.sqrt(var), mean + np.sqrt(var)]
    for _ in range(10):
        near = ((train - centres[1]) ** 2).sum(1) < ((train - centres[0]) ** 2).sum(1)
        centres = [train[~near].mean(axis=0), train[near].mean(axis=0)]
    want = np.sqrt(np.minimum(*[((test - c) ** 2).sum(1) for c in centres]))
    scored = scorers.kmeans_scores(rest, PLAIN, max_iter=10, tolerance=0.0)
    got = sorted_frame(scored.where("variable = 'a'"))["score"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_spikes_are_on_top(found):
    scores = sorted_frame(found.scores.where("variable = 'a' and scorer = 'norm'"))
    top = set(scores.nlargest(8, "score")["pos"])
    assert set(SPIKES) <= top
    flagged = scores[scores["is_anomaly"] == 1]
    assert len(flagged) <= np.ceil(0.05 * len(scores))


def test_or_covers_each_part(found):
    parts = found.scores.groupBy(*KEYS, "ts").agg(F.max("is_anomaly").alias("any"))
    joined = found.components.join(parts, KEYS + ["ts"])
    assert joined.where("any <> is_anomaly").count() == 0
    combined = found.combined.join(
        found.components.groupBy("series_id", "ts").agg(F.max("is_anomaly").alias("m")), ["series_id", "ts"]
    )
    assert combined.where("m <> any_anomaly").count() == 0


def test_guards(spark, spiky):
    with pytest.raises(ValueError):
        detect.detect(spiky, scorers=[])
    with pytest.raises(ValueError):
        detect.detect(spiky, test_ratio=0.9)
    with pytest.raises(ValueError):
        detect.detect(spiky, threshold_quantile=0.5)
    small = panel_of(spark, {"few": [1.0, 2.0, 3.0], "holes": [None if i == 5 else float(i % 4) for i in range(60)]})
    got = detect.detect(small, 0.3, ["norm"])
    notes = {r["variable"]: r["note"] for r in got.notes.collect()}
    assert set(notes) == {"few", "holes"}
    silent = got.combined.collect()
    assert silent and all(r["any_anomaly"] == 0 for r in silent)


def test_boosted_trees(spiky):
    rest = forecast.residuals(spiky.where("variable = 'a'"), 0.3, "gbt", layout=PLAIN, trees=2)
    test = rest.where("not is_train").toPandas()
    assert set(SPIKES) <= set(test.assign(r=test["resid"].abs()).nlargest(12, "r")["pos"])


def test_registered_boosting_has_all_trees_and_rows(spark, spiky, monkeypatch):
    made = []

    class Spy(forecast.GBTRegressor):
        def __init__(self, **options):
            made.append(options["maxIter"])
            super().__init__(**{**options, "maxIter": 2})

    monkeypatch.setattr(forecast, "GBTRegressor", Spy)
    monkeypatch.setattr(detect_queries, "daily_panel", lambda *_: (spiky, PLAIN))
    rest = detect_queries.gbt_forecast(spark, "")
    linear = forecast.residuals(spiky, detect_queries.RATIO, "linear", layout=PLAIN)
    keys = ["series_id", "variable", "ts", "pos", "is_train"]
    n_variables = spiky.select("variable").distinct().count()
    assert made == [100] * n_variables and n_variables > 1
    assert rest.columns == linear.columns
    assert rest.count() == linear.count() and rest.select(keys).exceptAll(linear.select(keys)).isEmpty()
    assert rest.where("resid is null").isEmpty()
    cut = forecast.residuals(spiky, detect_queries.RATIO, "gbt", layout=blocked(100), trees=2)
    apart = cut.select("variable", "pos", F.col("resid").alias("other")).join(rest, ["variable", "pos"])
    assert apart.where("abs(other - resid) > 1e-9").isEmpty() and cut.count() == rest.count()


def brute_scores(y):
    """Scorer -> {position: score} of one series: 14 lags, plain least squares, windows one by one."""
    cut, w = int((len(y) - 1) * (1 - detect_queries.RATIO)), 20
    z = (y - y[:cut].mean()) / y[:cut].std()

    def design(part):
        return np.array([np.r_[part[t - 14 : t][::-1], 1] for t in range(14, len(part))])

    beta = np.linalg.lstsq(design(z[:cut]), z[14:cut], rcond=None)[0]
    train = np.abs(z[14:cut] - design(z[:cut]) @ beta)
    test = np.abs(z[cut + 14 :] - design(z[cut:]) @ beta)
    first = cut + 14
    norm = dict(enumerate(test, first))
    wins = np.lib.stride_tricks.sliding_window_view(test, w)
    seen = np.lib.stride_tricks.sliding_window_view(train, w)
    centres = [seen.mean(0) - seen.std(0), seen.mean(0) + seen.std(0)]
    for _ in range(300):
        near = ((seen - centres[1]) ** 2).sum(1) < ((seen - centres[0]) ** 2).sum(1)
        centres = [seen[~near].mean(0), seen[near].mean(0)]
    away = np.sqrt(np.minimum(*[((wins - c) ** 2).sum(1) for c in centres]))
    low = np.lcm(len(train), w)
    long = np.repeat(np.sort(train), low // len(train))
    apart = [np.abs(np.repeat(np.sort(win), low // w) - long).mean() for win in wins]
    return {"norm": norm, "kmeans": dict(enumerate(away, first + w - 1)), "wasserstein": dict(enumerate(apart, first + w - 1))}


def test_full_queries_equal_brute_force(spark, spiky, monkeypatch):
    monkeypatch.setattr(detect_queries, "daily_panel", lambda *_: (spiky, PLAIN))
    want, wide, pos = {}, {}, lambda r: int((r["ts"] - START).total_seconds() // 3600)
    for name in ("a", "b"):
        y = spiky.where(f"variable = '{name}'").toPandas().sort_values("pos")["value"].to_numpy()
        scores = brute_scores(y)
        flags = {k: {p: int(v > np.quantile(list(s.values()), 0.95)) for p, v in s.items()} for k, s in scores.items()}
        wide |= {(name, p): {k: s.get(p) for k, s in scores.items()} for p in scores["norm"]}
        want |= {(name, p): max(f[p] for f in flags.values()) for p in flags["kmeans"]}
    got = {(r["variable"], pos(r)): r for r in QUERIES["full_score_pivot"](spark, "").collect()}
    assert got.keys() == wide.keys()
    for key, scores in wide.items():
        for k, v in scores.items():
            assert got[key][f"{k}_score"] == (None if v is None else pytest.approx(v, abs=2e-6))
    flagged = {(r["variable"], pos(r)): r["is_anomaly"] for r in QUERIES["full_or_scorers"](spark, "").collect()}
    assert flagged == want
    kpi = QUERIES["full_kpi_summary"](spark, "").first()
    either = [max(want["a", p], want["b", p]) for v, p in want if v == "a"]
    assert (kpi["n_points"], kpi["n_anomalies"]) == (len(either), sum(either))
    centres = QUERIES["kmeans_scorer"](spark, "").collect()
    assert len(centres) == len(want)
    for r in centres:
        assert r["score"] == pytest.approx(wide[r["variable"], pos(r)]["kmeans"], abs=6e-6)


def test_every_query_of_a_cut_detection_has_a_full_twin():
    cut = {n for n, f in QUERIES.items() if {"detection", "residuals"} & set(getattr(f, "__annotations__", {}))}
    assert len(cut) == 22 and {f"full_{n}" for n in cut} <= set(QUERIES)


def scored(spark, rows):
    return spark.createDataFrame(
        [("s", "v", k, START + dt.timedelta(hours=t), float(s), a, y) for k, t, s, a, y in rows],
        "series_id string, variable string, scorer string, ts timestamp_ntz, score double, is_anomaly int, y int",
    )


def test_ranking_with_ties(spark):
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 8, 200), (rng.random(200) < 0.2).astype(int)
    rows = scored(spark, [("k", i, s, 0, int(v)) for i, (s, v) in enumerate(zip(score, y))] + [("one", 0, 1, 0, 0)])
    got = {r["scorer"]: r for r in evaluate.ranking_metrics(rows, PLAIN).collect()}
    pos, neg = score[y == 1], score[y == 0]
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert got["k"]["auc_roc"] == pytest.approx(pairs)
    average, before = 0.0, 0.0
    for limit in sorted(set(score), reverse=True):
        taken = score >= limit
        recall = y[taken].sum() / y.sum()
        average += (recall - before) * y[taken].mean()
        before = recall
    assert got["k"]["auc_pr"] == pytest.approx(average)
    assert got["one"]["auc_roc"] is None


def test_flag_metrics_and_confusion(spark):
    rows = scored(spark, [("k", 0, 1, 1, 1), ("k", 1, 1, 1, 0), ("k", 2, 1, 0, 1), ("k", 3, 1, 0, 0), ("none", 0, 1, 0, 0)])
    got = {r["scorer"]: r for r in evaluate.flag_metrics(rows).collect()}
    assert (got["k"]["precision"], got["k"]["recall"], got["k"]["f1"]) == (0.5, 0.5, 0.5)
    assert (got["none"]["precision"], got["none"]["f1"]) == (0.0, 0.0)
    combined = rows.where("scorer = 'k'").select("series_id", "ts", F.col("is_anomaly").alias("any_anomaly"))
    labels = rows.where("scorer = 'k' and y = 1").select("series_id", "ts", "y")
    cells = {(r["y"], r["any_anomaly"]): r["n"] for r in evaluate.confusion(combined, labels).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    assert evaluate.true_anomalies(combined, labels).first()["n_true_anomalies"] == 2
    aware = labels.withColumn("ts", F.col("ts").cast("timestamp"))
    assert evaluate.true_anomalies(combined, aware).first()["n_true_anomalies"] == 2


def test_unsupervised_edges(spark):
    rows = scored(spark, [("all", i, 1 + i, 1, 0) for i in range(3)] + [("zero", 0, 0, 0, 0), ("zero", 1, 5, 1, 0)])
    got = {r["scorer"]: r for r in evaluate.evaluate_unsupervised(rows).collect()}
    assert np.isnan(got["all"]["separation_ratio"]) and np.isinf(got["zero"]["separation_ratio"])
    assert got["all"]["score_std"] == pytest.approx(np.std([1, 2, 3]))


def test_agreement_is_symmetric(found):
    pairs = {(r["variable"], r["scorer_a"], r["scorer_b"]): r["agreement"] for r in evaluate.scorer_agreement(found.scores).collect()}
    assert len(pairs) == 18
    for (v, a, b), share in pairs.items():
        assert share == pairs[(v, b, a)] and (a != b or share == 1.0)
    matrix = evaluate.agreement_matrix(evaluate.scorer_agreement(found.scores), list(found.scorers))
    assert matrix.count() == 6


def test_explanations(found, spiky):
    told = explain.explain_top_anomalies(found.scores, spiky, found.sizes, 5).orderBy(F.desc("severity")).collect()
    assert len(told) == 5
    y = spiky.where("variable = 'a'").toPandas().sort_values("pos")["value"].to_numpy()
    cut = int(799 * 0.7)
    for row in told:
        if row["variable"] != "a":
            continue
        at = int((row["ts"] - START).total_seconds() // 3600)
        sigma = (y[at] - y[:cut].mean()) / y[:cut].std(ddof=1)
        assert row["sigma_from_mean"] == pytest.approx(sigma)
        recent = y[at - 10 : at].mean()
        assert row["pct_change_recent"] == pytest.approx((y[at] - recent) / abs(recent) * 100)
        assert row["summary_lines"][0] == row["ts"].strftime("%Y-%m-%d %H:%M:%S")
        assert row["summary_lines"][-1].startswith("→ ")
    assert results.explanation_table(explain.explain_top_anomalies(found.scores, spiky, found.sizes)).count() == 5


def test_each_series_is_explained(spark, monkeypatch):
    calm, wild = wavy(200, 3, slope=0.0), wavy(200, 4, slope=0.0)
    wild[150:200:3] += 20
    panel = panel_of(spark, {"a": list(calm), "b": list(calm[::-1])})
    panel = panel.unionByName(panel_of(spark, {"a": list(wild)}).withColumn("series_id", F.lit("wild")))
    panel = materialize(panel.unionByName(panel.where("series_id = 's'").withColumn("series_id", F.lit("t"))))
    found = detect.detect(panel, 0.3, ["norm"], layout=PLAIN)
    all_rows = explain.severity(found.scores).toPandas()
    want = {}
    for name, rows in all_rows.groupby("series_id"):
        rows = rows.sort_values(["severity", "variable", "ts"], ascending=[False, True, True]).head(4)
        want[name] = list(zip(rows["variable"], rows["pos"]))
    assert len(want) == 3
    top = explain.top_anomalies(found.scores, 4).orderBy("series_id", F.desc("severity"), "variable", "ts").collect()
    assert {k: [(r["variable"], r["pos"]) for r in top if r["series_id"] == k] for k in want} == want
    monkeypatch.setattr(detect_queries, "user_panel", lambda *_: (panel, PLAIN))
    told = detect_queries.explain_per_series(spark, "")
    assert {r["series_id"]: r["count"] for r in told.groupBy("series_id").count().collect()} == dict.fromkeys(want, 5)
    assert explain.explain_top_anomalies(found.scores, panel, found.sizes, 4, per_series=False).count() == 4


def test_forest_finds_spikes(spiky):
    got = sorted_frame(iforest.detect_isolation_forest(spiky, 0.05, layout=PLAIN))
    a = got[got["variable"] == "a"]
    assert len(set(SPIKES) & set(a.nlargest(25, "score")["pos"])) >= 4
    assert a["is_anomaly"].sum() == 40
    assert iforest.average_path(256) == pytest.approx(10.244, abs=0.01)


def test_result_tables(found, spiky):
    table = results.score_table(found.scores, list(found.scorers))
    assert table.where("any_scorer is null").count() == 0
    focus = results.focus_range(spiky, found.components).collect()
    spans = found.components.where("is_anomaly = 1").groupBy("variable").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    for f in focus:
        s = next(r for r in spans if r["variable"] == f["variable"])
        assert f["focus_from"] < s["a"] and f["focus_to"] >= s["b"]
    top = results.top_variables(found.components).orderBy("rank").collect()
    assert top[0]["share"] == 1.0 and len(top) == 2
    assert results.flagged_series(spiky, found.components).count() == 1600


def test_blocked_detection_equals_plain(spiky, found):
    split = detect.detect(spiky, 0.3, ["norm", "wasserstein"], layout=blocked(100))
    names = [*KEYS, "scorer", "ts"]
    joined = split.scores.join(found.scores.select(*names, F.col("is_anomaly").alias("w")), names)
    assert joined.count() == split.scores.count()
    assert joined.where("w <> is_anomaly").count() == 0
