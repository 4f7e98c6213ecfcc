"""Queries over forecasting, scoring, flags, evaluation and explanation.

The queries named ``full_...`` run the default detection: lags by the sizing rule and all three scorers.
Their SQL solves the normal equations by elimination and runs the rounds of the clustering until they
settle, both as recursive queries. Each has a sibling without the prefix that uses the lag-1
forecaster and leaves the clustering out. Pipelines without SQL (boosted trees, isolation forest) are
checked by rows and by tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import texts
from tidepanel.model import KEYS, frame_to_panel
from tidepanel.operators import clean, detect, evaluate, explain, fitted, forecast, iforest, results, scorers
from tidepanel.operators.layout import Layout, with_position
from tidepanel.operators.quality import infer_frequency
from tidepanel.plans.panels import DAILY, HOURLY, MIXED, USERS, daily_panel, hourly_frame, regular_mixed_panel, user_panel
from tidepanel.plans import pipeline
from tidepanel.plans.registry import ORACLES, query, table
from tidepanel.plans.season_queries import UNIT_ROOT
from tidepanel.session import materialize, shared_folder
from tidepanel.sources import sinks

RATIO = 0.3
TOP = 0.95

SPLIT = DAILY + """,
cuts AS (
  SELECT variable, max(n) AS n, CAST(floor((max(n) - 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut
  FROM daily GROUP BY 1
),
sized AS (
  SELECT c.*, greatest(2, least(14, cut // 4)) AS lags, greatest(2, least(20, cut // 6)) AS w
  FROM cuts c
),
moments AS (
  SELECT d.variable, avg(value) AS mean, stddev_pop(value) AS spread
  FROM daily d JOIN sized s USING (variable) WHERE d.pos < s.cut GROUP BY 1
),
scaled AS (
  SELECT d.*, s.cut, s.lags, s.w, m.mean, m.spread,
    (d.value - m.mean) / CASE WHEN m.spread > 0 THEN m.spread ELSE 1 END AS z,
    CASE WHEN d.pos < s.cut THEN d.pos ELSE d.pos - s.cut END AS spos
  FROM daily d JOIN sized s USING (variable) JOIN moments m USING (variable)
)"""

LAG1 = SPLIT + """,
paired AS (SELECT *, lag(z) OVER (PARTITION BY variable ORDER BY pos) AS zp FROM scaled),
fitted AS (
  SELECT variable, regr_slope(z, zp) AS b, regr_intercept(z, zp) AS a
  FROM paired WHERE pos >= 1 AND pos < cut GROUP BY 1
),
resid AS (
  SELECT p.variable, p.ts, p.pos, p.spos, p.cut, p.w, p.value, p.mean, p.pos < p.cut AS is_train,
         p.z - (f.a + f.b * p.zp) AS r
  FROM paired p JOIN fitted f USING (variable) WHERE p.spos >= 1
)"""

#: Lags and window widths by the sizing rule, at most as many as it gives.
_LAGS, _WIDTH = range(1, 15), range(1, 21)

FULL = SPLIT + f""",
past AS (
  SELECT *, [1.0, {", ".join(f"CASE WHEN lags >= {i} THEN lag(z, {i}) OVER o ELSE 0 END" for i in _LAGS)}, z] AS x
  FROM scaled WINDOW o AS (PARTITION BY variable ORDER BY pos)
),
products AS (
  SELECT variable, i, j, sum(x[i] * x[j]) AS v FROM past, range(1, 16) a(i), range(1, 17) b(j)
  WHERE pos < cut AND spos >= lags GROUP BY 1, 2, 3
),
matrix AS (
  SELECT variable, list(r ORDER BY i) AS m FROM (
    SELECT variable, i, list(v ORDER BY j) AS r FROM products GROUP BY 1, 2) GROUP BY 1
),
elimination AS (
  SELECT variable, 1 AS k, m FROM matrix
  UNION ALL
  SELECT variable, k + 1, list_transform(m, lambda r, i: CASE WHEN m[k][k] = 0 THEN r
    WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
  FROM elimination WHERE k <= 15
),
fitted AS (
  SELECT variable, list_transform(m, lambda r: r[16]) AS b FROM elimination WHERE k = 16
),
resid AS (
  SELECT p.variable, p.ts, p.pos, p.spos, p.cut, p.lags, p.w, p.value, p.mean, p.pos < p.cut AS is_train,
         p.z - list_sum(list_transform(range(1, 16), lambda i: p.x[i] * f.b[i])) AS r
  FROM past p JOIN fitted f USING (variable) WHERE p.spos >= p.lags
)"""


def _scores(resid: str, first_end: str, part: str, more: str = "", thresholds_of: str = "NOT is_train") -> str:
    """Scores, flags and their combinations from residuals; ``part`` says which rows are scored."""
    return resid + f""",
train_sorted AS (
  SELECT variable, abs(r) AS t, row_number() OVER (PARTITION BY variable ORDER BY abs(r)) AS j,
         count(*) OVER (PARTITION BY variable) AS nt
  FROM resid WHERE is_train
),
window_rows AS (
  SELECT a.variable, a.ts, a.pos, a.w, a.is_train, abs(b.r) AS x,
         row_number() OVER (PARTITION BY a.variable, a.pos ORDER BY abs(b.r)) AS i
  FROM resid a JOIN resid b ON b.variable = a.variable AND b.pos BETWEEN a.pos - a.w + 1 AND a.pos
  WHERE ({part.replace("is_train", "a.is_train")}) AND a.spos >= {first_end} AND b.is_train = a.is_train
),
w1 AS (
  SELECT k.variable, k.ts, k.pos, k.is_train,
    sum(abs(k.x - t.t) * (least(k.i * t.nt, t.j * k.w) - greatest((k.i - 1) * t.nt, (t.j - 1) * k.w)))
      / max(k.w * t.nt) AS score
  FROM window_rows k JOIN train_sorted t ON t.variable = k.variable
    AND t.j * k.w > (k.i - 1) * t.nt AND (t.j - 1) * k.w < k.i * t.nt
  GROUP BY 1, 2, 3, 4
),
{more}
all_scores AS (
  SELECT variable, 'norm' AS scorer, ts, pos, is_train, abs(r) AS score FROM resid WHERE {part}
  UNION ALL SELECT variable, 'wasserstein', ts, pos, is_train, score FROM w1
  {"UNION ALL SELECT variable, 'kmeans', ts, pos, is_train, score FROM nearest" if more else ""}
),
scores AS (SELECT variable, scorer, ts, pos, score FROM all_scores WHERE NOT is_train),
limits AS (
  SELECT variable, scorer, quantile_cont(score, 0.95) AS threshold FROM all_scores WHERE {thresholds_of} GROUP BY 1, 2
),
flagged AS (
  SELECT s.*, l.threshold, CASE WHEN s.score > l.threshold THEN 1 ELSE 0 END AS is_anomaly
  FROM scores s JOIN limits l USING (variable, scorer)
),
spans AS (
  SELECT variable, max(a) AS a, min(b) AS b FROM (
    SELECT variable, scorer, min(ts) AS a, max(ts) AS b FROM flagged GROUP BY 1, 2) GROUP BY 1
),
components AS (
  SELECT f.variable, f.ts, max(f.is_anomaly) AS is_anomaly
  FROM flagged f JOIN spans s ON s.variable = f.variable AND f.ts BETWEEN s.a AND s.b GROUP BY 1, 2
),
common AS (
  SELECT max(a) AS a, min(b) AS b FROM (
    SELECT variable, min(ts) AS a, max(ts) AS b FROM components GROUP BY 1)
),
combined AS (
  SELECT c.ts, max(c.is_anomaly) AS any_anomaly FROM components c, common m
  WHERE c.ts BETWEEN m.a AND m.b GROUP BY 1
)"""


def _per_place(expression: str) -> str:
    return ", ".join(expression.replace("#", f"x[{i}]") for i in _WIDTH)


_NEARER_HIGH = """2 * list_sum(list_transform(range(1, w + 1), lambda i: x[i] * (hi[i] - lo[i])))
      > list_sum(list_transform(range(1, w + 1), lambda i: hi[i] * hi[i] - lo[i] * lo[i]))"""

#: Two centres from one spread below and above the mean window on, in rounds, and distances to the nearer.
TWO_MEANS = f"""
runs AS (
  SELECT a.variable, a.ts, a.pos, a.is_train, a.w, list(abs(b.r) ORDER BY b.pos) AS x
  FROM resid a JOIN resid b ON b.variable = a.variable AND b.pos BETWEEN a.pos - a.w + 1 AND a.pos
    AND b.is_train = a.is_train
  WHERE a.spos >= a.lags + a.w - 1 GROUP BY 1, 2, 3, 4, 5
),
start AS (
  SELECT variable, w, [{_per_place("avg(#)")}][1:w] AS m, [{_per_place("var_pop(#)")}][1:w] AS v
  FROM runs WHERE is_train GROUP BY 1, 2
),
rounds AS (
  SELECT variable, 0 AS k, list_transform(range(1, w + 1), lambda i: m[i] - sqrt(v[i])) AS lo,
    list_transform(range(1, w + 1), lambda i: m[i] + sqrt(v[i])) AS hi,
    list_avg(v) * 1e-12 AS still, CAST('inf' AS DOUBLE) AS shift
  FROM start
  UNION ALL
  SELECT variable, k + 1, lo2, hi2, still, list_distance(lo, lo2) ** 2 + list_distance(hi, hi2) ** 2
  FROM (
    SELECT variable, k, lo, hi, still,
      list_transform(range(1, w + 1), lambda i: CASE WHEN n1 > 0 THEN s1[i] ELSE lo[i] END) AS lo2,
      list_transform(range(1, w + 1), lambda i: CASE WHEN n2 > 0 THEN s2[i] ELSE hi[i] END) AS hi2
    FROM (
      SELECT variable, w, any_value(k) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(still) AS still,
        count(*) FILTER (NOT high) AS n1, count(*) FILTER (high) AS n2,
        [{_per_place("avg(#) FILTER (NOT high)")}] AS s1, [{_per_place("avg(#) FILTER (high)")}] AS s2
      FROM (
        SELECT t.variable, t.k, t.lo, t.hi, t.still, r.w, r.x, {_NEARER_HIGH} AS high
        FROM rounds t JOIN runs r ON r.variable = t.variable AND r.is_train
        WHERE t.shift > t.still AND t.k < 300)
      GROUP BY 1, 2))
),
centres AS (SELECT variable, arg_max(lo, k) AS lo, arg_max(hi, k) AS hi FROM rounds GROUP BY 1),
nearest AS (
  SELECT r.variable, r.ts, r.pos, r.is_train, least(list_distance(r.x, c.lo), list_distance(r.x, c.hi)) AS score
  FROM runs r JOIN centres c USING (variable)
),"""

SCORES = _scores(LAG1, "a.w", "NOT is_train")

FULL_SCORES = _scores(FULL, "a.lags + a.w - 1", "NOT is_train", TWO_MEANS)

#: As above with thresholds from the fit rows' own scores.
FITTED_SCORES = _scores(FULL, "a.lags + a.w - 1", "true", TWO_MEANS, "is_train")

LABELS = """
labels_daily AS (
  SELECT l_shipdate AS ts, max(CASE WHEN l_extendedprice * (1 - l_discount) > 104000 THEN 1 ELSE 0 END)
    AS y
  FROM lineitem GROUP BY 1
)"""

SCORES_LABELLED = SCORES + "," + LABELS


def daily_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A day is anomalous if one of its lines is very large."""
    lines = table(spark, folder, "lineitem")
    large = F.col("l_extendedprice") * (1 - F.col("l_discount")) > 104000
    return clean.merge_labels(
        lines.select(
            F.lit("lineitem").alias("series_id"),
            F.col("l_shipdate").alias("ts"),
            large.cast("int").alias("y"),
        )
    )


def lag1_residuals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Layout]:
    panel, layout = daily_panel(spark, folder)
    return panel, forecast.residuals(panel, RATIO, "linear", lags=1, layout=layout), layout


def lag1_detection(spark: SparkSession, folder: str) -> tuple[DataFrame, detect.Detection]:
    panel, layout = daily_panel(spark, folder)
    found = detect.detect(
        panel, RATIO, ["norm", "wasserstein"], TOP, "linear", layout=layout, lags=1
    )
    return panel, found


def full_residuals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Layout]:
    """As many lags as the sizing rule gives."""
    panel, layout = daily_panel(spark, folder)
    return panel, forecast.residuals(panel, RATIO, "linear", layout=layout), layout


def full_detection(spark: SparkSession, folder: str) -> tuple[DataFrame, detect.Detection]:
    """Default lags and all scorers."""
    panel, layout = daily_panel(spark, folder)
    return panel, detect.detect(panel, RATIO, threshold_quantile=TOP, layout=layout)


def flagship(
    spark: SparkSession, folder: str, chosen: list[str] | None = None, lags: int | None = None
) -> DataFrame:
    """events -> hourly panel -> inferred grid -> fill -> residual scores -> flags -> OR.

    Default lags and all scorers, unless others are given.
    """
    frame, names = hourly_frame(spark, folder)
    panel = materialize(frame_to_panel(frame, names, series_id="events"))
    axis = panel.select("series_id", "ts").distinct()
    freq = infer_frequency(axis).first()["freq"]
    layout = Layout.measure(panel)
    regular = materialize(clean.regularise(panel, freq, layout))
    found = detect.detect(regular, RATIO, chosen, TOP, lags=lags)
    return found.combined


HOURLY_AROUND = HOURLY + """,
    axis AS (
      SELECT unnest(generate_series((SELECT min(ts) FROM hourly_known),
             (SELECT max(ts) FROM hourly_known), INTERVAL 1 HOUR)) AS ts),
    grid AS (
      SELECT v.variable, a.ts, k.value, row_number() OVER (PARTITION BY v.variable ORDER BY a.ts) - 1
               AS pos, count(*) OVER (PARTITION BY v.variable) AS n
      FROM axis a CROSS JOIN (SELECT DISTINCT variable FROM hourly_known) v
      LEFT JOIN hourly_known k ON k.variable = v.variable AND k.ts = a.ts),
    around AS (
      SELECT *,
        last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
        last_value(value IGNORE NULLS) OVER b AS pv,
        first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
        first_value(value IGNORE NULLS) OVER f AS nv
      FROM grid
      WINDOW
       b AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

_HOURLY_VALUE = """coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv, 0)
          AS value"""


@query(
    "detect_hourly_events",
    f"""
    WITH {HOURLY_AROUND},
    filled AS (
      SELECT variable, ts, pos, CAST(floor((n - 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut,
        {_HOURLY_VALUE} FROM around),
    m AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS sd FROM filled WHERE pos < cut
          GROUP BY 1),
    z AS (SELECT f.*, (value - mean) / sd AS z,
            lag((value - mean) / sd) OVER (PARTITION BY variable ORDER BY pos) AS zp
          FROM filled f JOIN m USING (variable)),
    fit AS (SELECT variable, regr_slope(z, zp) AS b, regr_intercept(z, zp) AS a FROM z
            WHERE pos >= 1 AND pos < cut GROUP BY 1),
    s AS (SELECT z.variable, ts, abs(z - (a + b * zp)) AS score FROM z JOIN fit USING (variable)
          WHERE pos >= cut + 1),
    q AS (SELECT variable, quantile_cont(score, 0.95) AS t FROM s GROUP BY 1)
    SELECT 'events' AS series_id, ts, max(CASE WHEN score > t THEN 1 ELSE 0 END) AS any_anomaly
    FROM s JOIN q USING (variable) GROUP BY 2
    """,
)
def detect_hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder, ["norm"], lags=1)


_FULL_HOURLY = FULL_SCORES.replace(
    DAILY, HOURLY_AROUND + f", daily AS (SELECT variable, ts, pos, n, {_HOURLY_VALUE} FROM around)"
)

query(
    "full_hourly_events",
    f"WITH RECURSIVE {_FULL_HOURLY} SELECT 'events' AS series_id, ts, any_anomaly FROM combined",
)(flagship)


@query(
    "split_standardize",
    f"""
    WITH {SPLIT}
    SELECT variable, ts, n, cut, CAST(lags AS INTEGER) AS lags, CAST(w AS INTEGER) AS "window",
      CASE WHEN pos < cut THEN 'train' ELSE 'test' END AS split, round(z, 6) AS scaled FROM scaled
    """,
)
def split_standardize(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    rows = forecast.split_standardise(panel, RATIO, layout)
    return rows.select(
        "variable", "ts", "n", "cut", "lags", "window", "split", F.round("scaled", 6).alias("scaled")
    )


@query(
    "lag_linear_residual_norm",
    f"WITH {LAG1} SELECT variable, ts, is_train, round(abs(r), 6) AS score FROM resid",
)
def lag_linear_residual_norm(
    spark: SparkSession, folder: str, residuals: Callable = lag1_residuals
) -> DataFrame:
    _, rest, _ = residuals(spark, folder)
    return rest.select("variable", "ts", "is_train", F.round(F.abs("resid"), 6).alias("score"))


@query(
    "forecast_linear",
    f"""
    WITH RECURSIVE {FULL}
    SELECT 'lineitem' AS series_id, variable, ts, pos, spos, cut, is_train, CAST(lags AS INTEGER) AS lags,
      CAST(w AS INTEGER) AS "window", round(value, 9) AS value, round(r, 6) AS resid
    FROM resid
    """,
)
def forecast_linear(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    rest = forecast.residuals(panel, RATIO, "linear", layout=layout).drop("n")
    return rest.withColumns({"value": F.round("value", 9), "resid": F.round("resid", 6)})


@query("gbt_forecast")
def gbt_forecast(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    return forecast.residuals(panel, RATIO, "gbt", layout=layout)


@query(
    "wasserstein_window",
    f"WITH {SCORES} SELECT variable, ts, round(score, 6) AS score FROM w1",
)
def wasserstein_window(
    spark: SparkSession, folder: str, residuals: Callable = lag1_residuals
) -> DataFrame:
    _, rest, layout = residuals(spark, folder)
    scored = scorers.wasserstein_scores(materialize(rest), layout)
    return scored.select("variable", "ts", F.round("score", 6).alias("score"))


@query(
    "wasserstein_per_row",
    f"""
    WITH {SCORES}, covered AS (
      SELECT r.variable, r.ts, avg(k.score) AS score
      FROM resid r JOIN w1 k ON k.variable = r.variable AND k.pos BETWEEN r.pos AND r.pos + r.w - 1
      WHERE NOT r.is_train GROUP BY 1, 2)
    SELECT variable, ts, round(score, 6) AS score FROM covered
    """,
)
def wasserstein_per_row(
    spark: SparkSession, folder: str, residuals: Callable = lag1_residuals
) -> DataFrame:
    _, rest, layout = residuals(spark, folder)
    scored = scorers.wasserstein_scores(materialize(rest), layout, window_agg=True)
    return scored.select("variable", "ts", F.round("score", 6).alias("score"))


@query(
    "kmeans_scorer",
    f"""
    WITH RECURSIVE {FULL_SCORES}
    SELECT 'lineitem' AS series_id, variable, 'kmeans' AS scorer, ts, pos, round(score, 5) AS score
    FROM nearest WHERE NOT is_train
    """,
)
def kmeans_scorer(spark: SparkSession, folder: str) -> DataFrame:
    _, rest, layout = full_residuals(spark, folder)
    scored = scorers.kmeans_scores(materialize(rest), layout).drop("n")
    return scored.withColumn("score", F.round("score", 5))


@query(
    "detect_all_scorers",
    f"WITH RECURSIVE {FULL_SCORES} SELECT 'lineitem' AS series_id, ts, any_anomaly FROM combined",
)
def detect_all_scorers(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    return detect.detect(panel, RATIO, layout=layout).combined


@query(
    "fit_then_score",
    f"""
    WITH RECURSIVE {FITTED_SCORES}
    SELECT variable, scorer, ts, round(score, 5) AS score, round(threshold, 5) AS threshold, is_anomaly
    FROM flagged
    """,
)
def fit_then_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fit on the first 70 % of the days, write the model, read it back, score the other days."""
    panel, layout = daily_panel(spark, folder)
    cut = F.floor((F.col("n") - 1) * F.lit(1 - RATIO)).cast("bigint")
    first = materialize(panel.where(F.col("pos") < cut).withColumn("n", cut))
    rest = panel.where(F.col("pos") >= cut).withColumn("pos", F.col("pos") - cut)
    rest = materialize(rest.withColumn("n", F.col("n") - cut))
    models = f"{shared_folder(spark).rstrip('/')}/tidepanel-models-{uuid.uuid4().hex}"
    version = fitted.save(fitted.fit(first, threshold_quantile=TOP, layout=layout), models)
    flagged, _ = fitted.score(rest, fitted.load(spark, models, version))
    return flagged.select(
        "variable",
        "scorer",
        "ts",
        F.round("score", 5).alias("score"),
        F.round("threshold", 5).alias("threshold"),
        "is_anomaly",
    )


_LABEL = "CASE scorer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.SCORER_LABELS.items()) + " END"


@query(
    "scorer_notes",
    f"""
    WITH {MIXED}, cuts AS (
      SELECT series_id, max(n) AS n, CAST(floor((max(n) - 1) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS cut FROM regular GROUP BY 1),
    sizes AS (
      SELECT *, greatest(2, least(14, cut // 4)) AS lags, greatest(2, least(20, cut // 6)) AS w FROM cuts),
    pairs AS (
      SELECT *, n - cut - lags AS tests, cut - lags AS trains FROM sizes, (VALUES ('norm'), ('kmeans'), ('wasserstein')) s(scorer)
      WHERE n >= 20),
    told AS (
      SELECT *, CASE WHEN trains <= 0 THEN 'the train part is not longer than the lags'
          WHEN tests <= 0 THEN 'the test part is not longer than the lags'
          WHEN scorer != 'norm' AND trains < w THEN 'no whole window in the train part'
          WHEN scorer != 'norm' AND tests < w THEN 'no whole window in the test part' END AS reason FROM pairs)
    SELECT series_id, 'value' AS variable, 'detect' AS step, {_LABEL} || ': left out, ' || reason AS note
    FROM told WHERE reason IS NOT NULL
    UNION ALL
    SELECT series_id, 'value', 'detect', CASE WHEN n < 20 THEN 'left out: fewer than 20 rows'
      ELSE 'short train part: less precise' END
    FROM sizes WHERE n < 20 OR cut < lags + 5
    """,
)
def scorer_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a detection over series of many lengths whose test parts are a tenth."""
    panel, layout = regular_mixed_panel(spark, folder)
    return detect.detect(panel, 0.1, threshold_quantile=TOP, layout=layout).notes


@query(
    "quantile_flag",
    f"""
    WITH {SCORES}
    SELECT variable, scorer, ts, round(threshold, 6) AS threshold, is_anomaly FROM flagged
    """,
)
def quantile_flag(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    return found.scores.select(
        "variable", "scorer", "ts", F.round("threshold", 6).alias("threshold"), "is_anomaly"
    )


@query("or_scorers", f"WITH {SCORES} SELECT variable, ts, is_anomaly FROM components")
def or_scorers(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    return found.components.select("variable", "ts", "is_anomaly")


@query("or_variables", f"WITH {SCORES} SELECT ts, any_anomaly FROM combined")
def or_variables(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    return found.combined.select("ts", "any_anomaly")


@query(
    "kpi_summary",
    f"""
    WITH {SCORES}
    SELECT 'lineitem' AS series_id, count(*) AS n_points,
      CAST(sum(any_anomaly) AS BIGINT) AS n_anomalies, round(avg(any_anomaly) * 100, 6) AS anomaly_rate
    FROM combined
    """,
)
def kpi_summary(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    return detect.kpi_summary(found.combined).withColumn(
        "anomaly_rate", F.round("anomaly_rate", 6)
    )


@query(
    "top5_variables",
    f"""
    WITH {SCORES}, c AS (
      SELECT variable, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies FROM components GROUP BY 1)
    SELECT variable, n_anomalies,
      CAST(row_number() OVER (ORDER BY n_anomalies DESC, variable) AS INTEGER) AS rank,
      round(n_anomalies / greatest(max(n_anomalies) OVER (), 1), 6) AS share
    FROM c QUALIFY rank <= 5
    """,
)
def top5_variables(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    return results.top_variables(found.components).select(
        "variable", "n_anomalies", "rank", F.round("share", 6).alias("share")
    )


# ---------------------------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------------------------

_RANKED = """
joined AS (
  SELECT GROUPING_KEY AS k, score, y FROM SOURCE
),
per_score AS (
  SELECT k, score, sum(y) AS p, sum(1 - y) AS q FROM joined GROUP BY 1, 2
),
cumulated AS (
  SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp FROM per_score
  WINDOW d AS (PARTITION BY k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ranked AS (
  SELECT k,
    CASE WHEN sum(p) > 0 AND sum(q) > 0
      THEN round(CAST(sum(q * (tp - p + p / 2)) AS DOUBLE) / CAST(sum(p) AS DOUBLE)
                 / CAST(sum(q) AS DOUBLE), 6) END AS auc_roc,
    CASE WHEN sum(p) > 0 AND sum(q) > 0
      THEN round(sum(p * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) END
      AS auc_pr
  FROM cumulated GROUP BY 1
)"""

_DOCUMENTS = """
WITH docs AS (
  SELECT 'quality' AS target, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS y
  FROM documents d JOIN labels l USING (doc_id)
  UNION ALL
  SELECT 'toxic', CAST(d.n_chars AS DOUBLE), l.toxic FROM documents d JOIN labels l USING (doc_id)
), """


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    marks = table(spark, folder, "labels").unpivot(
        ["doc_id"], ["quality", "toxic"], "target", "y"
    )
    return docs.join(marks, "doc_id").select("target", "score", "y")


@query(
    "auc_documents",
    _DOCUMENTS
    + _RANKED.replace("GROUPING_KEY", "target").replace("SOURCE", "docs")
    + " SELECT k AS target, auc_roc, auc_pr FROM ranked",
)
def auc_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_scores(spark, folder)
    result = evaluate.ranking_metrics(rows, keys=["target"])
    return result.select("target", *[F.round(c, 6).alias(c) for c in ("auc_roc", "auc_pr")])


@query(
    "auc_roc_pr",
    f"""
    WITH {SCORES_LABELLED}, labelled AS (
      SELECT f.variable || '/' || f.scorer AS vs, f.score, coalesce(l.y, 0) AS y
      FROM flagged f LEFT JOIN labels_daily l USING (ts)),
    """
    + _RANKED.replace("GROUPING_KEY", "vs").replace("SOURCE", "labelled")
    + " SELECT k AS variable_scorer, auc_roc, auc_pr FROM ranked",
)
def auc_roc_pr(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    rows = evaluate.with_labels(found.scores, daily_labels(spark, folder))
    result = evaluate.ranking_metrics(rows, found.layout)
    return result.select(
        F.concat_ws("/", "variable", "scorer").alias("variable_scorer"),
        *[F.round(c, 6).alias(c) for c in ("auc_roc", "auc_pr")],
    )


_PRF = """
prf AS (
  SELECT f.variable, f.scorer,
    CAST(sum(f.is_anomaly * coalesce(l.y, 0)) AS DOUBLE) AS tp,
    CAST(sum(f.is_anomaly) AS DOUBLE) AS det, CAST(sum(coalesce(l.y, 0)) AS DOUBLE) AS tru
  FROM flagged f LEFT JOIN labels_daily l USING (ts) GROUP BY 1, 2
)"""


@query(
    "prf1",
    f"""
    WITH {SCORES_LABELLED}, {_PRF}
    SELECT variable, scorer, CASE WHEN det > 0 THEN round(tp / det, 6) ELSE 0 END AS precision,
      CASE WHEN tru > 0 THEN round(tp / tru, 6) ELSE 0 END AS recall,
      CASE WHEN det + tru > 0 THEN round(2 * tp / (det + tru), 6) ELSE 0 END AS f1,
      CAST(det AS BIGINT) AS n_detected,
      (SELECT CAST(sum(coalesce(l.y, 0)) AS BIGINT) FROM combined c LEFT JOIN labels_daily l USING (ts))
        AS n_true_anomalies
    FROM prf
    """,
)
def prf1(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    labels = daily_labels(spark, folder)
    metrics = evaluate.evaluate_with_labels(found.scores, found.combined, labels, found.layout)
    return metrics.select(
        "variable",
        "scorer",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        "n_detected",
        "n_true_anomalies",
    )


@query(
    "best_auc",
    f"""
    WITH {SCORES_LABELLED}, labelled AS (
      SELECT f.variable || '/' || f.scorer AS vs, f.score, coalesce(l.y, 0) AS y
      FROM flagged f LEFT JOIN labels_daily l USING (ts)),
    """
    + _RANKED.replace("GROUPING_KEY", "vs").replace("SOURCE", "labelled")
    + """ SELECT 'lineitem' AS series_id, round(avg(best), 5) AS best_auc FROM (
          SELECT split_part(k, '/', 1) AS v, max(auc_roc) AS best FROM ranked GROUP BY 1)""",
)
def best_auc(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    rows = evaluate.with_labels(found.scores, daily_labels(spark, folder))
    best = evaluate.best_auc(evaluate.ranking_metrics(rows, found.layout))
    return best.withColumn("best_auc", F.round("best_auc", 5))


@query(
    "true_rate",
    f"""
    WITH {LABELS}
    SELECT 'lineitem' AS series_id, round(avg(y) * 100, 6) AS true_rate FROM labels_daily
    """,
)
def true_rate(spark: SparkSession, folder: str) -> DataFrame:
    rate = evaluate.true_rate(daily_labels(spark, folder))
    return rate.withColumn("true_rate", F.round("true_rate", 6))


@query(
    "confusion",
    f"""
    WITH {SCORES_LABELLED}
    SELECT t.y, a.any_anomaly, (SELECT count(*) FROM combined c LEFT JOIN labels_daily l USING (ts)
      WHERE coalesce(l.y, 0) = t.y AND c.any_anomaly = a.any_anomaly) AS n
    FROM (VALUES (0), (1)) t(y) CROSS JOIN (VALUES (0), (1)) a(any_anomaly)
    WHERE (SELECT count(DISTINCT coalesce(l.y, 0)) FROM combined c LEFT JOIN labels_daily l USING (ts)) = 2
    """,
)
def confusion(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    table_2x2 = evaluate.confusion(found.combined, daily_labels(spark, folder))
    return table_2x2.drop("series_id")


_UNSUPERVISED = """
unsup AS (
  SELECT variable, scorer, CAST(sum(is_anomaly) AS BIGINT) AS n_detected,
    avg(is_anomaly) AS rate, avg(score) AS mean, stddev_pop(score) AS std, max(score) AS top,
    avg(CASE WHEN is_anomaly = 1 THEN score END) / avg(CASE WHEN is_anomaly = 0 THEN score END) AS ratio
  FROM flagged GROUP BY 1, 2
)"""


@query(
    "unsupervised_metrics",
    f"""
    WITH {SCORES}, {_UNSUPERVISED}
    SELECT variable, scorer, n_detected, round(rate, 6) AS detection_rate,
      round(mean, 6) AS score_mean, round(std, 6) AS score_std, round(top, 6) AS score_max,
      round(ratio, 6) AS separation_ratio FROM unsup
    """,
)
def unsupervised_metrics(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    metrics = evaluate.evaluate_unsupervised(found.scores)
    names = ["detection_rate", "score_mean", "score_std", "score_max", "separation_ratio"]
    return metrics.select(
        "variable", "scorer", "n_detected", *[F.round(c, 6).alias(c) for c in names]
    )


@query(
    "agreement",
    f"""
    WITH {SCORES}
    SELECT a.variable, a.scorer AS scorer_a, b.scorer AS scorer_b,
      round(avg(CASE WHEN a.is_anomaly = b.is_anomaly THEN 1.0 ELSE 0.0 END), 6) AS agreement
    FROM flagged a JOIN flagged b ON b.variable = a.variable AND b.ts = a.ts
    JOIN spans s ON s.variable = a.variable AND a.ts BETWEEN s.a AND s.b
    GROUP BY 1, 2, 3
    """,
)
def agreement(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    pairs = evaluate.scorer_agreement(found.scores, found.layout)
    return pairs.select(
        "variable", "scorer_a", "scorer_b", F.round("agreement", 6).alias("agreement")
    )


@query(
    "metric_table_unlabelled",
    f"""
    WITH {SCORES}, {_UNSUPERVISED}
    SELECT variable, scorer, n_detected, round(rate * 100, 2) AS detection_percent,
      round(mean, 3) AS score_mean, round(top, 3) AS score_max, round(ratio, 2) AS separation_ratio
    FROM unsup
    """,
)
def metric_table_unlabelled(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    shown = results.unlabelled_table(evaluate.evaluate_unsupervised(found.scores))
    return shown.drop("series_id")


@query(
    "metric_table_labelled",
    f"""
    WITH {SCORES_LABELLED}, {_PRF}, labelled AS (
      SELECT f.variable || '/' || f.scorer AS vs, f.score, coalesce(l.y, 0) AS y
      FROM flagged f LEFT JOIN labels_daily l USING (ts)),
    """
    + _RANKED.replace("GROUPING_KEY", "vs").replace("SOURCE", "labelled")
    + """
    SELECT p.variable, p.scorer, round(r.auc_roc, 3) AS auc_roc, round(r.auc_pr, 3) AS auc_pr,
      CASE WHEN det > 0 THEN round(tp / det, 3) ELSE 0 END AS precision,
      CASE WHEN tru > 0 THEN round(tp / tru, 3) ELSE 0 END AS recall,
      CASE WHEN det + tru > 0 THEN round(2 * tp / (det + tru), 3) ELSE 0 END AS f1,
      (SELECT CAST(sum(coalesce(l.y, 0)) AS BIGINT) FROM combined c LEFT JOIN labels_daily l USING (ts))
        AS n_true_anomalies, CAST(det AS BIGINT) AS n_detected
    FROM prf p JOIN ranked r ON r.k = p.variable || '/' || p.scorer
    """,
)
def metric_table_labelled(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    labels = daily_labels(spark, folder)
    metrics = evaluate.evaluate_with_labels(found.scores, found.combined, labels, found.layout)
    return results.labelled_table(metrics).drop("series_id")


# ---------------------------------------------------------------------------------------------
# Explanation and result tables
# ---------------------------------------------------------------------------------------------

SEVERITY = SCORES + """,
score_spans AS (
  SELECT variable, scorer, min(score) AS lo, max(score) AS hi, min(ts) AS a, max(ts) AS b
  FROM flagged GROUP BY 1, 2 HAVING max(score) - min(score) >= 1e-12
),
severity AS (
  SELECT f.variable, f.ts, min(f.pos) AS pos, avg((f.score - s.lo) / (s.hi - s.lo)) AS severity
  FROM flagged f JOIN score_spans s USING (variable, scorer)
  JOIN (SELECT variable, max(a) AS a, min(b) AS b FROM score_spans GROUP BY 1) c
    ON c.variable = f.variable AND f.ts BETWEEN c.a AND c.b
  GROUP BY 1, 2
)"""


@query(
    "severity_topn",
    f"""
    WITH {SEVERITY}
    SELECT variable, ts, round(severity, 6) AS severity FROM severity
    ORDER BY severity.severity DESC, variable, ts LIMIT 25
    """,
)
def severity_topn(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    top = explain.top_anomalies(found.scores, 25, layout=found.layout)
    return top.select("variable", "ts", F.round("severity", 6).alias("severity"))


_RANK = "CASE scorer " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(scorers.SCORERS)) + " END"

_DIRECTION = f"CASE WHEN value > m THEN '{texts.DIRECTION_UP}' ELSE '{texts.DIRECTION_DOWN}' END"

_CONFIDENCE = f"""CASE WHEN hits >= 2 THEN '{texts.CONFIDENCE_HIGH}' WHEN hits = 1
  THEN '{texts.CONFIDENCE_MEDIUM}' ELSE '{texts.CONFIDENCE_REFERENCE}' END"""


def _signed(number: str) -> str:
    return f"CASE WHEN {number} >= 0 THEN '+' ELSE '' END || printf('%.1f', {number})"


def _explained(severity: str, top: str) -> str:
    """SQL that tells about the rows of ``top``."""
    return f"""
    WITH {severity}, top AS ({top}),
    base AS (
      SELECT d.variable, avg(d.value) AS m, stddev_samp(d.value) AS s
      FROM daily d JOIN sized z USING (variable) WHERE d.pos < z.cut GROUP BY 1),
    facts AS (
      SELECT t.variable, t.ts, d.value, (d.value - b.m) / greatest(b.s, 1e-12) AS sigma,
        coalesce((SELECT avg(e.value) FROM daily e WHERE e.variable = t.variable
                  AND e.pos BETWEEN t.pos - 10 AND t.pos - 1), b.m) AS recent, b.m,
        (SELECT count(*) FROM flagged f WHERE f.variable = t.variable AND f.ts = t.ts
          AND f.is_anomaly = 1) AS hits,
        (SELECT string_agg(scorer, ',' ORDER BY {_RANK}) FROM flagged f
          WHERE f.variable = t.variable AND f.ts = t.ts AND f.is_anomaly = 1) AS detected_by,
        (SELECT string_agg({_LABEL}, ', ' ORDER BY {_RANK}) FROM flagged f
          WHERE f.variable = t.variable AND f.ts = t.ts AND f.is_anomaly = 1) AS labels
      FROM top t JOIN daily d ON d.variable = t.variable AND d.pos = t.pos
      JOIN base b ON b.variable = t.variable)
    SELECT variable, ts, round(value, 4) AS value, round(sigma, 6) AS sigma_from_mean,
      CASE WHEN abs(recent) > 1e-9 THEN round((value - recent) / abs(recent) * 100, 6) END
        AS pct_change_recent,
      {_DIRECTION} AS direction, coalesce(detected_by, '') AS detected_by, {_CONFIDENCE} AS confidence_label,
      concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), '변수: ' || variable,
        '평균 대비 ' || {_signed("sigma")} || 'σ (시그마)', {_DIRECTION},
        CASE WHEN abs(recent) > 1e-9
          THEN '직전 구간 대비 ' || {_signed("(value - recent) / abs(recent) * 100")} || '% 변화' END,
        CASE WHEN hits >= 2 THEN labels || ' 동시 탐지' WHEN hits = 1 THEN labels || ' 탐지' END,
        '→ ' || {_CONFIDENCE}) AS summary
    FROM facts
    """


_TOP_TEN = "SELECT * FROM severity ORDER BY severity.severity DESC, variable, ts LIMIT 10"


@query("explain_topn", _explained(SEVERITY, _TOP_TEN))
def explain_topn(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    panel, found = detection(spark, folder)
    return _told(explain.explain_top_anomalies(found.scores, panel, found.sizes, 10, layout=found.layout)).drop("series_id")


def _told(told: DataFrame) -> DataFrame:
    return told.select(
        "series_id",
        "variable",
        "ts",
        F.round("value", 4).alias("value"),
        F.round("sigma_from_mean", 6).alias("sigma_from_mean"),
        F.round("pct_change_recent", 6).alias("pct_change_recent"),
        "direction",
        F.array_join("detected_by", ",").alias("detected_by"),
        "confidence_label",
        F.array_join("summary_lines", "|").alias("summary"),
    )


#: Each user is a series of one variable; the SQL calls the user the variable.
_USER_SCORES = FULL_SCORES.replace(DAILY, USERS)


@query(
    "explain_per_series",
    _explained(
        SEVERITY.replace(SCORES, _USER_SCORES),
        "SELECT * FROM severity QUALIFY row_number() OVER (PARTITION BY variable ORDER BY severity.severity DESC, ts) <= 5",
    )
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace("SELECT variable, ts, round(value, 4)", "SELECT variable AS series_id, ts, round(value, 4)")
    .replace("'변수: ' || variable", "'변수: value'"),
)
def explain_per_series(spark: SparkSession, folder: str) -> DataFrame:
    """The five worst days of each user."""
    panel, layout = user_panel(spark, folder)
    found = detect.detect(panel, RATIO, threshold_quantile=TOP, layout=layout)
    told = explain.explain_top_anomalies(found.scores, panel, found.sizes, layout=found.layout)
    return _told(told).drop("variable")


@query(
    "focus_range",
    f"""
    WITH {SCORES}, hits AS (
      SELECT variable, min(ts) AS a, max(ts) AS b FROM components WHERE is_anomaly = 1 GROUP BY 1),
    pad AS (
      SELECT *, CAST(floor(greatest(epoch_us(b) - epoch_us(a), 1000000) * CAST(0.15 AS DOUBLE))
                     AS BIGINT) AS p FROM hits)
    SELECT h.variable, greatest(d.lo, make_timestamp(epoch_us(h.a) - h.p)) AS focus_from,
      least(d.hi, make_timestamp(epoch_us(h.b) + h.p)) AS focus_to
    FROM pad h JOIN (SELECT variable, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1) d
      USING (variable)
    """,
)
def focus_range(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    panel, found = detection(spark, folder)
    return results.focus_range(panel, found.components).drop("series_id")


@query(
    "flagged_series",
    f"""
    WITH {SCORES}
    SELECT d.variable, d.ts, round(d.value, 4) AS value, coalesce(c.is_anomaly, 0) AS is_anomaly
    FROM daily d LEFT JOIN components c USING (variable, ts)
    """,
)
def flagged_series(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    panel, found = detection(spark, folder)
    rows = results.flagged_series(panel, found.components)
    return rows.select("variable", "ts", F.round("value", 4).alias("value"), "is_anomaly")


@query(
    "anomaly_points",
    f"""
    WITH {SCORES}
    SELECT d.variable, d.ts, round(d.value, 4) AS value
    FROM daily d JOIN components c USING (variable, ts) WHERE c.is_anomaly = 1
    """,
)
def anomaly_points(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    panel, found = detection(spark, folder)
    rows = results.anomaly_points(panel, found.components)
    return rows.select("variable", "ts", F.round("value", 4).alias("value"))


@query(
    "score_pivot",
    f"""
    WITH {SCORES}
    SELECT variable, ts, round(max(CASE WHEN scorer = 'norm' THEN score END), 6) AS norm_score,
      max(CASE WHEN scorer = 'norm' THEN is_anomaly END) AS norm_is_anomaly,
      round(max(CASE WHEN scorer = 'wasserstein' THEN score END), 6) AS wasserstein_score,
      max(CASE WHEN scorer = 'wasserstein' THEN is_anomaly END) AS wasserstein_is_anomaly,
      max(is_anomaly) AS any_scorer
    FROM flagged GROUP BY 1, 2
    """,
)
def score_pivot(
    spark: SparkSession, folder: str, detection: Callable = lag1_detection
) -> DataFrame:
    _, found = detection(spark, folder)
    wide = results.score_table(found.scores, list(found.scorers))
    parts = [
        column
        for key in found.scorers
        for column in (F.round(f"{key}_score", 6).alias(f"{key}_score"), f"{key}_is_anomaly")
    ]
    return wide.select("variable", "ts", *parts, "any_scorer")


def _full(name: str) -> str:
    """The SQL of a query over the default detection instead of the lag-1 one."""
    sql = ORACLES[name].replace(SCORES.strip(), FULL_SCORES).replace(LAG1.strip(), FULL)
    if name == "score_pivot":
        sql = sql.replace(
            "      max(is_anomaly) AS any_scorer",
            """      round(max(CASE WHEN scorer = 'kmeans' THEN score END), 6) AS kmeans_score,
      max(CASE WHEN scorer = 'kmeans' THEN is_anomaly END) AS kmeans_is_anomaly,
      max(is_anomaly) AS any_scorer""",
        )
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


for _query in (
    quantile_flag, or_scorers, or_variables, kpi_summary, top5_variables, auc_roc_pr, prf1, best_auc,
    confusion, unsupervised_metrics, agreement, metric_table_unlabelled, metric_table_labelled,
    severity_topn, explain_topn, focus_range, flagged_series, anomaly_points, score_pivot,
):
    query(f"full_{_query.__name__}", _full(_query.__name__))(partial(_query, detection=full_detection))
for _query in (lag_linear_residual_norm, wasserstein_window, wasserstein_per_row):
    query(f"full_{_query.__name__}", _full(_query.__name__))(partial(_query, residuals=full_residuals))


@query(
    "guard_notes",
    f"""
    WITH {HOURLY}, sizes AS (
      SELECT variable, max(n) AS n, CAST(floor((max(n) - 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut,
        sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS gaps FROM hourly GROUP BY 1)
    SELECT 'events' AS series_id, variable, 'detect' AS step, CASE WHEN n < 20 THEN 'left out: fewer than 20 rows'
      WHEN gaps > 0 THEN 'left out: missing values remain' ELSE 'short train part: less precise' END AS note
    FROM sizes WHERE n < 20 OR gaps > 0 OR cut < greatest(2, least(14, cut // 4)) + 5
    """,
)
def guard_notes(spark: SparkSession, folder: str) -> DataFrame:
    """What a panel with holes is told."""
    frame, names = hourly_frame(spark, folder)
    panel = materialize(frame_to_panel(frame, names, series_id="events"))
    placed = with_position(panel, Layout.measure(panel))
    return forecast.guard_notes(forecast.sizing(placed, RATIO))


_REPORT_ROWS = {
    "overview": ["n_rows", "n_cols", "n_missing", "duration_seconds"],
    "stationarity": ["adf_statistic", "adf_pvalue", "is_stationary"],
    "kpi": ["n_points", "n_anomalies"],
    "metrics": ["n_detected", "detection_percent", "score_mean", "score_max"],
    "explanations": ["value"],
}


@query(
    "report_tables",
    f"""
    WITH RECURSIVE {FULL_SCORES}, {UNIT_ROOT.replace(DAILY + ",", "")}, {_UNSUPERVISED},
    {SEVERITY.replace(SCORES + ",", "")},
    facts AS (
      SELECT 'overview' AS part, '' AS variable, '' AS scorer, unnest(['n_rows', 'n_cols', 'n_missing', 'duration_seconds']) AS name,
        unnest([CAST(max(n) AS DOUBLE), count(DISTINCT variable), 0, epoch(max(ts)) - epoch(min(ts))]) AS value FROM daily
      UNION ALL
      SELECT 'stationarity', variable, '', unnest(['adf_statistic', 'adf_pvalue', 'is_stationary']),
        unnest([round(tau, 3), round(p_value, 4), CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END]) FROM unit_root
      UNION ALL
      SELECT 'kpi', '', '', unnest(['n_points', 'n_anomalies']), unnest([CAST(count(*) AS DOUBLE), sum(any_anomaly)]) FROM combined
      UNION ALL
      SELECT 'metrics', variable, scorer, unnest(['n_detected', 'detection_percent', 'score_mean', 'score_max']),
        unnest([CAST(n_detected AS DOUBLE), round(rate * 100, 2), round(mean, 3), round(top, 3)]) FROM unsup
      UNION ALL
      SELECT 'explanations', t.variable, '', 'value', round(d.value, 4) FROM (
        SELECT * FROM severity ORDER BY severity.severity DESC, variable, ts LIMIT 5) t
      JOIN daily d ON d.variable = t.variable AND d.pos = t.pos
    )
    SELECT part, variable, scorer, name, value, CAST(8 AS INTEGER) AS n_tables FROM facts
    """,
)
def report_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A whole analysis, its report published as one run and read back through the manifest."""
    panel, _ = daily_panel(spark, folder)
    tables = pipeline.report(pipeline.analyse(panel.drop("pos", "n"), options=pipeline.Options(forest=False)))
    reports = f"{shared_folder(spark).rstrip('/')}/tidepanel-reports-{uuid.uuid4().hex}"
    run = sinks.published(spark, reports, sinks.publish(tables, reports, "daily"))
    rows = []
    for part, names in _REPORT_ROWS.items():
        found = run.tables[part]
        keys = [
            (F.col(c) if c in found.columns else F.lit("")).alias(c) for c in ("variable", "scorer")
        ]
        cells = found.select(F.lit(part).alias("part"), *keys, *[F.col(c).cast("double").alias(c) for c in names])
        rows.append(cells.unpivot(["part", "variable", "scorer"], names, "name", "value"))
    return reduce(DataFrame.unionByName, rows).withColumn("n_tables", F.lit(len(run.tables)))


# ---------------------------------------------------------------------------------------------
# Isolation forest
# ---------------------------------------------------------------------------------------------




def _mix32(x: str) -> str:
    """``iforest.mix32`` of an expression, which stands in the text once."""
    steps = ("xor(v, v >> 16) * 2246822507 % 4294967296", "xor(v, v >> 13) * 3266489909 % 4294967296", "xor(v, v >> 16)")
    lists = f"[CAST({x} AS UBIGINT)]"
    for step in steps:
        lists = f"list_transform({lists}, lambda v: CAST({step} AS UBIGINT))"
    return f"{lists}[1]"


def _path(rows: str) -> str:
    return f"""CASE WHEN {rows} <= 1 THEN 0 WHEN {rows} = 2 THEN 1
      ELSE 2 * (ln({rows} - 1) + CAST('{iforest.EULER}' AS DOUBLE)) - 2 * CAST({rows} - 1 AS DOUBLE) / {rows} END"""


def _level(depth: int) -> str:
    """Nodes of a depth with their cuts (no cut: a leaf), and the rows of the next depth."""
    edges = "[" + ", ".join(f"#(f[{i}])" for i in range(1, 5)) + "]"
    cut = f"""
cut{depth} AS MATERIALIZED (
  SELECT variable, t, c, m, i, CASE WHEN cut >= hi[i] THEN lo[i] ELSE cut END AS cut
  FROM (
    SELECT *, lo[i] + CAST(h2 AS DOUBLE) / CAST(4294967296 AS DOUBLE) * (hi[i] - lo[i]) AS cut
    FROM (
      SELECT *, CASE WHEN m > 1 AND {depth} < 8 THEN
        list_filter([1, 2, 3, 4], lambda q: hi[q] > lo[q])[CAST((h1 * CAST(open AS UBIGINT)) >> 32 AS BIGINT) + 1] END AS i
      FROM (
        SELECT variable, t, c, count(*) AS m, {edges.replace("#", "min")} AS lo, {edges.replace("#", "max")} AS hi,
          len(list_filter([1, 2, 3, 4], lambda q: hi[q] > lo[q])) AS open,
          {_mix32(f"xor(any_value(k), {_mix32(f'2 * ({iforest.CUT_NUMBERS} + c)')})")} AS h1,
          {_mix32(f"xor(any_value(k), {_mix32(f'2 * ({iforest.CUT_NUMBERS} + c) + 1')})")} AS h2
        FROM rows{depth} GROUP BY 1, 2, 3)))
)"""
    if depth == 8:
        return cut
    return cut + f""",
rows{depth + 1} AS MATERIALIZED (
  SELECT r.variable, r.t, r.k, 2 * r.c + CASE WHEN r.f[x.i] > x.cut THEN 1 ELSE 0 END AS c, r.f
  FROM rows{depth} r JOIN cut{depth} x ON x.variable = r.variable AND x.t = r.t AND x.c = r.c WHERE x.i IS NOT NULL
)"""


def _step(depth: int) -> str:
    return f"""
walk{depth + 1} AS (
  SELECT w.variable, w.pos, w.t, w.f,
    CASE WHEN x.i IS NULL THEN w.c ELSE 2 * w.c + CASE WHEN w.f[x.i] > x.cut THEN 1 ELSE 0 END END AS c
  FROM walk{depth} w LEFT JOIN cut{depth} x ON x.variable = w.variable AND x.t = w.t AND x.c = w.c
)"""


#: The forest of series of 129 rows or more: hashed draws and cuts, eight levels, paths of all rows.
FOREST = DAILY + f""",
feats AS MATERIALIZED (
  SELECT variable, ts, pos, n, [value, value - avg(value) OVER w, coalesce(stddev_samp(value) OVER w, 0),
    coalesce(value - lag(value) OVER (PARTITION BY variable ORDER BY pos), 0)] AS f
  FROM daily WINDOW w AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)
),
tree_keys AS MATERIALIZED (
  SELECT variable, n, t, {_mix32(f"xor({_mix32('t')}, g)")} AS k
  FROM (SELECT variable, max(n) AS n,
      CAST(CAST('0x' || substr(md5('42' || chr(31) || 'lineitem' || chr(31) || variable), 1, 8) AS BIGINT) AS UBIGINT) AS g
    FROM daily GROUP BY 1), range({iforest.TREES}) r(t)
),
draws AS (
  SELECT variable, t, k, j, CASE WHEN n <= 256 THEN j ELSE CAST(floor(CAST(
      {_mix32(f"xor(k, {_mix32('2 * j')})")} * 2097152 + ({_mix32(f"xor(k, {_mix32('2 * j + 1')})")} >> 11) AS DOUBLE)
      / CAST(9007199254740992 AS DOUBLE) * n) AS BIGINT) END AS pos
  FROM tree_keys, range(1024) d(j) WHERE n > 256 OR j < n
),
sampled AS (
  SELECT variable, t, any_value(k) AS k, pos, min(j) AS j FROM draws GROUP BY variable, t, pos
  QUALIFY row_number() OVER (PARTITION BY variable, t ORDER BY min(j)) <= 256
),
rows0 AS MATERIALIZED (
  SELECT s.variable, s.t, s.k, 1 AS c, f.f FROM sampled s JOIN feats f ON f.variable = s.variable AND f.pos = s.pos
),{",".join(_level(d) for d in range(9))},
leaves AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT variable, t, c, {d} + {_path('m')} AS length FROM cut{d} WHERE i IS NULL" for d in range(9))}
),
walk0 AS (SELECT variable, pos, t, f, 1 AS c FROM feats, range({iforest.TREES}) r(t)),
{",".join(_step(d) for d in range(8))},
raw AS (
  SELECT w.variable, w.pos, avg(l.length) AS path FROM walk8 w
  JOIN leaves l ON l.variable = w.variable AND l.t = w.t AND l.c = w.c GROUP BY 1, 2
),
raw_scores AS (
  SELECT f.variable, f.ts, f.pos, f.n, 2 ** (-r.path / ({_path("least(f.n, 256)")})) AS s
  FROM feats f JOIN raw r USING (variable, pos)
),
forest AS (
  SELECT r.variable, r.ts, r.pos, r.n, r.s - q.q AS score, CASE WHEN r.s - q.q > 0 THEN 1 ELSE 0 END AS is_anomaly
  FROM raw_scores r JOIN (SELECT variable, quantile_cont(s, 0.95) AS q FROM raw_scores GROUP BY 1) q USING (variable)
)"""


@query(
    "iforest",
    f"""
    WITH {FOREST}
    SELECT 'lineitem' AS series_id, variable, 'iforest' AS scorer, ts, pos, n, round(score, 6) AS score, is_anomaly FROM forest
    """,
)
def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    found = iforest.detect_isolation_forest(panel, layout=layout)
    return found.withColumn("score", F.round("score", 6))


@query(
    "iforest_combined",
    f"""
    WITH {FOREST}
    SELECT 'lineitem' AS series_id, ts, max(is_anomaly) AS any_anomaly_iforest FROM forest GROUP BY 2
    """,
)
def iforest_combined(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    found = iforest.detect_isolation_forest(panel, layout=layout)
    return iforest.combine_forest(found)


@query(
    "iforest_eval",
    f"""
    WITH {FOREST}, {LABELS}, labelled AS (
      SELECT f.variable, f.score, coalesce(l.y, 0) AS y FROM forest f LEFT JOIN labels_daily l USING (ts)),
    """
    + _RANKED.replace("GROUPING_KEY", "variable").replace("SOURCE", "labelled")
    + " SELECT 'lineitem' AS series_id, k AS variable, 'iforest' AS scorer, auc_roc, auc_pr FROM ranked",
)
def iforest_eval(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    found = materialize(iforest.detect_isolation_forest(panel, layout=layout))
    labelled = evaluate.with_labels(found, daily_labels(spark, folder))
    metrics = evaluate.ranking_metrics(labelled, layout)
    return metrics.withColumns({c: F.round(c, 6) for c in ("auc_roc", "auc_pr")})
