"""Queries over autocorrelation, periods, decomposition and stationarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import tails, texts
from tidepanel.operators import decompose, season, stationarity
from tidepanel.operators.windows import centred_mean
from tidepanel.operators.layout import halo_blocks
from tidepanel.plans.panels import DAILY, ORDERS, daily_panel, daily_raw, orders_panel
from tidepanel.plans.registry import query
from tidepanel.session import materialize

ACF = DAILY + """,
centred AS (
  SELECT variable, pos, n, value - avg(value) OVER (PARTITION BY variable) AS x FROM daily
),
acf AS (
  SELECT a.variable, a.n, k.lag, sum(a.x * b.x) / max(z.s0) AS acf
  FROM (SELECT unnest(generate_series(0, 200)) AS lag) k
  JOIN centred a ON a.pos >= k.lag
  JOIN centred b ON b.variable = a.variable AND b.pos = a.pos - k.lag
  JOIN (SELECT variable, sum(x * x) AS s0 FROM centred GROUP BY 1) z ON z.variable = a.variable
  GROUP BY 1, 2, 3
)"""


@query("acf_table", f"WITH {ACF} SELECT variable, lag, n, round(acf, 6) AS acf FROM acf")
def acf_table(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    lags = season.acf(panel, 200, layout)
    return lags.select("variable", "lag", "n", F.round("acf", 6).alias("acf"))


@query(
    "acf_period",
    f"""
    WITH {ACF}, near AS (
      SELECT *, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM acf
      WINDOW w AS (PARTITION BY variable ORDER BY lag)),
    peaks AS (
      SELECT variable, lag, row_number() OVER (PARTITION BY variable ORDER BY acf DESC, lag) AS rk
      FROM near WHERE lag BETWEEN 2 AND 199 AND acf > l AND acf > r)
    SELECT d.variable, d.n, CASE WHEN d.n < 400 THEN greatest(2, d.n // 10)
                                 ELSE coalesce(p.lag, 12) END AS period
    FROM (SELECT DISTINCT variable, n FROM daily) d
    LEFT JOIN peaks p ON p.variable = d.variable AND p.rk = 1
    """,
)
def acf_period(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    return season.estimate_period(panel, 200, layout).select("variable", "n", "period")


@query(
    "freq_default_period",
    f"""
    WITH {DAILY}, {ORDERS}, sized AS (
      SELECT variable, count(*) AS n, 'D' AS freq FROM daily_raw GROUP BY 1
      UNION ALL SELECT variable, count(*), '15min' FROM orders_panel GROUP BY 1
      UNION ALL SELECT variable, count(*), 'W-SUN' FROM orders_panel GROUP BY 1)
    SELECT variable, n, freq,
      CASE freq WHEN 'D' THEN CASE WHEN n >= 14 THEN 7 END
                WHEN '15min' THEN CASE WHEN n >= 120 THEN 60 END
                ELSE CASE WHEN n >= 2 * least(greatest(2, n // 10), greatest(2, n // 2 - 1))
                     THEN least(greatest(2, n // 10), greatest(2, n // 2 - 1)) END END AS period
    FROM sized
    """,
)
def freq_default_period(spark: SparkSession, folder: str) -> DataFrame:
    def sized(panel: DataFrame, code: str) -> DataFrame:
        return panel.groupBy("variable").agg(
            F.count(F.lit(1)).alias("n"), F.lit(code).alias("freq")
        )

    orders = orders_panel(spark, folder)
    rows = sized(daily_raw(spark, folder), "D")
    rows = rows.unionByName(sized(orders, "15min")).unionByName(sized(orders, "W-SUN"))
    return season.period_from_frequency(rows)


@query(
    "ljung_box",
    f"""
    WITH {ACF}, q AS (
      SELECT variable, n, n * (n + 2) * sum(acf * acf / (n - lag)) AS q
      FROM acf WHERE lag BETWEEN 1 AND 10 GROUP BY 1, 2)
    SELECT variable, CAST(10 AS BIGINT) AS lb_lags, round(q, 5) AS lb_statistic,
      round(exp(-q / 2) * (1 + q / 2 + power(q / 2, 2) / 2 + power(q / 2, 3) / 6
                           + power(q / 2, 4) / 24), 6) AS lb_pvalue
    FROM q
    """,
)
def ljung_box(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    result = stationarity.ljung_box(panel, 10, layout)
    return result.select(
        "variable",
        "lb_lags",
        F.round("lb_statistic", 5).alias("lb_statistic"),
        F.round("lb_pvalue", 6).alias("lb_pvalue"),
    )


#: Lagged differences that the SQL has room for: series of up to 3,900 rows.
_MOST_LAGS = 30


def _lagged_steps(limit: str) -> str:
    past = ", ".join(f"CASE WHEN {limit} >= {i} THEN lag(d, {i}) OVER o ELSE 0 END" for i in range(1, _MOST_LAGS + 1))
    return f"[d, level, 1.0, {past}]"


def _system(rows: str, more: str = "") -> str:
    """X'X of rows ``x`` as a list of lists per variable, with more columns if wanted."""
    width = _MOST_LAGS + 3
    return f"""
  SELECT variable, list(r ORDER BY i) AS m FROM (
    SELECT variable, i, list(v ORDER BY j){more} AS r FROM (
      SELECT variable, i, j, sum(x[i] * x[j]) AS v FROM {rows}, range(1, {width + 1}) a(i), range(1, {width + 1}) b(j)
      GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""


def _swept(source: str, name: str) -> str:
    """Elimination of one column after the other; what is left at [1][1] are the residual squares."""
    return f"""
{name} AS (
  SELECT variable, 1 AS k, m FROM {source}
  UNION ALL
  SELECT variable, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 OR m[k + 1][k + 1] = 0 THEN r
    ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM {name} WHERE k < {_MOST_LAGS + 3}
)"""


def _polynomial(x: str, terms: list[float]) -> str:
    return " + ".join(f"CAST({c} AS DOUBLE) * power({x}, {i})" for i, c in enumerate(terms))


#: The normal distribution function by the series of its odd powers, all of one sign.
_NORMAL = """0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160),
      lambda i: z * list_product(list_transform(range(1, i + 1), lambda q: z * z / (2 * q + 1)))))"""

UNIT_ROOT = DAILY + f""",
levels AS (
  SELECT *, y - lag(y) OVER (PARTITION BY variable ORDER BY pos) AS d, lag(y) OVER (PARTITION BY variable ORDER BY pos) AS level
  FROM (
    SELECT variable, pos, n, value - avg(value) OVER (PARTITION BY variable) AS y,
      CAST(least(ceil(12 * power(n / 100, 0.25)), n // 2 - 2) AS INTEGER) AS lim
    FROM daily)
),
all_lags AS (SELECT * FROM (
  SELECT variable, pos, lim, {_lagged_steps("lim")} AS x FROM levels WINDOW o AS (PARTITION BY variable ORDER BY pos))
  WHERE pos > lim
),
all_system AS ({_system("all_lags")}),{_swept("all_system", "all_swept")},
best AS (
  SELECT variable, any_value(n) AS n, arg_min(p, {{'aic': aic, 'p': p}}) AS p FROM (
    SELECT variable, n, k - 3 AS p, (n - 1 - lim) * (ln(2 * pi()) + ln(m[1][1] / (n - 1 - lim)) + 1) + 2 * (k - 1) AS aic
    FROM all_swept JOIN (SELECT variable, max(n) AS n, max(lim) AS lim FROM levels GROUP BY 1) USING (variable)
    WHERE k BETWEEN 3 AND lim + 3) GROUP BY 1
),
own_lags AS (SELECT * FROM (
  SELECT variable, pos, p, {_lagged_steps("p")} AS x FROM levels JOIN best USING (variable)
  WINDOW o AS (PARTITION BY variable ORDER BY pos)) WHERE pos > p
),
own_system AS ({_system("own_lags", " || [CASE WHEN i = 2 THEN 1.0 ELSE 0 END]")}),{_swept("own_system", "own_swept")},
unit_root AS (
  SELECT *, CASE WHEN tau > {tails.TAU_MAX} THEN 1 WHEN tau < {tails.TAU_MIN} THEN 0 ELSE greatest({_NORMAL}, 0) END AS p_value
  FROM (
    SELECT *, CASE WHEN tau <= {tails.TAU_SWITCH} THEN {_polynomial("tau", tails.TAU_SMALL)}
      ELSE {_polynomial("tau", tails.TAU_LARGE)} END AS z
    FROM (
      SELECT variable, n, p, n - 1 - p AS used,
        m[2][1] / m[2][2] / sqrt(m[1][1] / (n - 1 - p - (p + 2)) * m[2][{_MOST_LAGS + 4}] / m[2][2]) AS tau
      FROM own_swept JOIN best USING (variable) WHERE k = {_MOST_LAGS + 3}))
)"""


@query(
    "adf_test",
    f"""
    WITH RECURSIVE {UNIT_ROOT}
    SELECT 'lineitem' AS series_id, variable, n, round(tau, 6) AS adf_statistic, round(p_value, 6) AS adf_pvalue,
      CAST(p AS BIGINT) AS n_lags_used, CAST(used AS BIGINT) AS n_obs,
      {", ".join(f"round({_polynomial('(1.0 / used)', c)}, 6) AS critical_{k[:-1]}" for k, c in tails.TAU_CRITICAL.items())}
    FROM unit_root
    """,
)
def adf_test(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    tested = stationarity.adf(panel, layout=layout)
    limits = [F.round(F.col("critical")[k], 6).alias(f"critical_{k[:-1]}") for k in tails.TAU_CRITICAL]
    rounded = tested.withColumns({c: F.round(c, 6) for c in ("adf_statistic", "adf_pvalue")})
    return rounded.select("*", *limits).drop("critical")


SUMMARY = UNIT_ROOT + ACF.replace(DAILY, "") + f""",
portmanteau AS (
  SELECT variable, exp(-q / 2) * (1 + q / 2 + power(q / 2, 2) / 2 + power(q / 2, 3) / 6 + power(q / 2, 4) / 24) AS lb
  FROM (SELECT variable, n * (n + 2) * sum(acf * acf / (n - lag)) AS q FROM acf WHERE lag BETWEEN 1 AND 10 GROUP BY variable, n)
),
summary AS (
  SELECT *, CASE WHEN p_value < {stationarity.ALPHA} THEN 1 ELSE 0 END AS is_stationary,
    CASE WHEN lb < {stationarity.ALPHA} THEN 1 ELSE 0 END AS correlated
  FROM unit_root JOIN portmanteau USING (variable)
)"""


@query(
    "stationarity_summary",
    f"""
    WITH RECURSIVE {SUMMARY}
    SELECT 'lineitem' AS series_id, variable, round(tau, 6) AS adf_statistic, round(p_value, 6) AS adf_pvalue,
      is_stationary, CAST(p AS BIGINT) AS n_lags_used, round(lb, 6) AS ljungbox_pvalue, correlated AS has_autocorrelation,
      CASE is_stationary WHEN 1 THEN '{texts.STATIONARY_YES}' ELSE '{texts.STATIONARY_NO}' END
        || CASE correlated WHEN 1 THEN '{texts.AUTOCORRELATED_YES}' ELSE '{texts.AUTOCORRELATED_NO}' END AS interpretation
    FROM summary
    """,
)
def stationarity_summary(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    tested = stationarity.stationarity(panel, layout=layout).drop("adf_critical_values")
    return tested.withColumns({c: F.round(c, 6) for c in ("adf_statistic", "adf_pvalue", "ljungbox_pvalue")})


@query(
    "stationarity_counts",
    f"""
    WITH RECURSIVE {SUMMARY}
    SELECT 'lineitem' AS series_id, CAST(sum(is_stationary) AS BIGINT) AS n_stationary,
      CAST(sum(1 - is_stationary) AS BIGINT) AS n_nonstationary, count(*) AS n_variables FROM summary
    """,
)
def stationarity_counts(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    return stationarity.stationarity_counts(stationarity.stationarity(panel, layout=layout))


@query("stl_components")
def stl_components(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    periods = materialize(season.estimate_period(panel, 200, layout))
    rows, _ = decompose.stl(panel, periods, layout=layout)
    return rows


@query("stl_strength")
def stl_strength(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    periods = materialize(season.estimate_period(panel, 200, layout))
    rows, _ = decompose.stl(panel, periods, layout=layout)
    return decompose.stl_strength(rows)


_SPLIT = """
parts AS (
  SELECT variable, ts, value AS observed, trend, value - trend AS detrended,
         avg(value - trend) OVER (PARTITION BY variable, pos % 7) AS seasonal
  FROM (SELECT *, avg(value) OVER (PARTITION BY variable ORDER BY pos
               ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM daily)
)"""


@query(
    "component_strength",
    f"""
    WITH {DAILY}, {_SPLIT}, v AS (
      SELECT variable, var_pop(observed - trend - seasonal) AS r,
        var_pop(observed - trend + (observed - trend - seasonal)) AS t,
        var_pop(observed - seasonal + (observed - trend - seasonal)) AS s
      FROM parts GROUP BY 1)
    SELECT variable,
      CASE WHEN t > 1e-12 THEN round(least(greatest(1 - r / t, 0), 1), 6) ELSE 0 END
        AS trend_strength,
      CASE WHEN s > 1e-12 THEN round(least(greatest(1 - r / s, 0), 1), 6) ELSE 0 END
        AS seasonal_strength
    FROM v
    """,
)
def component_strength(spark: SparkSession, folder: str) -> DataFrame:
    """The strength formulas on a split that SQL can also make: weekly mean and weekday effect."""
    panel, layout = daily_panel(spark, folder)
    blocks = halo_blocks(panel, layout, before=3, after=3)
    trended = blocks.withColumn("trend", centred_mean(F.col("value"), 7)).where("core")
    effects = trended.groupBy("series_id", "variable", (F.col("pos") % 7).alias("phase")).agg(
        F.avg(F.col("value") - F.col("trend")).alias("seasonal")
    )
    split = trended.withColumn("phase", F.col("pos") % 7).join(
        effects, ["series_id", "variable", "phase"]
    )
    parts = split.withColumnRenamed("value", "observed").withColumn(
        "resid", F.col("observed") - F.col("trend") - F.col("seasonal")
    )
    result = season.component_strength(parts)
    names = ["trend_strength", "seasonal_strength"]
    return result.select("variable", *[F.round(c, 6).alias(c) for c in names])
