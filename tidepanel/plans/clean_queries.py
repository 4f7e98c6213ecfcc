"""Queries over building, profiling and cleaning panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators import clean, quality, windows
from tidepanel.operators.layout import Layout, with_position
from tidepanel.plans.panels import (
    DAILY,
    DAILY_RAW,
    HOURLY,
    MIXED,
    ORDERS,
    daily_panel,
    daily_raw,
    hourly_frame,
    hourly_panel,
    orders_panel,
    regular_mixed_panel,
)
from tidepanel.plans.registry import query, table
from tidepanel.session import materialize


@query(
    "panel_build",
    f"WITH {HOURLY} SELECT variable, ts, round(value, 6) AS value FROM hourly",
)
def panel_build(spark: SparkSession, folder: str) -> DataFrame:
    panel = hourly_panel(spark, folder)
    return panel.select("variable", "ts", F.round("value", 6).alias("value"))


@query(
    "dedup_mean",
    """
    SELECT o_orderpriority AS variable, o_orderdate AS ts, round(avg(o_totalprice), 4) AS value,
           max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS y
    FROM orders GROUP BY 1, 2
    """,
)
def dedup_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("variable"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("y"),
    )
    values = clean.merge_repeated(rows.withColumn("series_id", F.col("variable")))
    labels = clean.merge_labels(rows.withColumn("series_id", F.col("variable")))
    return values.join(labels, ["series_id", "ts"]).select(
        "variable", "ts", F.round("value", 4).alias("value"), "y"
    )


@query(
    "quality_summary",
    f"""
    WITH {HOURLY}, spans AS (
      SELECT count(DISTINCT ts) AS n_rows, count(DISTINCT variable) AS n_cols,
             min(ts) AS start_ts, max(ts) AS end_ts,
             sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS n_missing
      FROM hourly)
    SELECT n_rows, n_cols, start_ts, end_ts, CAST(n_missing AS BIGINT) AS n_missing,
           CAST(0 AS BIGINT) AS n_duplicated_ts,
           round(n_missing / (n_rows * n_cols), 8) AS missing_ratio,
           CAST(epoch(end_ts) - epoch(start_ts) AS BIGINT) AS duration_seconds,
           CAST(floor((epoch(end_ts) - epoch(start_ts)) / 86400) AS BIGINT) || '일'
             AS duration_text
    FROM spans
    """,
)
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    frame, names = hourly_frame(spark, folder)
    return quality.quality_summary(frame, names).withColumn(
        "missing_ratio", F.round("missing_ratio", 8)
    )


@query(
    "quality_duplicates",
    """
    SELECT o_orderpriority AS variable, count(*) AS n_rows,
           count(*) - count(DISTINCT o_orderdate) AS n_duplicated_ts,
           min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts,
           printf('약 %.1f년 (%s일)',
             floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) / 365,
             format('{:,}', CAST(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400)
                    AS BIGINT))) AS duration_text
    FROM orders GROUP BY 1
    """,
)
def quality_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "variable")
    report = quality.quality_summary(orders, ["o_totalprice"], "o_orderdate", by=["variable"])
    return report.select(
        "variable", "n_rows", "n_duplicated_ts", "start_ts", "end_ts", "duration_text"
    )


@query(
    "quality_columns",
    f"""
    WITH {HOURLY}
    SELECT variable, count(*) - count(value) AS n_missing,
           CASE WHEN count(DISTINCT value) <= 1 THEN 1 ELSE 0 END AS is_constant
    FROM hourly GROUP BY 1
    """,
)
def quality_columns(spark: SparkSession, folder: str) -> DataFrame:
    frame, names = hourly_frame(spark, folder)
    return quality.quality_columns(frame, names)


@query(
    "describe",
    f"""
    WITH {HOURLY}
    SELECT variable, count(value) AS "count", round(avg(value), 6) AS mean,
           round(stddev_samp(value), 6) AS std, round(min(value), 6) AS "min",
           round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS "max"
    FROM hourly GROUP BY 1
    """,
)
def describe(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(hourly_panel(spark, folder))
    stats = quality.describe(panel)
    rounded = [F.round(c, 6).alias(c) for c in stats.columns if c not in KEYS + ["count"]]
    return stats.select("variable", "count", *rounded)


@query(
    "freq_infer_modal_gap",
    f"""
    WITH {DAILY_RAW}, {ORDERS}, joint AS (
      SELECT DISTINCT 'lineitem/' || variable AS series_id, ts FROM daily_raw
      UNION ALL SELECT DISTINCT 'orders/' || variable, ts FROM orders_panel),
    steps AS (
      SELECT series_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))
        AS gap FROM joint),
    counted AS (SELECT series_id, gap, count(*) AS c FROM steps WHERE gap IS NOT NULL GROUP BY 1, 2),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, gap) AS rk,
             count(*) OVER (PARTITION BY series_id) AS n_gaps FROM counted)
    SELECT series_id, (SELECT count(*) FROM joint b WHERE b.series_id = r.series_id) AS n, n_gaps,
           gap AS modal_gap,
           CASE WHEN gap = 86400000000 THEN 'D'
                WHEN gap % 86400000000 = 0 THEN (gap // 86400000000) || 'D' END AS freq
    FROM ranked r WHERE rk = 1
    """,
)
def freq_infer_modal_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Each variable taken as a series of its own, so that both tables give several axes."""
    rows = daily_raw(spark, folder).unionByName(orders_panel(spark, folder))
    axis = rows.select(F.concat_ws("/", *KEYS).alias("series_id"), "ts").distinct()
    return quality.infer_frequency(materialize(axis))


@query(
    "regular_grid",
    f"""
    WITH {HOURLY}, axis AS (
      SELECT unnest(generate_series((SELECT min(ts) FROM hourly_known),
             (SELECT max(ts) FROM hourly_known), INTERVAL 1 HOUR)) AS ts)
    SELECT v.variable, a.ts, round(k.value, 6) AS value,
           row_number() OVER (PARTITION BY v.variable ORDER BY a.ts) - 1 AS pos
    FROM axis a CROSS JOIN (SELECT DISTINCT variable FROM hourly_known) v
    LEFT JOIN hourly_known k ON k.variable = v.variable AND k.ts = a.ts
    """,
)
def regular_grid(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(hourly_panel(spark, folder))
    gridded = clean.regular_grid(panel, "h")
    return gridded.select("variable", "ts", F.round("value", 6).alias("value"), "pos")


@query(
    "regularise_fill",
    f"WITH {DAILY} SELECT variable, ts, pos, n, round(value, 4) AS value FROM daily",
)
def regularise_fill(spark: SparkSession, folder: str) -> DataFrame:
    panel, _ = daily_panel(spark, folder)
    return panel.select("variable", "ts", "pos", "n", F.round("value", 4).alias("value"))


_AROUND = f"""
WITH {HOURLY}, around AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
    last_value(value IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
    first_value(value IGNORE NULLS) OVER f AS nv
  FROM SOURCE
  WINDOW b AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT variable, ts, round(RULE, 6) AS value FROM around
"""
_LINEAR = (
    "coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv, 0)"
)
_MOVING = """(SELECT variable, ts, pos, coalesce(value, avg(value) OVER (
    PARTITION BY variable ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS value
  FROM hourly)"""


def _filled(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        panel = materialize(hourly_panel(spark, folder))
        layout = Layout.measure(panel)
        filled = clean.fill(with_position(panel, layout), method, layout)
        return filled.select("variable", "ts", F.round("value", 6).alias("value"))

    return run


query("fill_linear", _AROUND.replace("SOURCE", "hourly").replace("RULE", _LINEAR))(
    _filled("interpolate_linear")
)
query("fill_ffill", _AROUND.replace("SOURCE", "hourly").replace("RULE", "coalesce(value, pv, nv, 0)"))(
    _filled("ffill")
)
query("fill_bfill", _AROUND.replace("SOURCE", "hourly").replace("RULE", "coalesce(value, nv, pv, 0)"))(
    _filled("bfill")
)
query("fill_moving_average", _AROUND.replace("SOURCE", _MOVING).replace("RULE", _LINEAR))(
    _filled("moving_average")
)


@query(
    "fill_stats",
    f"""
    WITH {HOURLY}
    SELECT variable, count(*) - count(value) AS n_missing_before,
           CAST(0 AS BIGINT) AS n_missing_after,
           CASE WHEN count(*) > count(value) THEN '선형 보간 (Interpolation)'
                ELSE '없음 (결측치 없음)' END AS method
    FROM hourly GROUP BY 1
    """,
)
def fill_stats(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(hourly_panel(spark, folder))
    layout = Layout.measure(panel)
    filled = clean.fill(with_position(panel, layout), layout=layout)
    stats = clean.impute_stats(panel, filled, "interpolate_linear")
    return stats.drop("series_id")


_FLAGGED_SQL = """
WITH cells AS (
  SELECT l_shipdate AS ts, avg(l_quantity) AS quantity,
         avg(CASE WHEN l_linenumber > 0 THEN 1.0 END) AS always_one,
         avg(CASE WHEN l_linenumber < 0 THEN l_tax END) AS never
  FROM lineitem GROUP BY 1)
"""


def _flagged_frame(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Daily frame with one constant variable and one without any value."""
    lines = table(spark, folder, "lineitem")
    frame = lines.groupBy(F.col("l_shipdate").alias("ts")).agg(
        F.avg("l_quantity").alias("quantity"),
        F.avg(F.when(F.col("l_linenumber") > 0, F.lit(1.0))).alias("always_one"),
        F.avg(F.when(F.col("l_linenumber") < 0, F.col("l_tax"))).alias("never"),
    )
    return frame, ["quantity", "always_one", "never"]


@query(
    "drop_constant",
    _FLAGGED_SQL + "SELECT 'quantity' AS variable, ts, round(quantity, 6) AS value FROM cells",
)
def drop_constant(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.model import frame_to_panel

    frame, names = _flagged_frame(spark, folder)
    panel = materialize(frame_to_panel(frame, names))
    kept = clean.drop_constant(panel)
    return kept.select("variable", "ts", F.round("value", 6).alias("value"))


@query(
    "fill_zero",
    _FLAGGED_SQL + "SELECT 'never' AS variable, ts, CAST(0 AS DOUBLE) AS value FROM cells",
)
def fill_zero(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.model import frame_to_panel

    frame, _ = _flagged_frame(spark, folder)
    panel = materialize(frame_to_panel(frame, ["never"]))
    layout = Layout.measure(panel)
    return clean.fill(with_position(panel, layout), layout=layout).select("variable", "ts", "value")


@query(
    "rolling_features",
    f"""
    WITH {DAILY}
    SELECT variable, ts, round(value, 6) AS value,
      round(value - avg(value) OVER w, 6) AS dev_from_rolling_mean,
      round(coalesce(stddev_samp(value) OVER w, 0), 6) AS rolling_std,
      round(coalesce(value - lag(value) OVER (PARTITION BY variable ORDER BY pos), 0), 6) AS diff
    FROM daily
    WINDOW w AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)
    """,
)
def rolling_features(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    features = windows.rolling_features(panel, layout)
    names = ["value", "dev_from_rolling_mean", "rolling_std", "diff"]
    return features.select("variable", "ts", *[F.round(c, 6).alias(c) for c in names])


@query(
    "lag_matrix",
    f"""
    WITH {DAILY}, lagged AS (
      SELECT variable, ts, pos, round(value, 4) AS value,
        round(lag(value, 1) OVER w, 4) AS lag1, round(lag(value, 2) OVER w, 4) AS lag2,
        round(lag(value, 7) OVER w, 4) AS lag7, round(lag(value, 14) OVER w, 4) AS lag14
      FROM daily WINDOW w AS (PARTITION BY variable ORDER BY pos))
    SELECT variable, ts, value, lag1, lag2, lag7, lag14 FROM lagged WHERE pos >= 14
    """,
)
def lag_matrix(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    rows = windows.lag_matrix(panel, layout, 14)
    picks = [F.round(F.col("lags")[i - 1], 4).alias(f"lag{i}") for i in (1, 2, 7, 14)]
    return rows.select("variable", "ts", F.round("value", 4).alias("value"), *picks)


@query(
    "recent_mean",
    f"""
    WITH {DAILY}
    SELECT variable, ts, round(avg(value) OVER (PARTITION BY variable ORDER BY pos
             ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS recent_mean FROM daily
    """,
)
def recent_mean(spark: SparkSession, folder: str) -> DataFrame:
    panel, layout = daily_panel(spark, folder)
    rows = windows.recent_mean(panel, layout)
    return rows.select("variable", "ts", F.round("recent_mean", 6).alias("recent_mean"))


@query(
    "regularise_many",
    f"WITH {MIXED} SELECT series_id, ts, pos, n, round(value, 8) AS value FROM regular",
)
def regularise_many(spark: SparkSession, folder: str) -> DataFrame:
    regular, _ = regular_mixed_panel(spark, folder)
    return regular.select("series_id", "ts", "pos", "n", F.round("value", 8).alias("value"))


@query(
    "complete_panel",
    """
    WITH known AS (
      SELECT user_id, event_type, date_trunc('day', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2, 3)
    SELECT CAST(i.user_id AS VARCHAR) AS series_id, v.event_type AS variable, i.ts, round(k.value, 6) AS value
    FROM (SELECT DISTINCT user_id, ts FROM known) i
    JOIN (SELECT DISTINCT user_id, event_type FROM known) v USING (user_id)
    LEFT JOIN known k ON k.user_id = i.user_id AND k.event_type = v.event_type AND k.ts = i.ts
    """,
)
def complete_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's own event types on all days of the user."""
    known = materialize(
        table(spark, folder, "events")
        .groupBy(
            F.col("user_id").cast("string").alias("series_id"),
            F.col("event_type").alias("variable"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
        )
        .agg(F.avg("value").alias("value"))
    )
    whole = clean.complete(known, Layout.measure(known))
    return whole.withColumn("value", F.round("value", 6))
