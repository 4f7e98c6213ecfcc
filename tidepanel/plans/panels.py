"""The panels the queries run on, and the same panels as SQL for the comparison.

* hourly: ``events``, one variable per event type, mean value per hour. Has natural gaps.
* daily: ``lineitem``, one variable per return flag, revenue per ship date, put on a daily grid.
* user: ``events``, one series per user, mean value per day.
* orders: ``orders``, one variable per priority, total price per order date.
* mixed: series of many frequencies out of ``events`` and ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.model import PANEL_COLUMNS, frame_to_panel
from tidepanel.operators.clean import regularise, regularise_many
from tidepanel.operators.layout import Layout, with_position
from tidepanel.operators.quality import infer_frequency
from tidepanel.plans.registry import table
from tidepanel.session import materialize


def _ids(frame: DataFrame, column: str) -> list[str]:
    """Names of the variables of a frame, as a frame's header would give them."""
    return [r[0] for r in frame.select(column).distinct().orderBy(column).collect()]


def hourly_frame(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    hours = events.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    names = _ids(hours, "event_type")
    return hours.groupBy("ts").pivot("event_type", names).agg(F.avg("value")), names


def hourly_panel(spark: SparkSession, folder: str) -> DataFrame:
    frame, names = hourly_frame(spark, folder)
    return frame_to_panel(frame, names, series_id="events")


def user_panel(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    """One series per user: the mean value of the user's events per day, gap-free and positioned."""
    events = table(spark, folder, "events")
    raw = materialize(
        events.groupBy(
            F.col("user_id").cast("string").alias("series_id"),
            F.lit("value").alias("variable"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
        )
        .agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100 / F.count(F.lit(1))).alias("value"))
        .select(*PANEL_COLUMNS)
    )
    layout = Layout.measure(raw)
    clean = materialize(regularise(raw, "D", layout))
    return clean, Layout.measure(clean)


#: The same, with the user in place of the variable.
USERS = """
user_days AS (
  SELECT CAST(user_id AS VARCHAR) AS variable, date_trunc('day', ts) AS ts,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS value FROM events GROUP BY 1, 2
),
user_grid AS (
  SELECT a.variable, a.ts, k.value, row_number() OVER (PARTITION BY a.variable ORDER BY a.ts) - 1 AS pos,
    count(*) OVER (PARTITION BY a.variable) AS n
  FROM (SELECT variable, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM user_days GROUP BY 1) a
  LEFT JOIN user_days k ON k.variable = a.variable AND k.ts = a.ts
),
user_around AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
    last_value(value IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
    first_value(value IGNORE NULLS) OVER f AS nv
  FROM user_grid
  WINDOW b AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
daily AS (
  SELECT variable, ts, pos, n,
    coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv, 0.0) AS value
  FROM user_around
)"""


HOURLY = """
hourly_known AS (
  SELECT event_type AS variable, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY 1, 2
),
hourly AS (
  SELECT v.variable, a.ts, k.value,
         row_number() OVER (PARTITION BY v.variable ORDER BY a.ts) - 1 AS pos,
         count(*) OVER (PARTITION BY v.variable) AS n
  FROM (SELECT DISTINCT ts FROM hourly_known) a
  CROSS JOIN (SELECT DISTINCT variable FROM hourly_known) v
  LEFT JOIN hourly_known k ON k.variable = v.variable AND k.ts = a.ts
)"""


def daily_raw(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    # money has four decimals here: summed as whole numbers it is exact in any order
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    units = F.round(revenue * 10000).cast("bigint")
    return (
        lines.groupBy(F.col("l_returnflag").alias("variable"), F.col("l_shipdate").alias("ts"))
        .agg((F.sum(units) / 10000).alias("value"))
        .withColumn("series_id", F.lit("lineitem"))
        .select(*PANEL_COLUMNS)
    )


def daily_panel(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    """Gap-free positioned panel, written once; every consumer starts from the written table."""
    raw = materialize(daily_raw(spark, folder))
    layout = Layout.measure(raw)
    clean = materialize(regularise(raw, "D", layout))
    return clean, Layout.measure(clean)


DAILY_RAW = """
daily_raw AS (
  SELECT l_returnflag AS variable, l_shipdate AS ts,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2
)"""

DAILY = DAILY_RAW + """,
daily_axis AS (
  SELECT unnest(generate_series((SELECT min(ts) FROM daily_raw), (SELECT max(ts) FROM daily_raw),
                                INTERVAL 1 DAY)) AS ts
),
daily_grid AS (
  SELECT v.variable, a.ts, r.value,
         row_number() OVER (PARTITION BY v.variable ORDER BY a.ts) - 1 AS pos,
         count(*) OVER (PARTITION BY v.variable) AS n
  FROM daily_axis a CROSS JOIN (SELECT DISTINCT variable FROM daily_raw) v
  LEFT JOIN daily_raw r ON r.variable = v.variable AND r.ts = a.ts
),
daily_around AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
    last_value(value IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
    first_value(value IGNORE NULLS) OVER f AS nv
  FROM daily_grid
  WINDOW b AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
daily AS (
  SELECT variable, ts, pos, n,
    coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv, 0.0)
      AS value
  FROM daily_around
)"""


def orders_panel(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.lit("orders").alias("series_id"),
        F.col("o_orderpriority").alias("variable"),
        F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    return (
        orders.groupBy("series_id", "variable", "ts")
        .agg((F.sum("cents") / 100).alias("value"))
        .select(*PANEL_COLUMNS)
    )


ORDERS = """
orders_panel AS (
  SELECT o_orderpriority AS variable, o_orderdate AS ts,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2
)"""


def mixed_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Series of many frequencies: each user's events by the hour, orders by month, priorities by quarter."""
    events, orders = table(spark, folder, "events"), table(spark, folder, "orders")

    def series(rows: DataFrame, name: Column, unit: str, time: str, value: str) -> DataFrame:
        return (
            rows.groupBy(
                name.alias("series_id"),
                F.lit("value").alias("variable"),
                F.date_trunc(unit, time).cast("timestamp_ntz").alias("ts"),
            )
            # two decimals: summed as whole numbers they are exact in any order
            .agg((F.sum(F.round(F.col(value) * 100).cast("bigint")) / 100 / F.count(F.lit(1))).alias("value"))
            .select(*PANEL_COLUMNS)
        )

    users = series(events, F.concat(F.lit("user "), "user_id"), "hour", "ts", "value")
    months = series(orders, F.lit("orders"), "month", "o_orderdate", "o_totalprice")
    quarters = series(orders, F.col("o_orderpriority"), "quarter", "o_orderdate", "o_totalprice")
    return users.unionByName(months).unionByName(quarters)


#: ``mixed``: the panel; ``regular``: its uneven series on grids of their commonest gap or their months.
MIXED = """
mixed AS (
  SELECT 'user ' || user_id AS series_id, date_trunc('hour', ts) AS ts,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS value FROM events GROUP BY 1, 2
  UNION ALL
  SELECT 'orders', date_trunc('month', o_orderdate),
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) FROM orders GROUP BY 1, 2
  UNION ALL
  SELECT o_orderpriority, date_trunc('quarter', o_orderdate),
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) FROM orders GROUP BY 1, 2
),
mixed_gaps AS (
  SELECT series_id, g, count(*) AS c FROM (
    SELECT series_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS g FROM mixed)
  WHERE g IS NOT NULL GROUP BY 1, 2
),
mixed_steps AS (
  SELECT series_id, arg_min(g, {'c': -c, 'g': g}) AS step, count(*) AS gaps, sum(c) + 1 AS n FROM mixed_gaps GROUP BY 1
),
mixed_axis AS (
  SELECT s.series_id, unnest(CASE WHEN s.gaps = 1 OR s.n < 3 THEN list_sort(m.all_ts)
    WHEN s.series_id LIKE 'user %' THEN list_transform(range((epoch_us(hi) - epoch_us(lo)) // s.step + 1),
      lambda i: make_timestamp(epoch_us(lo) + i * s.step))
    WHEN s.series_id = 'orders' THEN generate_series(lo, hi, INTERVAL 1 MONTH)
    ELSE generate_series(lo, hi, INTERVAL 3 MONTH) END) AS ts
  FROM mixed_steps s JOIN (
    SELECT series_id, min(ts) AS lo, max(ts) AS hi, list(ts) AS all_ts FROM mixed GROUP BY 1) m USING (series_id)
),
mixed_grid AS (
  SELECT a.series_id, a.ts, m.value, row_number() OVER (PARTITION BY a.series_id ORDER BY a.ts) - 1 AS pos,
    count(*) OVER (PARTITION BY a.series_id) AS n
  FROM mixed_axis a LEFT JOIN mixed m ON m.series_id = a.series_id AND m.ts = a.ts
),
regular AS (
  SELECT series_id, ts, pos, n,
    coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv, 0.0) AS value
  FROM (
    SELECT *,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
      last_value(value IGNORE NULLS) OVER b AS pv,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
      first_value(value IGNORE NULLS) OVER f AS nv
    FROM mixed_grid
    WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
)"""


def regular_mixed_panel(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    panel = materialize(mixed_panel(spark, folder))
    layout = Layout.measure(panel)
    frequency = materialize(infer_frequency(panel.select("series_id", "ts"), layout))
    regular = materialize(regularise_many(with_position(panel, layout), frequency, layout))
    return regular, Layout.measure(regular)
