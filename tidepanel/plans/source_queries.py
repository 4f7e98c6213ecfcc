"""Queries over reading: row order, axes, positional joins, column roles."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import clean, evaluate
from tidepanel.operators.layout import Layout, with_position
from tidepanel.plans.registry import query, table
from tidepanel.session import shared_folder
from tidepanel.sources import delimited, roles, server_metrics


def _ordered(
    spark: SparkSession, folder: str, name: str, order: str, layout: Layout | None = None
) -> DataFrame:
    """A table without file order, placed by a key."""
    rows = table(spark, folder, name).withColumn("__all", F.lit("all"))
    layout = Layout.of(rows, layout, ["__all"])
    placed = with_position(rows, layout, ["__all"], order)
    return placed.withColumnRenamed("pos", delimited.POSITION).drop("__all", "n")


@query(
    "most_recent_n",
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1000
    """,
)
def most_recent_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ordered(spark, folder, "orders", "o_orderkey")
    return delimited.most_recent(rows, 1000).select("o_orderkey", "o_totalprice")


@query(
    "synthetic_axis",
    """
    SELECT o_orderkey, TIMESTAMP '2000-01-01'
        + to_days(CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER)) AS ts
    FROM orders
    """,
)
def synthetic_axis(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ordered(spark, folder, "orders", "o_orderkey")
    return delimited.synthetic_axis(rows).select("o_orderkey", "ts")


@query(
    "positional_join",
    """
    WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
         b AS (SELECT o_custkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
    SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, TIMESTAMP '2019-01-01' + to_minutes(p) AS ts
    FROM a JOIN b USING (p)
    """,
)
def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two inputs that are numbered each by itself, the second in small blocks."""
    left = _ordered(spark, folder, "orders", "o_orderkey")
    left = left.select("o_orderkey", "o_totalprice", delimited.POSITION)
    blocks = Layout(max_group_rows=1 << 40, block_rows=1 << 10)
    right = _ordered(spark, folder, "orders", "o_orderkey", blocks)
    right = right.select("o_custkey", "o_orderstatus", delimited.POSITION)
    joined = server_metrics.join_by_position(left, right)
    axis = server_metrics.minute_axis(
        server_metrics.MACHINE_START, F.col(delimited.POSITION)
    )
    return joined.select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", axis.alias("ts"))


@query(
    "minute_axis",
    """
    SELECT event_id, TIMESTAMP '2020-01-01' + to_minutes(event_id) AS ts, value
    FROM events ORDER BY event_id LIMIT 5000
    """,
)
def minute_axis(spark: SparkSession, folder: str) -> DataFrame:
    """A minute counter turned into time; the first 5,000 rows, as the feature has it."""
    rows = _ordered(spark, folder, "events", "event_id")
    first = rows.where(F.col(delimited.POSITION) < 5000)
    axis = server_metrics.minute_axis(server_metrics.POOL_START, F.col("event_id"))
    return first.select("event_id", axis.alias("ts"), "value")


def _facts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    facts = roles.profile(rows)
    chosen = roles.choose(facts)
    told = [
        (
            f.name,
            f.rows,
            f.known,
            round(f.parsed_share, 6),
            "time" if f.name == chosen.time_col
            else "label" if f.name == chosen.label_col
            else "feature" if f.name in chosen.features
            else "dropped",
        )
        for f in facts.values()
    ]
    return spark.createDataFrame(
        told, "column string, n_rows bigint, n_known bigint, parsed_share double, role string"
    )


@query(
    "label_detect_profile",
    """
    WITH c AS (
      SELECT count(*) AS n, count(doc_id) AS d, count(quality) AS q, count(toxic) AS t,
        count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1 AS q01,
        count(DISTINCT toxic) = 2 AND min(toxic) = 0 AND max(toxic) = 1 AS t01
      FROM labels)
    SELECT 'doc_id' AS "column", n AS n_rows, d AS n_known, 1.0::DOUBLE AS parsed_share,
           'feature' AS role FROM c
    UNION ALL SELECT 'quality', n, q, 1.0, CASE WHEN q01 THEN 'label' ELSE 'feature' END FROM c
    UNION ALL SELECT 'toxic', n, t, 1.0,
           CASE WHEN t01 AND NOT q01 THEN 'label' ELSE 'feature' END FROM c
    """,
)
def label_detect_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, table(spark, folder, "labels"))


@query(
    "parse_ratio",
    """
    WITH texts AS (
      SELECT CAST(o_orderdate AS VARCHAR) AS order_date, o_orderstatus AS status,
        CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y/%m/%d') END
          AS slashed,
        CAST(o_totalprice AS VARCHAR) AS price FROM orders)
    SELECT 'order_date' AS "column", count(*) AS n_rows, count(order_date) AS n_known,
      1.0::DOUBLE AS parsed_share, 'time' AS role FROM texts
    UNION ALL SELECT 'slashed', count(*), count(slashed),
      round(CAST(sum(CASE WHEN slashed <> 'unknown' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6),
      'dropped' FROM texts
    UNION ALL SELECT 'price', count(*), count(price), 1.0, 'feature' FROM texts
    UNION ALL SELECT 'status', count(*), count(status), 0.0, 'dropped' FROM texts
    """,
)
def parse_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of text only, as a file has them: which of them are times, numbers or neither."""
    orders = table(spark, folder, "orders")
    slashed = F.when(F.col("o_orderkey") % 50 == 0, "unknown").otherwise(
        F.date_format("o_orderdate", "yyyy/MM/dd")
    )
    rows = orders.select(
        F.col("o_orderdate").cast("string").alias("order_date"),
        slashed.alias("slashed"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )
    return _facts(spark, rows)


@query(
    "infer_series_panel",
    """
    SELECT 'value' AS variable, ts, round(avg(value), 6) AS value FROM events GROUP BY 2
    UNION ALL SELECT 'event_id', ts, round(avg(event_id), 6) FROM events GROUP BY 2
    UNION ALL SELECT 'user_id', ts, round(avg(user_id), 6) FROM events GROUP BY 2
    """,
)
def infer_series_panel(spark: SparkSession, folder: str) -> DataFrame:
    """A table of mixed columns straight to a panel: time found, text dropped, the rest unpivoted."""
    found = delimited.infer_series(table(spark, folder, "events"))
    return found.panel.select("variable", "ts", F.round("value", 6).alias("value"))


@query(
    "delimited_roundtrip",
    """
    WITH kept AS (
      SELECT o_orderdate AS ts, CAST(round(o_totalprice) AS BIGINT) AS price, o_custkey AS customer,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y
      FROM orders WHERE o_orderkey % 97 <> 0),
    cells AS (
      SELECT ts, 'price' AS variable, price AS value FROM kept UNION ALL SELECT ts, 'customer', customer FROM kept)
    SELECT c.variable, c.ts, round(c.value, 6) AS value, l.y, f.warnings
    FROM (SELECT variable, ts, avg(value) AS value FROM cells GROUP BY 1, 2) c
    JOIN (SELECT ts, max(y) AS y FROM kept GROUP BY 1) l USING (ts)
    CROSS JOIN (SELECT count(*) || ' rows without a readable time in ''order date'' were removed|'
      || 'columns that are not numeric were left out: remark' AS warnings FROM orders WHERE o_orderkey % 97 = 0) f
    """,
)
def delimited_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text and back: padded names, unreadable dates, quotes and line breaks inside cells."""
    orders = table(spark, folder, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    remark = F.concat(F.lit('first "line"\nand; '), "o_orderpriority", F.lit('\n,"last"'))
    cells = [
        F.when(F.col("o_orderkey") % 97 == 0, "some day").otherwise(date),
        F.round("o_totalprice").cast("bigint").cast("string"),
        F.concat(F.lit('"'), F.replace(remark, F.lit('"'), F.lit('""')), F.lit('"')),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")),
        F.when(F.col("o_orderstatus") == "P", "1").otherwise("0"),
    ]
    path = f"{shared_folder(spark).rstrip('/')}/tidepanel-text-{uuid.uuid4().hex}"
    # every file of a folder has a header of its own
    lines = orders.select(F.concat_ws(",", *cells).alias("line")).mapInArrow(_with_header, "line string")
    lines.write.text(path)
    found = delimited.read_series(spark, path)
    told = found.panel.join(found.labels, ["series_id", "ts"])
    return told.select(
        "variable",
        "ts",
        F.round("value", 6).alias("value"),
        "y",
        F.lit("|".join(found.warnings)).alias("warnings"),
    )


def _with_header(batches):
    header = " order date ,price ,remark, customer, is_anomaly "
    for i, batch in enumerate(batches):
        first = [] if i else [header]
        yield pa.record_batch({"line": pa.array(first + batch.column("line").to_pylist(), pa.string())})


@query(
    "zone_join",
    """
    SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, count(*) AS n,
      max(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS y
    FROM events GROUP BY 1, 2
    """,
)
def zone_join(spark: SparkSession, folder: str) -> DataFrame:
    """Rows stamped with wall time get labels stamped with a zone: the zone is dropped, the time kept."""
    events = table(spark, folder, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    by = [F.col("user_id").cast("string").alias("series_id"), hour.alias("ts")]
    zoned = clean.merge_labels(events.select(*by, (F.col("value") > 90).cast("int").alias("y")))
    rows = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return evaluate.with_labels(rows, zoned)
