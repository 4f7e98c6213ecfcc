"""Shaping of the two server-metric file sets into one frame with time and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.delimited import POSITION, file_rows

MACHINE_START = "TIMESTAMP_NTZ'2019-01-01 00:00:00'"
POOL_START = "TIMESTAMP_NTZ'2020-01-01 00:00:00'"


def minute_axis(base: str, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("bigint"), F.expr(base))


def join_by_position(left: DataFrame, right: DataFrame, position: str = POSITION) -> DataFrame:
    """Rows of two tables that have the same place in their file; both must have equally many."""
    rows = left.count(), right.count()
    if rows[0] != rows[1]:
        raise ValueError(f"tables of {rows[0]:,} and {rows[1]:,} rows cannot be joined by position")
    return left.join(right, position)


def server_machine(spark: SparkSession, values_path: str, labels_path: str) -> DataFrame:
    """Header-less value and label files, put together by row number on a one-minute axis."""
    values = file_rows(spark, values_path, header=False)
    metrics = [c for c in values.columns if c != POSITION]
    labels = file_rows(spark, labels_path, header=False)
    flag = next(c for c in labels.columns if c != POSITION)
    joined = join_by_position(
        values.select(
            POSITION,
            *[F.col(c).cast("double").alias(f"server_metric_{i:02d}") for i, c in enumerate(metrics)],
        ),
        labels.select(POSITION, F.col(flag).cast("int").alias("is_anomaly")),
    )
    return joined.withColumn("timestamp", minute_axis(MACHINE_START, F.col(POSITION))).select(
        "timestamp",
        *[f"server_metric_{i:02d}" for i in range(len(metrics))],
        "is_anomaly",
    )


def server_pool(
    spark: SparkSession, values_path: str, labels_path: str, first_rows: int = 5000
) -> DataFrame:
    """Files with a minute counter; the first rows only, time first and label last."""
    minutes = "timestamp_(min)"
    values = file_rows(spark, values_path)
    labels = file_rows(spark, labels_path).select(
        POSITION, F.col("label").cast("int").alias("is_anomaly")
    )
    metrics = [c for c in values.columns if c not in (POSITION, minutes)]
    joined = join_by_position(values, labels).where(F.col(POSITION) < first_rows)
    return joined.select(
        minute_axis(POOL_START, F.col(f"`{minutes}`")).alias("timestamp"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in metrics],
        "is_anomaly",
    )
