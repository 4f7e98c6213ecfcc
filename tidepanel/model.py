"""Names and schemas shared by all operators.

A *frame* is a wide table: one row per instant, one numeric column per variable. A *panel* is
the same data in long form, so that one table carries any number of frames:

    panel(series_id STRING, variable STRING, ts TIMESTAMP_NTZ, value DOUBLE)

An operator that depends on row order works on a *positioned* panel, which also has
``pos`` (0-based row number inside the group, BIGINT) and ``n`` (rows of the group, BIGINT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["series_id", "variable"]

PANEL_COLUMNS = ["series_id", "variable", "ts", "value"]


def clean_double(column: Column) -> Column:
    """Cast to DOUBLE and turn NaN into NULL, so that one kind of missing value is left."""
    as_double = column.cast("double")
    return F.when(~F.isnan(as_double), as_double)


def frame_to_panel(
    frame: DataFrame,
    features: list[str],
    ts: str = "ts",
    series_id: Column | str = "all",
) -> DataFrame:
    """Wide to long. Narrow: no shuffle, and only the chosen columns are read."""
    series = F.lit(series_id) if isinstance(series_id, str) else series_id
    projected = frame.select(
        series.cast("string").alias("series_id"),
        F.col(f"`{ts}`").alias("ts"),
        *[clean_double(F.col(f"`{c}`")).alias(c) for c in features],
    )
    return projected.unpivot(["series_id", "ts"], features, "variable", "value").select(
        *PANEL_COLUMNS
    )


def panel_to_frame(panel: DataFrame, variables: list[str]) -> DataFrame:
    """Long to wide. The instant is part of the grouping key, so a long series still spreads."""
    return panel.groupBy("series_id", "ts").pivot("variable", variables).agg(F.first("value"))


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch for a TIMESTAMP_NTZ column (read as UTC)."""
    name = F.col(column) if isinstance(column, str) else column
    seconds = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", seconds, name)


def from_micros(column: Column) -> Column:
    return F.timestamp_add("MICROSECOND", column, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
