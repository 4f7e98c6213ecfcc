"""Bounded moving-window columns, computed block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.model import KEYS, micros
from tidepanel.operators.layout import Layout, block_window, halo_blocks, with_position


def centred_frame(width: int) -> tuple[int, int]:
    """Rows around the current one in a centred window; an even width leans to the past."""
    return -(width // 2), width - 1 - width // 2


def centred_mean(value: Column, width: int, keys: list[str] = KEYS) -> Column:
    return F.avg(value).over(block_window(keys).rowsBetween(*centred_frame(width)))


def centred_std(value: Column, width: int, keys: list[str] = KEYS) -> Column:
    spread = F.stddev_samp(value).over(block_window(keys).rowsBetween(*centred_frame(width)))
    return F.coalesce(spread, F.lit(0.0))


def first_difference(value: Column, keys: list[str] = KEYS) -> Column:
    return F.coalesce(value - F.lag(value, 1).over(block_window(keys)), F.lit(0.0))


def lag_columns(value: Column, lags: int, keys: list[str] = KEYS) -> Column:
    """Array of the previous ``lags`` values, the nearest first; NULL before the first row."""
    order = block_window(keys)
    return F.array(*[F.lag(value, i).over(order) for i in range(1, lags + 1)])


def trailing(value: Column, width: int, keys: list[str] = KEYS) -> Column:
    """Array of the last ``width`` values up to and with this row, oldest first."""
    return F.collect_list(value).over(block_window(keys).rowsBetween(-(width - 1), 0))


def rolling_features(positioned: DataFrame, layout: Layout, window: int = 10) -> DataFrame:
    """Value, distance to the centred mean, centred spread and first difference of each row."""
    lead, tail = centred_frame(window)
    blocks = halo_blocks(positioned, layout, before=max(-lead, 1), after=tail)
    value = F.col("value")
    return (
        blocks.select(
            *positioned.columns,
            "block",
            "core",
            (value - centred_mean(value, window)).alias("dev_from_rolling_mean"),
            centred_std(value, window).alias("rolling_std"),
            first_difference(value).alias("diff"),
        )
        .where("core")
        .drop("core")
    )


def recent_mean(positioned: DataFrame, layout: Layout, window: int = 10) -> DataFrame:
    """Mean of the up to ``window`` rows before each row, the row itself left out."""
    blocks = halo_blocks(positioned, layout, before=window)
    return (
        blocks.withColumn(
            "recent_mean", F.avg("value").over(block_window().rowsBetween(-window, -1))
        )
        .where("core")
        .drop("core", "block")
    )


def lag_matrix(positioned: DataFrame, layout: Layout, lags: int) -> DataFrame:
    """Rows with all their ``lags`` previous values."""
    blocks = halo_blocks(positioned, layout, before=lags)
    return (
        blocks.withColumn("lags", lag_columns(F.col("value"), lags))
        .where(F.col("core") & (F.col("pos") >= lags))
        .drop("core", "block")
    )


def gaps(axis: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """Instants with the gap to the one before them, in microseconds."""
    blocks = halo_blocks(with_position(axis, layout, keys), layout, before=1)
    earlier = F.lag("ts", 1).over(block_window(keys))
    return (
        blocks.withColumn("prev_ts", earlier)
        .withColumn("gap", micros("ts") - micros("prev_ts"))
        .where("core")
        .drop("core", "block")
    )
