"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions import texts

TINY = 1e-12


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def floored(std: Column) -> Column:
    """A spread that is safe to divide by."""
    return F.when(std > TINY, std).otherwise(F.lit(TINY))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / floored(std)


def percent_change(value: Column, base: Column) -> Column:
    """Change against ``base`` in percent; NULL where the base is practically zero."""
    return F.when(F.abs(base) > 1e-9, (value - base) / F.abs(base) * 100)


def zero_if_undefined(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def wall_time(column: Column) -> Column:
    """Join key without a time zone: the wall-clock time is kept, the zone is dropped."""
    return column.cast("timestamp_ntz")


def duration_text(seconds: Column) -> Column:
    """Years and days from a year on, days from a day on, else hours."""
    days = F.floor(seconds / 86400).cast("long")
    grouped = F.format_number(days, 0)
    return (
        F.when(
            days >= 365,
            F.format_string(texts.DURATION_YEARS, days.cast("double") / 365, grouped),
        )
        .when(days >= 1, F.format_string(texts.DURATION_DAYS, grouped))
        .otherwise(F.format_string(texts.DURATION_HOURS, seconds.cast("double") / 3600))
    )


def signed(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", value)
