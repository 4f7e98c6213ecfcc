"""Frequency codes: their names, their steps and the seasonal period they suggest."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: frequency code -> points per season ---------------------------------------
DEFAULT_PERIOD = {
    "D": 7, "B": 5, "h": 24, "H": 24, "min": 60, "T": 60, "s": 60, "S": 60,
    "W": 52, "M": 12, "ME": 12, "MS": 12, "Q": 4, "QS": 4,
}

# --- fixed values: code -> microseconds of one unit ------------------------------------------
UNIT_MICROS = {
    "W": 7 * 86_400_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000,
    "s": 1_000_000, "ms": 1_000, "us": 1,
}

_OLD_NAMES = {"H": "h", "T": "min", "S": "s"}

WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def counted(code: Column, count: Column) -> Column:
    """``D`` or ``3D``."""
    return F.when(count == 1, code).otherwise(F.concat(count.cast("string"), code))


def fixed_gap_code(gap: Column) -> Column:
    """Name of a gap in microseconds, in the largest unit up to a day that divides it."""
    named = F.lit(None).cast("string")
    for code in ["us", "ms", "s", "min", "h", "D"]:
        unit = UNIT_MICROS[code]
        count = F.floor(gap / unit).cast("long")
        named = F.when(gap % unit == 0, counted(F.lit(code), count)).otherwise(named)
    return named


def strip_digits(code: Column) -> Column:
    return F.regexp_replace(code, "[0-9]", "")


def default_period(code: Column, n: Column) -> Column:
    """Points per season for a code and a length; NULL where two seasons do not fit."""
    base = strip_digits(code)
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_PERIOD.items() for x in pair])
    named = F.element_at(known, base)
    tenth = F.greatest(F.lit(2), F.floor(n / 10))
    fallback = F.least(tenth, F.greatest(F.lit(2), F.floor(n / 2) - 1))
    period = F.when(F.coalesce(named, F.lit(0)) > 0, named.cast("long")).otherwise(
        fallback.cast("long")
    )
    return F.when(n >= period * 2, period)


def parse_code(code: str) -> tuple[int, str]:
    match = re.fullmatch(r"(\d*)([A-Za-z]+(?:-[A-Z]+)?)", code)
    if match is None:
        raise ValueError(f"unknown frequency code: {code!r}")
    return int(match.group(1) or 1), match.group(2)


def step_micros(code: str) -> int | None:
    """Length of the step of a fixed frequency; None for calendar frequencies."""
    count, unit = parse_code(code)
    unit = unit.split("-")[0]
    unit = _OLD_NAMES.get(unit, unit)
    return count * UNIT_MICROS[unit] if unit in UNIT_MICROS else None


def _count_of(code: Column) -> Column:
    digits = F.regexp_extract(code, "^([0-9]*)", 1)
    return F.when(digits == "", F.lit(1)).otherwise(F.try_to_number(digits, F.lit("999999999"))).cast("bigint")


def _unit_of(code: Column) -> Column:
    return F.regexp_extract(code, "^[0-9]*([A-Za-z]+)", 1)


def step_micros_of(code: Column) -> Column:
    """As :func:`step_micros`, for a column of codes."""
    known = UNIT_MICROS | {old: UNIT_MICROS[new] for old, new in _OLD_NAMES.items()}
    micros = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return _count_of(code) * F.try_element_at(micros, _unit_of(code)).cast("bigint")


def calendar_instants(code: Column, lo: Column, hi: Column) -> Column:
    """Array of the instants of a calendar frequency from ``lo`` to ``hi`` (TIMESTAMP_NTZ).

    Days of a business-day code, else the first or last (business) day of every so many months; the
    time of day is that of ``lo``. A century has 36,525 days, so the array is short.
    """
    unit = _unit_of(code)
    business = unit.startswith("B") & (F.length(unit) > 1)
    kind = F.when(business, F.substring(unit, 2, 9)).otherwise(unit)
    letter = F.substring(kind, 1, 1)
    months = F.when(letter == "M", 1).when(letter == "Q", 3).when(letter == "Y", 12)
    step = (months * _count_of(code)).cast("int")
    first_day, last_day = F.to_date(lo), F.to_date(hi)
    first_month = F.trunc(first_day, "MM")
    times = F.floor(F.months_between(last_day, first_month) / step).cast("int") + 1

    def anchored(i: Column) -> Column:
        start = F.add_months(first_month, i * step)
        end = F.last_day(start)
        end = F.when(business, F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))).otherwise(end)
        ahead = F.when(business & (F.weekday(start) > 4), 7 - F.weekday(start)).otherwise(0)
        return F.when(kind.endswith("S"), F.date_add(start, ahead)).otherwise(end)

    workdays = F.filter(F.sequence(first_day, last_day), lambda d: F.weekday(d) < 5)
    days = (
        F.when(unit == "B", workdays)
        .when(step.isNotNull(), F.transform(F.sequence(F.lit(0), times), anchored))
        .otherwise(F.raise_error(F.concat(F.lit("unknown frequency code: "), code)).cast("array<date>"))
    )
    time_of_day = lo.cast("timestamp_ntz") - F.date_trunc("day", lo).cast("timestamp_ntz")
    instants = F.transform(days, lambda d: d.cast("timestamp_ntz") + time_of_day)
    return F.filter(instants, lambda t: (t >= lo) & (t <= hi))
