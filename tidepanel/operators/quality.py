"""Data quality: counts, gaps, frequency, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.frequency import MONTHS, WEEKDAYS, counted, fixed_gap_code
from tidepanel.functions.scalar import duration_text
from tidepanel.model import KEYS, clean_double, micros
from tidepanel.operators.layout import Layout, exact_quantiles
from tidepanel.operators.windows import gaps

DAY = 86_400_000_000


def _missing(column: str) -> Column:
    return F.count_if(clean_double(F.col(f"`{column}`")).isNull()).cast("long")


def quality_summary(
    frame: DataFrame, features: list[str], ts: str = "ts", by: list[str] | None = None
) -> DataFrame:
    """Rows, columns, time span, missing cells and repeated instants of a raw frame.

    Repeated instants are counted on the raw rows, before any are merged.
    """
    keys = by or []
    instant = F.col(f"`{ts}`")
    per_instant = frame.groupBy(*keys, instant.alias("__t")).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[_missing(c).alias(f"__m{i}") for i, c in enumerate(features)],
    )
    every = [F.sum(f"__m{i}") for i in range(len(features))]
    missing = every[0]
    for other in every[1:]:
        missing = missing + other
    counted_rows = per_instant.groupBy(*keys).agg(
        F.sum("__rows").cast("long").alias("n_rows"),
        F.lit(len(features)).cast("long").alias("n_cols"),
        F.min("__t").alias("start_ts"),
        F.max("__t").alias("end_ts"),
        missing.cast("long").alias("n_missing"),
        (F.sum("__rows") - F.count("__t")).cast("long").alias("n_duplicated_ts"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts")).cast("long")
    cells = F.col("n_rows") * F.col("n_cols")
    return (
        counted_rows.withColumn(
            "missing_ratio",
            F.when(cells > 0, F.col("n_missing") / cells).otherwise(F.lit(0.0)),
        )
        .withColumn("duration_seconds", seconds)
        .withColumn("duration_text", duration_text(seconds))
    )


def panel_overview(panel: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Per series of a completed panel: rows, columns, span, missing cells and, if given, the frequency.

    Made of one row per variable, so a long series is summed up before it is put together.
    """
    per_variable = panel.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.min("ts").alias("__from"),
        F.max("ts").alias("__to"),
        F.count_if(clean_double(F.col("value")).isNull()).alias("__missing"),
    )
    summed = per_variable.groupBy("series_id").agg(
        F.max("__rows").cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_cols"),
        F.min("__from").alias("start_ts"),
        F.max("__to").alias("end_ts"),
        F.sum("__missing").cast("long").alias("n_missing"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts")).cast("long")
    told = summed.select(
        "*",
        (F.col("n_missing") / (F.col("n_rows") * F.col("n_cols"))).alias("missing_ratio"),
        seconds.alias("duration_seconds"),
        duration_text(seconds).alias("duration_text"),
    )
    if frequency is None:
        return told
    return told.join(frequency.select("series_id", "freq"), "series_id", "left")


def quality_columns(frame: DataFrame, features: list[str]) -> DataFrame:
    """Missing cells per variable, and whether the variable is constant. One pass, one row each."""
    stats: list[Column] = []
    for i, name in enumerate(features):
        value = clean_double(F.col(f"`{name}`"))
        stats += [
            _missing(name).alias(f"m{i}"),
            F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias(f"c{i}"),
        ]
    row = frame.agg(*stats)
    entries = [
        F.struct(
            F.lit(name).alias("variable"),
            F.col(f"m{i}").alias("n_missing"),
            F.col(f"c{i}").cast("int").alias("is_constant"),
        )
        for i, name in enumerate(features)
    ]
    return row.select(F.inline(F.array(*entries)))


def describe(panel: DataFrame, layout: Layout | None = None, keys: list[str] = KEYS) -> DataFrame:
    """count, mean, std, min, quartiles and max of the known values of each group."""
    layout = Layout.of(panel, layout, keys)
    moments = panel.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(panel, "value", [0.25, 0.5, 0.75], layout, keys)
    return moments.join(quartiles, keys, "left").select(
        *keys,
        "count",
        "mean",
        "std",
        "min",
        F.col("quantiles")[0].alias("p25"),
        F.col("quantiles")[1].alias("p50"),
        F.col("quantiles")[2].alias("p75"),
        "max",
    )


def infer_frequency(
    axis: DataFrame, layout: Layout | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Frequency code of each series: exact where regular, else the commonest gap.

    ``axis`` has the distinct instants ``ts`` of each series. Adds ``n``, ``modal_gap`` and
    ``n_gaps`` (number of different gaps); ``freq`` is NULL below three instants.
    """
    keys = keys or ["series_id"]
    layout = Layout.of(axis, layout, keys)
    steps = gaps(axis.select(*keys, "ts"), layout, keys)
    weekday = F.weekday("ts")
    month_no = F.year("ts") * 12 + F.month("ts")
    previous_month_no = F.year("prev_ts") * 12 + F.month("prev_ts")
    day_of_month = F.dayofmonth("ts")
    last_day = F.last_day("ts")
    last_weekday = F.weekday(last_day)
    last_business = F.dayofmonth(last_day) - F.greatest(last_weekday - 4, F.lit(0))
    is_start = day_of_month == 1
    is_business_start = (is_start & (weekday < 5)) | (
        (weekday == 0) & day_of_month.between(1, 3)
    )
    is_end = F.to_date("ts") == last_day
    is_business_end = day_of_month == last_business
    business_step = ((weekday == 0) & (F.col("gap") == 3 * DAY)) | (
        weekday.between(1, 4) & (F.col("gap") == DAY)
    )
    per_gap = steps.groupBy(*keys, "gap").agg(
        F.count(F.lit(1)).alias("c"),
        F.min(F.when(F.col("gap").isNotNull(), month_no - previous_month_no)).alias("mlo"),
        F.max(F.when(F.col("gap").isNotNull(), month_no - previous_month_no)).alias("mhi"),
        F.min(F.month("ts")).alias("month_lo"),
        F.max(F.month("ts")).alias("month_hi"),
        F.min("ts").alias("first_ts"),
        F.bool_and(is_start).alias("cs"),
        F.bool_and(is_business_start).alias("bs"),
        F.bool_and(is_end).alias("ce"),
        F.bool_and(is_business_end).alias("be"),
        F.bool_and(F.col("gap").isNull() | business_step).alias("business"),
    )
    known = F.col("gap").isNotNull()
    per_series = per_gap.groupBy(*keys).agg(
        F.sum("c").cast("long").alias("n"),
        F.count("gap").cast("long").alias("n_gaps"),
        F.min("gap").alias("gap_lo"),
        F.min(F.when(known, F.struct((-F.col("c")).alias("c"), F.col("gap").alias("gap")))).alias(
            "modal"
        ),
        F.min("mlo").alias("mlo"),
        F.max("mhi").alias("mhi"),
        F.min("month_lo").alias("month_lo"),
        F.max("month_hi").alias("month_hi"),
        F.min("first_ts").alias("first_ts"),
        *[F.bool_and(c).alias(c) for c in ["cs", "bs", "ce", "be", "business"]],
    )
    suffix = (
        F.when(F.col("cs"), "S").when(F.col("bs"), "bS").when(F.col("ce"), "E").when(F.col("be"), "bE")
    )
    business_prefix = F.when(suffix.startswith("b"), "B").otherwise("")
    end = F.substring(suffix, -1, 1)
    month_names = F.array(*[F.lit(m) for m in MONTHS])
    first_month = F.month("first_ts")
    quarter_month = F.element_at(F.array(F.lit(12), F.lit(10), F.lit(11)), first_month % 3 + 1)
    even_months = F.col("mlo") == F.col("mhi")
    yearly = even_months & (F.col("mlo") % 12 == 0) & (F.col("month_lo") == F.col("month_hi"))
    quarterly = even_months & (F.col("mlo") % 3 == 0)
    week = F.concat(
        F.lit("W-"), F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday("first_ts") + 1)
    )
    single = F.col("n_gaps") == 1
    whole_days = F.col("gap_lo") % DAY == 0
    calendar = whole_days & suffix.isNotNull() & (F.col("mlo") >= 1)
    exact = (
        F.when(
            calendar & yearly,
            counted(
                F.concat(business_prefix, F.lit("Y"), end, F.lit("-"),
                         F.element_at(month_names, first_month)),
                (F.col("mlo") / 12).cast("long"),
            ),
        )
        .when(
            calendar & quarterly,
            counted(
                F.concat(business_prefix, F.lit("Q"), end, F.lit("-"),
                         F.element_at(month_names, quarter_month)),
                (F.col("mlo") / 3).cast("long"),
            ),
        )
        .when(
            calendar & even_months,
            counted(F.concat(business_prefix, F.lit("M"), end), F.col("mlo").cast("long")),
        )
        .when(
            single & (F.col("gap_lo") % (7 * DAY) == 0),
            counted(week, (F.col("gap_lo") / (7 * DAY)).cast("long")),
        )
        .when(single, fixed_gap_code(F.col("gap_lo")))
        .when(whole_days & F.col("business"), F.lit("B"))
    )
    fallback = fixed_gap_code(F.col("modal.gap"))
    return per_series.select(
        *keys,
        "n",
        "n_gaps",
        F.col("modal.gap").alias("modal_gap"),
        F.when(F.col("n") >= 3, F.coalesce(exact, fallback)).alias("freq"),
    )


__all__ = [
    "describe",
    "infer_frequency",
    "micros",
    "quality_columns",
    "quality_summary",
]
