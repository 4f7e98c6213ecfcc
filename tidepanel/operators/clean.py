"""Cleaning: constant variables, repeated instants, regular grids and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import texts
from tidepanel.functions.frequency import calendar_instants, parse_code, step_micros, step_micros_of
from tidepanel.model import KEYS, PANEL_COLUMNS, from_micros, micros
from tidepanel.operators.layout import (
    Layout,
    block_window,
    halo_blocks,
    join_groups,
    nearest_known,
    settle,
    with_position,
)
from tidepanel.operators.windows import centred_frame
from tidepanel.session import materialize

FILL_METHODS = tuple(texts.FILL_LABELS)
#: Known rows of a task that fills grids.
GRID_ROWS = 1 << 15


def merge_repeated(panel: DataFrame) -> DataFrame:
    """One row per instant: the mean of the values. Partial sums are built before the shuffle."""
    return panel.groupBy("series_id", "variable", "ts").agg(F.avg("value").alias("value"))


def merge_labels(labels: DataFrame) -> DataFrame:
    """One label per instant: an instant is anomalous if any of its rows is; NULL counts as 0."""
    return labels.groupBy("series_id", "ts").agg(
        F.max(F.coalesce(F.col("y").cast("int"), F.lit(0))).alias("y")
    )


def variable_profile(panel: DataFrame) -> DataFrame:
    """Known values, smallest and largest of each variable, and whether it is constant."""
    return panel.groupBy(*KEYS).agg(
        F.count("value").alias("n_known"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    ).withColumn("is_constant", F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)).cast("int"))


def drop_constant(panel: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Leave out variables with at most one distinct known value."""
    constant = variable_profile(panel).where("is_constant = 1").select(*KEYS)
    if layout is None:
        return panel.join(constant, KEYS, "left_anti")
    return join_groups(panel, settle(constant, layout), KEYS, layout, "left_anti")


def complete(panel: DataFrame, layout: Layout) -> DataFrame:
    """Give every variable of a series a row at every instant of the series (NULL where unknown).

    Rows that are there pass as they are. Per (series, instant) the set of its variables is made, a
    shuffle that no series can make uneven, and what it lacks of the series' own names is added. So
    any number of series may have names of their own: no pivot, no list of all names.
    """
    names = panel.groupBy("series_id").agg(F.collect_set("variable").alias("__names"))
    at = panel.groupBy("series_id", "ts").agg(F.collect_set("variable").alias("__here"))
    if layout.blocked:
        names, at = materialize(names), materialize(at)
    lacking = join_groups(at, names, ["series_id"], layout).select(
        "series_id", F.explode(F.array_except("__names", "__here")).alias("variable"), "ts"
    )
    rows = panel.select(*PANEL_COLUMNS)
    return rows.unionByName(lacking.withColumn("value", F.lit(None).cast("double")))


def missing_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*KEYS).agg(
        F.count_if(F.col("value").isNull() | F.isnan("value")).cast("long").alias("n_missing")
    )


def _grid(spans: DataFrame, step: Column, block_rows: int) -> DataFrame:
    """Positions 0..count-1 of each group, made in two steps so that a long group spreads."""
    starts = spans.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / block_rows)))
    )
    # by a fixed number: the few bytes of spans would be joined to one partition, which then made all rows
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = starts.repartition(parts, *KEYS, "__block")
    first = F.col("__block") * block_rows
    last = F.least(first + (block_rows - 1), F.col("__last"))
    return (
        starts.withColumn("__slot", F.explode(F.sequence(first, last)))
        .select(
            *KEYS,
            from_micros(F.col("__from") + F.col("__slot") * step).alias("ts"),
            F.col("__slot").alias("pos"),
            (F.col("__last") + 1).alias("n"),
        )
    )


def _spans(panel: DataFrame, freq: str | None, frequencies: DataFrame | None) -> DataFrame:
    """Per variable the first and last instant of its series, the code, and the step of a fixed one."""
    span = panel.groupBy("series_id").agg(
        F.min("ts").alias("__min_ts"), F.max("ts").alias("__max_ts")
    )
    if freq is not None:
        parse_code(freq)
        span = span.withColumn("__code", F.lit(freq))
    else:
        codes = frequencies.where("freq is not null").select("series_id", F.col("freq").alias("__code"))
        span = span.join(codes, "series_id")
    variables = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    return variables.join(span, "series_id").withColumn("__step", step_micros_of(F.col("__code")))


def _fixed(spans: DataFrame) -> DataFrame:
    """Spans of fixed steps with the microseconds they begin at and their last position."""
    fixed = spans.where("__step is not null").withColumn("__from", micros("__min_ts"))
    return fixed.withColumn(
        "__last", F.floor((micros("__max_ts") - F.col("__from")) / F.col("__step")).cast("long")
    )


def regular_grid(
    panel: DataFrame,
    freq: str | None = None,
    block_rows: int = 1 << 18,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Put each variable on the grid from its series' first to its last instant.

    Instants without a row get NULL, rows off the grid vanish. One ``freq`` serves all series, or
    ``frequencies`` (series_id, freq) gives each its own; without either the panel stays as it is, and
    so do series without a code. Fixed steps and calendar codes are columns of one plan, whatever the
    number of codes. Positions are known by arithmetic, so the result also has ``pos`` and ``n``,
    without any ordering.
    """
    if freq is None and frequencies is None:
        return panel
    spans = _spans(panel, freq, frequencies)
    axis = _grid(_fixed(spans), F.col("__step"), block_rows)
    if freq is None or step_micros(freq) is None:
        instants = calendar_instants(F.col("__code"), F.col("__min_ts"), F.col("__max_ts"))
        by_calendar = spans.where("__step is null").select(*KEYS, instants.alias("__at"))
        by_calendar = by_calendar.select(
            *KEYS, F.size("__at").cast("long").alias("n"), F.posexplode("__at").alias("pos", "ts")
        )
        by_calendar = by_calendar.select(*KEYS, "ts", F.col("pos").cast("long").alias("pos"), "n")
        axis = by_calendar if freq is not None else axis.unionByName(by_calendar)
    known = panel.select(*PANEL_COLUMNS)
    return axis.join(known, KEYS + ["ts"], "left").select(*PANEL_COLUMNS, "pos", "n")


def fill(
    positioned: DataFrame,
    method: str = "interpolate_linear",
    layout: Layout | None = None,
    by: str = "row",
) -> DataFrame:
    """Fill missing values of a positioned panel; known values are never touched.

    ``interpolate_linear`` runs along row positions (``by="time"``: along time) and holds the
    nearest value at both ends; ``ffill`` / ``bfill`` repeat the last / next value and use the
    other one at the far end; ``moving_average`` takes the mean of the five rows around, then
    interpolates what is left. A variable without any known value becomes 0.
    """
    if method not in FILL_METHODS:
        raise ValueError(f"unknown fill method: {method!r}; choose from {', '.join(FILL_METHODS)}")
    layout = Layout.of(positioned, layout)
    if by == "time" and method == "interpolate_linear":
        return fill_by_time(positioned, layout)
    columns = positioned.columns
    source = positioned.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if method == "moving_average":
        lead, tail = centred_frame(5)
        around = F.avg("value").over(block_window().rowsBetween(lead, tail))
        source = (
            halo_blocks(source, layout, before=-lead, after=tail)
            .withColumn("value", F.coalesce(F.col("value"), around))
            .where("core")
            .select(*columns)
        )
    seen = nearest_known(source, layout)
    return seen.withColumn("value", _filled(method)).select(*columns)


def _filled(method: str) -> Column:
    """The value at ``pos``, or else what ``prev`` and ``next``, the known rows around it, give."""
    before, after = F.col("prev.value"), F.col("next.value")
    if method == "ffill":
        filled = F.coalesce(F.col("value"), before, after)
    elif method == "bfill":
        filled = F.coalesce(F.col("value"), after, before)
    else:
        gap = F.col("next.pos") - F.col("prev.pos")
        done = F.col("pos") - F.col("prev.pos")
        between = F.when(gap > 0, before + (after - before) * done / gap)
        filled = F.coalesce(F.col("value"), between, before, after)
    return F.coalesce(filled, F.lit(0.0))


def _filled_grid(panel: DataFrame, spans: DataFrame, layout: Layout, method: str) -> DataFrame:
    """Grids of fixed steps, filled, where no group exceeds a block: only the rows that are there are ordered.

    Each row on the grid makes its own instant and the empty ones up to the next row; a row at position
    -1 of each group makes those before its first. So the grid itself is neither joined nor sorted.
    """
    group = _fixed(spans).select(*KEYS, "__from", "__step", "__last")
    rows = panel.select(*PANEL_COLUMNS).join(group, KEYS)
    rows = rows.withColumn("__away", micros("ts") - F.col("__from")).where("__away % __step = 0")
    value = F.when(~F.isnan("value"), F.col("value"))
    held = ["__from", "__step", "__last"]
    rows = rows.select(*KEYS, *held, F.expr("__away div __step").alias("pos"), value.alias("value"))
    begin = group.select(*KEYS, *held, F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("double").alias("value"))
    # by the number of rows: those of thousands of series take few bytes, which would make few large tasks
    parts = max(1, -(-panel.count() // GRID_ROWS))
    seen = nearest_known(rows.unionByName(begin).repartition(parts, *KEYS), layout)
    following = F.lead("pos").over(Window.partitionBy(*KEYS).orderBy("pos"))
    until = F.greatest(F.col("pos"), F.coalesce(following - 1, F.col("__last")))
    # the next known row as seen from the empty instants behind a known one
    ahead = Window.partitionBy(*KEYS).orderBy("pos")
    seen = seen.select(
        "*", until.alias("__until"), F.lead("next").over(ahead).alias("__behind")
    ).where("pos >= 0 or __until >= 0")
    size = layout.block_rows
    first = F.greatest(F.col("pos"), F.lit(0).cast("long"))
    seen = seen.withColumn("__at", F.explode(F.sequence(first, F.col("__until"), F.lit(size).cast("long"))))
    seen = seen.withColumn(
        "__slot", F.explode(F.sequence("__at", F.least(F.col("__at") + (size - 1), F.col("__until"))))
    )
    own = F.col("__slot") == F.col("pos")
    slots = seen.select(
        *KEYS,
        from_micros(F.col("__from") + F.col("__slot") * F.col("__step")).alias("ts"),
        F.col("__slot").alias("pos"),
        (F.col("__last") + 1).alias("n"),
        F.when(own, F.col("value")).alias("value"),
        "prev",
        F.when(own, F.col("next")).otherwise(F.col("__behind")).alias("next"),
    )
    return slots.withColumn("value", _filled(method)).select(*PANEL_COLUMNS, "pos", "n")


def fill_by_time(positioned: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Linear filling along time instead of row positions (the optional variant)."""
    layout = Layout.of(positioned, layout)
    columns = positioned.columns
    source = positioned.withColumn("__row", F.col("pos")).withColumn("__at", micros("ts"))
    stamped = source.withColumn(
        "__known", F.when(F.col("value").isNotNull(), F.struct("value", "__at"))
    )
    seen = nearest_known(stamped, layout, value="__known")
    lo, hi = F.col("prev.value"), F.col("next.value")
    share = (F.col("__at") - lo["__at"]) / (hi["__at"] - lo["__at"])
    between = F.when(hi["__at"] > lo["__at"], lo["value"] + (hi["value"] - lo["value"]) * share)
    filled = F.coalesce(F.col("value"), between, lo["value"], hi["value"], F.lit(0.0))
    return seen.withColumn("value", filled).select(*columns)


def impute_stats(before: DataFrame, after: DataFrame, method: str) -> DataFrame:
    """Missing cells before and after filling, per variable, and the name of the method used."""
    left = missing_counts(before).withColumnRenamed("n_missing", "n_missing_before")
    right = missing_counts(after).withColumnRenamed("n_missing", "n_missing_after")
    return left.join(right, KEYS).withColumn(
        "method",
        F.when(F.col("n_missing_before") > 0, F.lit(texts.FILL_LABELS[method])).otherwise(
            F.lit(texts.FILL_LABEL_NONE)
        ),
    )


def regularise(
    panel: DataFrame,
    freq: str | None,
    layout: Layout,
    method: str = "interpolate_linear",
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Grid, positions and filling in one go: the input detection needs."""
    fixed = frequencies is not None if freq is None else step_micros(freq) is not None
    if fixed and not layout.blocked and method in ("interpolate_linear", "ffill", "bfill"):
        filled = _filled_grid(panel, _spans(panel, freq, frequencies), layout, method)
        if freq is not None:
            return filled
        calendar = frequencies.where(step_micros_of(F.col("freq")).isNull())
        rest = panel.join(calendar, "series_id", "left_semi")
        gridded = regular_grid(rest, None, layout.block_rows, calendar)
        return filled.unionByName(fill(gridded, method, layout))
    gridded = regular_grid(panel, freq, layout.block_rows, frequencies)
    if "pos" not in gridded.columns:
        gridded = with_position(gridded, layout)
    return fill(gridded, method, layout)


def regularise_many(
    positioned: DataFrame, frequency: DataFrame, layout: Layout, method: str = "interpolate_linear"
) -> DataFrame:
    """Put uneven series on the grid of their own frequency; even ones stay as they are.

    ``frequency`` has one row per series (see :func:`quality.infer_frequency`). A series without a
    code, one of fewer than three instants, stays as it is.
    """
    uneven = frequency.where(is_irregular(frequency) & F.col("freq").isNotNull())
    uneven = settle(uneven.select("series_id", "freq"), layout)
    columns = [*PANEL_COLUMNS, "pos", "n"]
    even = join_groups(positioned, uneven, ["series_id"], layout, "left_anti").select(*columns)
    rows = join_groups(positioned, uneven, ["series_id"], layout, "left_semi").select(*PANEL_COLUMNS)
    return even.unionByName(
        regularise(rows, None, layout, method, uneven).select(*columns)
    )


def is_irregular(axis_frequency: DataFrame) -> Column:
    """True for series whose gaps differ (columns of :func:`quality.infer_frequency`)."""
    return F.col("n_gaps") > 1
