"""From scores to flags: quantile thresholds, OR over scorers, OR over variables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators.forecast import forecast_residuals, guard_notes, sizing, usable
from tidepanel.operators.layout import Layout, exact_quantiles, join_groups, settle
from tidepanel.operators.scorers import SCORERS
from tidepanel.session import materialize

SCORED = [*KEYS, "scorer"]


@dataclass(frozen=True)
class Detection:
    """Tables of one detection run."""

    scores: DataFrame
    components: DataFrame
    combined: DataFrame
    sizes: DataFrame
    notes: DataFrame
    scorers: tuple[str, ...]
    layout: Layout


def thresholds(scores: DataFrame, threshold_quantile: float, layout: Layout) -> DataFrame:
    """The quantile of the scores of each variable and scorer."""
    if not 0.80 <= threshold_quantile <= 0.99:
        raise ValueError("threshold_quantile must lie between 0.80 and 0.99")
    limits = exact_quantiles(scores, "score", [threshold_quantile], layout, SCORED)
    return limits.select(*SCORED, F.col("quantiles")[0].alias("threshold"))


def flag(
    scores: DataFrame,
    threshold_quantile: float = 0.95,
    layout: Layout | None = None,
    fit_on: DataFrame | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Add ``threshold`` and ``is_anomaly`` (score strictly above it).

    The quantile is taken from the scored rows themselves, per variable and scorer, unless
    ``fit_on`` gives other scores to take it from or ``limits`` the thresholds of an earlier fit.
    """
    layout = Layout.of(scores, layout, SCORED)
    if limits is None:
        limits = thresholds(scores if fit_on is None else fit_on, threshold_quantile, layout)
    return join_groups(scores, settle(limits, layout), SCORED, layout).withColumn(
        "is_anomaly", (F.col("score") > F.col("threshold")).cast("int")
    )


def on_common_range(
    scores: DataFrame, outer: list[str], inner: list[str], layout: Layout | None = None
) -> DataFrame:
    """Rows in the time range that all members (``inner``) of a group (``outer``) cover.

    The ranges are a small aggregate: one row per member, then one per group.
    """
    spans = scores.groupBy(*outer, *inner).agg(F.min("ts").alias("__a"), F.max("ts").alias("__b"))
    common = spans.groupBy(*outer).agg(F.max("__a").alias("__from"), F.min("__b").alias("__to"))
    joined = join_groups(scores, settle(common, layout), outer, layout) if layout else scores.join(common, outer)
    return joined.where(F.col("ts").between(F.col("__from"), F.col("__to"))).drop("__from", "__to")


def combine_scorers(flagged: DataFrame, layout: Layout | None = None) -> DataFrame:
    """One flag per variable and instant: any scorer, on the range all scorers cover."""
    aligned = on_common_range(flagged, KEYS, ["scorer"], layout)
    return aligned.groupBy(*KEYS, "ts").agg(F.max("is_anomaly").alias("is_anomaly"))


def combine_variables(
    components: DataFrame, test_axis: DataFrame | None = None, layout: Layout | None = None
) -> DataFrame:
    """One flag per series and instant: any variable, on the range all variables cover.

    A series without any result gets zeros on its test instants, if those are given.
    """
    aligned = on_common_range(components, ["series_id"], ["variable"], layout)
    combined = aligned.groupBy("series_id", "ts").agg(F.max("is_anomaly").alias("any_anomaly"))
    if test_axis is None:
        return combined
    scored_series = components.select("series_id").distinct()
    silent = test_axis.join(scored_series, "series_id", "left_anti")
    return combined.unionByName(
        silent.select("series_id", "ts").distinct().withColumn("any_anomaly", F.lit(0))
    )


def run_scorers(
    chosen: list[str],
    states: dict[str, dict[str, DataFrame]],
    rows: DataFrame,
    layout: Layout,
    window_agg: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Scores of ``rows`` by the fitted scorers, and (series_id, variable, scorer, error)."""
    parts = [SCORERS[key].score(rows, states[key], layout, window_agg) for key in chosen]
    found = materialize(reduce(DataFrame.unionByName, parts))
    errors = found.where("error is not null").groupBy(*SCORED).agg(F.min("error").alias("error"))
    return found.where("error is null").drop("error"), errors


def scorer_notes(
    sizes: DataFrame,
    chosen: list[str],
    scores: DataFrame,
    errors: DataFrame,
    fit_errors: DataFrame | None = None,
    states: dict[str, dict[str, DataFrame]] | None = None,
) -> DataFrame:
    """Why a scorer has no score for a variable: one note for every such pair.

    ``sizes`` names the groups that should have scores (with n, cut, lags and window). What a grouped
    function or a fit said comes first, then what the sizes say. A clustering that had not settled
    has a note beside its scores.
    """
    tests, trains = F.col("n") - F.col("cut") - F.col("lags"), F.col("cut") - F.col("lags")
    windowed = F.col("scorer").isin(*[key for key in SCORERS if SCORERS[key].windowed])
    pairs = sizes.select(
        *KEYS, "n", "cut", "lags", "window", F.explode(F.array(*map(F.lit, chosen))).alias("scorer")
    )
    silent = pairs.join(scores.select(*SCORED).distinct(), SCORED, "left_anti").join(
        errors.withColumnRenamed("error", "scorer_error"), SCORED, "left"
    )
    fit_error = F.lit(None).cast("string")
    if fit_errors is not None:
        silent = silent.join(fit_errors.withColumnRenamed("error", "fit_error"), KEYS, "left")
        fit_error = F.concat(F.lit("no forecast: "), F.col("fit_error"))
    reason = F.coalesce(
        fit_error,
        F.col("scorer_error"),
        F.when(trains <= 0, "the train part is not longer than the lags"),
        F.when(tests <= 0, "the test part is not longer than the lags"),
        F.when(windowed & (trains < F.col("window")), "no whole window in the train part"),
        F.when(windowed & (tests < F.col("window")), "no whole window in the test part"),
        F.lit("no finite score"),
    )
    label = F.element_at(
        F.create_map(*[F.lit(x) for key in chosen for x in (key, SCORERS[key].label)]), F.col("scorer")
    )
    notes = silent.select(
        *KEYS, F.lit("detect").alias("step"), F.concat(label, F.lit(": left out, "), reason).alias("note")
    )
    if states and "kmeans" in states:
        moving = states["kmeans"]["centres"].where(~F.col("settled"))
        told = f"{SCORERS['kmeans'].label}: centres still moved in the last round"
        notes = notes.unionByName(moving.select(*KEYS, F.lit("detect").alias("step"), F.lit(told).alias("note")))
    return notes


def detect(
    positioned: DataFrame,
    test_ratio: float = 0.5,
    scorers: list[str] | None = None,
    threshold_quantile: float = 0.95,
    forecaster: str = "linear",
    layout: Layout | None = None,
    window_agg: bool = False,
    **forecast_options,
) -> Detection:
    """Forecast-residual anomaly detection on a regular, gap-free positioned panel."""
    chosen = list(SCORERS) if scorers is None else list(scorers)
    unknown = [s for s in chosen if s not in SCORERS]
    if unknown or not chosen:
        raise ValueError(f"choose at least one scorer out of {', '.join(SCORERS)}; got {chosen}")
    layout = Layout.of(positioned, layout)
    sizes = sizing(positioned, test_ratio, forecast_options.get("lags"))
    rest, fit_errors = forecast_residuals(
        positioned, test_ratio, forecaster, layout=layout, **forecast_options
    )
    rest = materialize(rest)
    states = {
        key: {name: materialize(t) for name, t in SCORERS[key].fit(rest.where("is_train"), layout).items()}
        for key in chosen
    }
    scores, errors = run_scorers(chosen, states, rest.where("not is_train"), layout, window_agg)
    flagged = materialize(flag(scores, threshold_quantile, layout))
    notes = scorer_notes(usable(sizes), chosen, scores, errors, fit_errors, states)
    components = combine_scorers(flagged, layout)
    if layout.blocked:
        components = materialize(components)  # its ranges and its rows are both read
    axis = positioned.where(
        F.col("pos") >= F.floor((F.col("n") - 1) * F.lit(1 - test_ratio))
    ).select("series_id", "ts")
    return Detection(
        scores=flagged,
        components=components,
        combined=combine_variables(components, axis, layout),
        sizes=sizes,
        notes=guard_notes(sizes).unionByName(notes),
        scorers=tuple(chosen),
        layout=layout,
    )


def kpi_summary(combined: DataFrame) -> DataFrame:
    """Instants looked at, instants flagged and their share in percent."""
    return combined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum("any_anomaly").cast("bigint").alias("n_anomalies"),
        (F.avg("any_anomaly") * 100).alias("anomaly_rate"),
    )


def anomaly_counts(components: DataFrame) -> DataFrame:
    return components.groupBy(*KEYS).agg(F.sum("is_anomaly").cast("bigint").alias("n_anomalies"))
