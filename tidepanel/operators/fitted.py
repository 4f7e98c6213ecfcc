"""Detection in two steps: fit on one panel, keep what was fitted as tables, score later rows.

A model is a set of tables with one version: ``forecast`` (scaling, lag coefficients, window widths),
the states of the scorers (``kmeans.centres``, ``wasserstein.quantiles``) and ``thresholds``, the
quantiles of the scores that the fitted scorers give to the fit rows themselves. Scoring reads these
tables and the new rows only; the rows of the fit are not needed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators.detect import flag, run_scorers, scorer_notes, thresholds
from tidepanel.operators.forecast import (
    MAX_LAGS,
    MAX_WINDOW,
    apply_linear,
    fit_linear,
    guard_notes,
    usable,
)
from tidepanel.operators.layout import Layout
from tidepanel.operators.scorers import SCORERS
from tidepanel.session import materialize
from tidepanel.sources.sinks import publish, published


@dataclass(frozen=True)
class Model:
    """Fitted tables by name; those of a scorer are called ``<scorer>.<table>``."""

    version: str
    scorers: tuple[str, ...]
    threshold_quantile: float
    tables: dict[str, DataFrame]
    notes: DataFrame | None = None

    def states(self) -> dict[str, dict[str, DataFrame]]:
        states: dict[str, dict[str, DataFrame]] = {key: {} for key in self.scorers}
        for name, table in self.tables.items():
            scorer, _, part = name.partition(".")
            if part:
                states[scorer][part] = table
        return states


def _fit_sizes(positioned: DataFrame, lags: int | None) -> DataFrame:
    """As ``forecast.sizing``, but every row is a train row."""
    value = F.col("value")
    stats = positioned.groupBy(*KEYS).agg(
        F.first("n").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("spread"),
        F.count_if(value.isNull()).alias("n_missing"),
    )
    n = F.col("n")
    lag_count = F.greatest(F.lit(2), F.least(F.lit(MAX_LAGS), F.floor(n / 4))) if lags is None else F.lit(lags)
    width = F.greatest(F.lit(2), F.least(F.lit(MAX_WINDOW), F.floor(n / 6)))
    return stats.select(
        *KEYS,
        "n",
        n.alias("cut"),
        lag_count.cast("int").alias("lags"),
        width.cast("int").alias("window"),
        "mean",
        F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0)).alias("spread"),
        "n_missing",
    )


def fit(
    positioned: DataFrame,
    scorers: list[str] | None = None,
    threshold_quantile: float = 0.95,
    lags: int | None = None,
    layout: Layout | None = None,
    version: str | None = None,
) -> Model:
    """Fit forecaster, scorers and thresholds on a regular, gap-free positioned panel.

    Groups of fewer than 20 rows and groups with missing values are left out, with a note; a group
    whose fit fails has a row with its ``error`` in ``forecast``.
    """
    chosen = list(SCORERS) if scorers is None else list(scorers)
    unknown = [s for s in chosen if s not in SCORERS]
    if unknown or not chosen:
        raise ValueError(f"choose at least one scorer out of {', '.join(SCORERS)}; got {chosen}")
    layout = Layout.of(positioned, layout)
    sizes = _fit_sizes(positioned, lags)
    reach = MAX_LAGS if lags is None else lags
    forecast = fit_linear(positioned, lags=lags, layout=layout, sizes=usable(sizes))
    rest = materialize(apply_linear(positioned, forecast, layout, reach))
    tables = {"forecast": forecast}
    states: dict[str, dict[str, DataFrame]] = {}
    for key in chosen:
        states[key] = {name: materialize(t) for name, t in SCORERS[key].fit(rest, layout).items()}
        tables |= {f"{key}.{name}": t for name, t in states[key].items()}
    scores, _ = run_scorers(chosen, states, rest, layout)
    tables["thresholds"] = materialize(thresholds(scores, threshold_quantile, layout))
    errors = forecast.where("error is not null").select(
        *KEYS, F.lit("fit").alias("step"), F.concat(F.lit("left out: "), "error").alias("note")
    )
    notes = guard_notes(sizes).unionByName(errors)
    return Model(version or uuid.uuid4().hex, tuple(chosen), threshold_quantile, tables, notes)


def save(model: Model, folder: str) -> str:
    """Publish the model's tables: readers see all of a version or none."""
    facts = {"quantile": repr(model.threshold_quantile), "scorers": ",".join(model.scorers)}
    return publish(model.tables, folder, model.version, facts)


def load(spark: SparkSession, folder: str, version: str | None = None) -> Model:
    """The model of a version, by default the one that was published last."""
    found = published(spark, folder, version)
    scorers = tuple(found.facts["scorers"].split(","))
    return Model(found.run_id, scorers, float(found.facts["quantile"]), found.tables)


def score(
    positioned: DataFrame, model: Model, layout: Layout | None = None, window_agg: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Scores of new rows with ``threshold`` and ``is_anomaly``, and notes.

    The new rows are a panel of their own: a row has a forecast when all its lags lie among them. A
    group that the model does not know has a note, and so has every scorer without a score.
    """
    layout = Layout.of(positioned, layout)
    fitted = model.tables["forecast"]
    if not layout.blocked and "wasserstein.quantiles" in model.tables:
        # what was fitted may be longer than what is scored
        held = Layout.measure(model.tables["wasserstein.quantiles"], block_rows=layout.block_rows)
        layout = held if held.blocked else layout
    lengths = positioned.groupBy(*KEYS).agg(
        F.first("n").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing")
    )
    lengths = materialize(lengths)
    # all rows come after the fit: its train part ends before their first position
    groups = fitted.drop("n", "cut").join(lengths.where("n_missing = 0"), KEYS).withColumn(
        "cut", F.lit(0).cast("bigint")
    )
    groups = materialize(groups.drop("n_missing"))
    reach = int(fitted.agg(F.max("lags")).first()[0] or 0)
    rest = materialize(apply_linear(positioned, groups, layout, reach))
    scores, errors = run_scorers(list(model.scorers), model.states(), rest, layout, window_agg)
    flagged = materialize(flag(scores, layout=layout, limits=model.tables["thresholds"]))
    # the train part is long enough, or there would be no model
    sizes = groups.select(
        *KEYS,
        (F.col("n") + F.col("lags") + F.col("window")).alias("n"),
        (F.col("lags") + F.col("window")).cast("bigint").alias("cut"),
        "lags",
        "window",
    )
    fit_errors = fitted.where("error is not null").select(*KEYS, "error")
    notes = scorer_notes(sizes, list(model.scorers), scores, errors, fit_errors)
    strange = lengths.join(fitted.select(*KEYS), KEYS, "left_anti")
    told = F.when(F.col("n_missing") > 0, "left out: missing values remain").otherwise(
        "left out: the model does not know it"
    )
    holes = lengths.where("n_missing > 0").join(fitted.select(*KEYS), KEYS, "left_semi")
    notes = notes.unionByName(
        strange.unionByName(holes).select(*KEYS, F.lit("score").alias("step"), told.alias("note"))
    )
    return flagged, notes
