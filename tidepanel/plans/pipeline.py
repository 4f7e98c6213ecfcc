"""The whole analysis: cleaned panel -> quality, seasons, stationarity, anomalies, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators import (
    clean,
    decompose,
    detect,
    evaluate,
    explain,
    iforest,
    quality,
    results,
    season,
    stationarity,
)
from tidepanel.operators.layout import Layout, with_position
from tidepanel.session import materialize


@dataclass(frozen=True)
class Options:
    """What a user may choose; the ranges are checked where the values are used."""

    fill_method: str = "interpolate_linear"
    test_ratio: float = 0.30
    scorers: tuple[str, ...] = ("norm", "kmeans", "wasserstein")
    threshold_quantile: float = 0.95
    forecaster: str = "linear"
    forest: bool = True
    contamination: float = 0.05
    stl_period: int | None = None
    top_n: int = 5


def prepare(panel: DataFrame, method: str = "interpolate_linear") -> tuple[DataFrame, Layout]:
    """Constant variables out, missing cells filled: the frame all statistics are made on."""
    kept = materialize(clean.drop_constant(panel, Layout.measure(panel)))
    layout = Layout.measure(kept)
    return materialize(clean.fill(with_position(kept, layout), method, layout)), layout


#: The tables of a report, in the order of its sections.
REPORT = ("overview", "quality_stats", "strength", "stationarity", "kpi", "explanations", "metrics", "notes")


def report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a report out of those of an analysis, the explanations rounded for display."""
    chosen = {name: tables[name] for name in REPORT}
    return chosen | {"explanations": results.explanation_table(tables["explanations"])}


def analyse(
    panel: DataFrame,
    labels: DataFrame | None = None,
    options: Options = Options(),
    label_col: str | None = evaluate.TRUE_LABEL,
) -> dict[str, DataFrame]:
    """All result tables of a panel. Heavy intermediate tables are written once and shared.

    ``label_col`` is the name the labels had in their source; it decides whether their rate is shown.
    """
    panel = materialize(clean.complete(panel, Layout.measure(panel)))
    filled, layout = prepare(panel, options.fill_method)
    axis = panel.select("series_id", "ts").distinct()
    frequency = materialize(quality.infer_frequency(axis, layout))
    tables = {
        "overview": quality.panel_overview(panel, frequency),
        "frequency": frequency,
        "quality_missing": clean.missing_counts(panel),
        "quality_stats": quality.describe(filled, layout),
        "impute_stats": clean.impute_stats(
            panel.join(filled.select(*KEYS).distinct(), KEYS, "left_semi"),
            filled,
            options.fill_method,
        ),
        "variables": clean.variable_profile(panel),
    }

    if options.stl_period is not None:
        if not 2 <= options.stl_period <= 500:
            raise ValueError("stl_period must lie between 2 and 500")
        periods = filled.select(*KEYS).distinct().withColumn("period", F.lit(options.stl_period))
    else:
        periods = materialize(season.estimate_period(filled, layout=layout))
    parts, stl_notes = decompose.stl(filled, periods, layout=layout)
    parts = materialize(parts)
    tables["decomposition"] = parts
    tables["strength"] = results.strength_table(decompose.stl_strength(parts))

    tested = materialize(stationarity.stationarity(filled, layout=layout))
    tables["stationarity"] = results.stationarity_table(tested)
    tables["stationarity_counts"] = stationarity.stationarity_counts(tested)

    regular = materialize(clean.regularise_many(filled, frequency, layout))
    layout = Layout.measure(regular)
    found = detect.detect(
        regular,
        options.test_ratio,
        list(options.scorers),
        options.threshold_quantile,
        options.forecaster,
        layout,
    )
    tables["scores"] = found.scores
    tables["components"] = found.components
    tables["combined"] = found.combined
    tables["notes"] = found.notes.unionByName(stl_notes)
    tables["kpi"] = detect.kpi_summary(found.combined)
    tables["top_variables"] = results.top_variables(found.components)
    tables["focus"] = results.focus_range(regular, found.components)
    tables["agreement"] = evaluate.scorer_agreement(found.scores, layout)
    tables["explanations"] = explain.explain_top_anomalies(
        found.scores, regular, found.sizes, options.top_n, layout=layout
    )

    forest = None
    if options.forest:
        forest = materialize(
            iforest.detect_isolation_forest(filled, options.contamination, layout=layout)
        )
        tables["forest"] = forest
        tables["forest_combined"] = iforest.combine_forest(forest)
    tables["score_table"] = results.score_table(found.scores, list(options.scorers), forest)

    if labels is not None:
        metrics = evaluate.evaluate_with_labels(found.scores, found.combined, labels, layout)
        tables["metrics"] = results.labelled_table(metrics)
        tables["best_auc"] = evaluate.best_auc(metrics)
        tables["confusion"] = evaluate.confusion(found.combined, labels)
        tables["true_rate"] = evaluate.true_rate(labels, label_col)
        if forest is not None:
            tables["forest_metrics"] = evaluate.ranking_metrics(
                evaluate.with_labels(forest, labels), layout
            )
    else:
        tables["metrics"] = results.unlabelled_table(evaluate.evaluate_unsupervised(found.scores))
    return tables
