"""Result tables, as they would be shown or reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import signed
from tidepanel.model import KEYS, from_micros, micros
from tidepanel.operators.detect import SCORED, anomaly_counts


def flagged_series(positioned: DataFrame, components: DataFrame) -> DataFrame:
    """Every row of a variable with its flag; rows outside the scored range have none set."""
    flags = components.select(*KEYS, "ts", "is_anomaly")
    return positioned.select(*KEYS, "ts", "value").join(flags, KEYS + ["ts"], "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(0))
    )


def anomaly_points(positioned: DataFrame, components: DataFrame) -> DataFrame:
    """Flagged instants with their value."""
    hits = components.where("is_anomaly = 1").select(*KEYS, "ts")
    return positioned.select(*KEYS, "ts", "value").join(hits, KEYS + ["ts"])


def focus_range(positioned: DataFrame, components: DataFrame, pad: float = 0.15) -> DataFrame:
    """Time range around a variable's anomalies, padded on both sides but inside the data."""
    data = positioned.groupBy(*KEYS).agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi"))
    hits = components.where("is_anomaly = 1").groupBy(*KEYS).agg(
        F.min("ts").alias("__a"), F.max("ts").alias("__b")
    )
    first, last = micros("__a"), micros("__b")
    padding = F.floor(F.greatest(last - first, F.lit(1_000_000)) * F.lit(pad)).cast("bigint")
    return hits.join(data, KEYS).select(
        *KEYS,
        F.greatest("__lo", from_micros(first - padding)).alias("focus_from"),
        F.least("__hi", from_micros(last + padding)).alias("focus_to"),
    )


def top_variables(components: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` variables of each series with the most flagged instants, and bar lengths 0..1."""
    counts = anomaly_counts(components)
    order = Window.partitionBy("series_id").orderBy(F.col("n_anomalies").desc(), "variable")
    most = Window.partitionBy("series_id")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn(
            "share", F.col("n_anomalies") / F.greatest(F.max("n_anomalies").over(most), F.lit(1))
        )
    )


def score_table(
    scores: DataFrame, scorers: list[str], forest: DataFrame | None = None
) -> DataFrame:
    """Scores of all scorers side by side, one row per variable and instant."""
    rows = scores.select(*SCORED, "ts", "score", "is_anomaly")
    names = list(scorers)
    if forest is not None:
        rows = rows.unionByName(forest.select(*SCORED, "ts", "score", "is_anomaly"))
        names.append("iforest")
    wide = rows.groupBy(*KEYS, "ts").agg(
        *[
            F.max(F.when(F.col("scorer") == s, F.col(c))).alias(f"{s}_{c}")
            for s in names
            for c in ("score", "is_anomaly")
        ]
    )
    flags = [F.col(f"{s}_is_anomaly") for s in scorers]
    any_flag = F.greatest(*flags) if len(flags) > 1 else flags[0]
    return wide.withColumn("any_scorer", any_flag)


def labelled_table(metrics: DataFrame) -> DataFrame:
    """Labelled metrics rounded for display."""
    rounded = ["auc_roc", "auc_pr", "precision", "recall", "f1"]
    return metrics.select(
        *SCORED, *[F.round(c, 3).alias(c) for c in rounded], "n_true_anomalies", "n_detected"
    )


def unlabelled_table(metrics: DataFrame) -> DataFrame:
    """Metrics without labels, rounded for display."""
    ratio = F.when(~F.isnan("separation_ratio"), F.round("separation_ratio", 2))
    return metrics.select(
        *SCORED,
        "n_detected",
        F.round(F.col("detection_rate") * 100, 2).alias("detection_percent"),
        F.round("score_mean", 3).alias("score_mean"),
        F.round("score_max", 3).alias("score_max"),
        ratio.alias("separation_ratio"),
    )


def strength_table(strength: DataFrame) -> DataFrame:
    return strength.select(
        *KEYS,
        "period",
        F.round("trend_strength", 3).alias("trend_strength"),
        F.round("seasonal_strength", 3).alias("seasonal_strength"),
    )


def stationarity_table(results: DataFrame) -> DataFrame:
    pvalue = F.coalesce(F.format_string("%.4f", "ljungbox_pvalue"), F.lit("-"))
    return results.select(
        *KEYS,
        F.round("adf_statistic", 3).alias("adf_statistic"),
        F.round("adf_pvalue", 4).alias("adf_pvalue"),
        "is_stationary",
        F.when(F.col("ljungbox_pvalue").isNull(), "-").otherwise(pvalue).alias("ljungbox_pvalue"),
        "interpretation",
    )


def explanation_table(explanations: DataFrame) -> DataFrame:
    return explanations.select(
        *KEYS,
        "ts",
        F.round("value", 4).alias("value"),
        signed(F.col("sigma_from_mean")).alias("sigma"),
        F.when(
            F.col("pct_change_recent").isNotNull(), signed(F.col("pct_change_recent"))
        ).alias("change_percent"),
        "direction",
        "detected_by",
        "confidence_label",
    )
