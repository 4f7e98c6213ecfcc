"""How good the flags are: against labels, or without any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import wall_time, zero_if_undefined
from tidepanel.model import KEYS
from tidepanel.operators.detect import SCORED, on_common_range
from tidepanel.operators.layout import Layout, running


#: The label column whose rate is shown as the true one.
TRUE_LABEL = "is_anomaly"


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``y`` by exact instant; an instant without a label counts as normal."""
    wall = labels.select("series_id", wall_time(F.col("ts")).alias("ts"), "y")
    return rows.join(wall, ["series_id", "ts"], "left").withColumn(
        "y", F.coalesce(F.col("y"), F.lit(0)).cast("int")
    )


def ranking_metrics(
    labelled: DataFrame, layout: Layout | None = None, keys: list[str] = SCORED
) -> DataFrame:
    """Area under the ROC curve and average precision; NULL where only one class occurs.

    Rows with the same score are added up first, so a score that repeats very often is one row;
    all that follows is a running sum over distinct scores, highest first.
    """
    layout = Layout.of(labelled, layout, keys)
    per_score = labelled.groupBy(*keys, "score").agg(
        F.sum("y").cast("bigint").alias("p"), F.sum(1 - F.col("y")).cast("bigint").alias("q")
    )
    ranked = running(
        per_score, keys, "score", {"tp": F.col("p"), "fp": F.col("q")}, layout, descending=True
    )
    pairs = F.col("q") * (F.col("tp") - F.col("p") + F.col("p") / 2)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = ranked.groupBy(*keys).agg(
        F.sum(pairs.cast("double")).alias("__pairs"),
        F.sum(F.col("p") * precision).alias("__ap"),
        F.sum("p").alias("__p"),
        F.sum("q").alias("__q"),
    )
    both = (F.col("__p") > 0) & (F.col("__q") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("__pairs") / (F.col("__p").cast("double") * F.col("__q"))).alias("auc_roc"),
        F.when(both, F.col("__ap") / F.col("__p")).alias("auc_pr"),
    )


def flag_metrics(labelled: DataFrame, keys: list[str] = SCORED) -> DataFrame:
    """Precision, recall and F1 of the flags, zero where undefined."""
    hit = F.col("y") * F.col("is_anomaly")
    counts = labelled.groupBy(*keys).agg(
        F.sum(hit).cast("bigint").alias("tp"),
        F.sum("is_anomaly").cast("bigint").alias("n_detected"),
        F.sum("y").cast("bigint").alias("__true"),
    )
    tp, detected, true = F.col("tp"), F.col("n_detected"), F.col("__true")
    return counts.select(
        *keys,
        zero_if_undefined(tp, detected).alias("precision"),
        zero_if_undefined(tp, true).alias("recall"),
        zero_if_undefined(2 * tp, detected + true).alias("f1"),
        "n_detected",
    )


def true_anomalies(combined: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled anomalies in the range of the combined flags: one number for all scorers."""
    return with_labels(combined, labels).groupBy("series_id").agg(
        F.sum("y").cast("bigint").alias("n_true_anomalies")
    )


def evaluate_with_labels(
    scores: DataFrame, combined: DataFrame, labels: DataFrame, layout: Layout | None = None
) -> DataFrame:
    """All labelled metrics per variable and scorer."""
    labelled = with_labels(scores, labels)
    ranking = ranking_metrics(labelled, layout)
    flags = flag_metrics(labelled)
    true = true_anomalies(combined, labels)
    return flags.join(ranking, SCORED, "left").join(true, "series_id", "left").select(
        *SCORED, "auc_roc", "auc_pr", "precision", "recall", "f1", "n_true_anomalies", "n_detected"
    )


def best_auc(metrics: DataFrame) -> DataFrame:
    """Each variable's best scorer, averaged over variables; NULLs are left out."""
    best = metrics.groupBy(*KEYS).agg(F.max("auc_roc").alias("auc_roc"))
    return best.groupBy("series_id").agg(F.avg("auc_roc").alias("best_auc"))


def true_rate(labels: DataFrame, label_col: str | None = TRUE_LABEL) -> DataFrame:
    """Share of labelled anomalies over the whole series, in percent.

    Only a column of the name ``is_anomaly`` is taken to hold the truth; for any other the table is
    empty.
    """
    labels = labels if label_col == TRUE_LABEL else labels.limit(0)
    return labels.groupBy("series_id").agg((F.avg("y") * 100).alias("true_rate"))


def confusion(combined: DataFrame, labels: DataFrame) -> DataFrame:
    """2x2 counts of label and combined flag, zeros included; nothing if only one class occurs."""
    labelled = with_labels(combined, labels)
    counts = labelled.groupBy("series_id").agg(
        F.min("y").alias("lo"),
        F.max("y").alias("hi"),
        *[
            F.count_if((F.col("y") == y) & (F.col("any_anomaly") == a)).cast("bigint").alias(f"c{y}{a}")
            for y in (0, 1)
            for a in (0, 1)
        ],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(y).alias("y"), F.lit(a).alias("any_anomaly"), F.col(f"c{y}{a}").alias("n")
            )
            for y in (0, 1)
            for a in (0, 1)
        ]
    )
    return counts.where("lo < hi").select("series_id", F.inline(cells))


def evaluate_unsupervised(scores: DataFrame) -> DataFrame:
    """Counts, score distribution and how far flagged scores stand out from the others."""
    known = F.when(~F.isnan("score"), F.col("score"))
    flagged = F.col("is_anomaly") == 1
    stats = scores.groupBy(*SCORED).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum("is_anomaly").cast("bigint").alias("n_detected"),
        F.avg("is_anomaly").alias("detection_rate"),
        F.avg(known).alias("score_mean"),
        F.stddev_pop(known).alias("score_std"),
        F.max(known).alias("score_max"),
        F.avg(F.when(flagged, F.col("score"))).alias("__a"),
        F.avg(F.when(~flagged, F.col("score"))).alias("__b"),
    )
    mixed = (F.col("n_detected") > 0) & (F.col("n_detected") < F.col("__n"))
    ratio = F.when(F.col("__b") != 0, F.col("__a") / F.col("__b")).otherwise(F.lit(float("inf")))
    return stats.select(
        *SCORED,
        "n_detected",
        "detection_rate",
        "score_mean",
        "score_std",
        "score_max",
        F.when(mixed, ratio).otherwise(F.lit(float("nan"))).alias("separation_ratio"),
    )


def scorer_agreement(scores: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Share of instants at which two scorers of a variable give the same flag.

    Instants are first counted by flag pattern (a handful per variable); scorers are paired on
    those counts only.
    """
    aligned = on_common_range(scores, KEYS, ["scorer"], layout)
    flags = F.sort_array(F.collect_list(F.struct("scorer", "is_anomaly")))
    patterns = aligned.groupBy(*KEYS, "ts").agg(flags.alias("flags")).groupBy(*KEYS, "flags").count()
    pairs = patterns.withColumn("a", F.explode("flags")).withColumn("b", F.explode("flags"))
    same = (F.col("a.is_anomaly") == F.col("b.is_anomaly")).cast("bigint")
    return pairs.groupBy(
        *KEYS, F.col("a.scorer").alias("scorer_a"), F.col("b.scorer").alias("scorer_b")
    ).agg((F.sum(same * F.col("count")) / F.sum("count")).alias("agreement"))


def agreement_matrix(agreement: DataFrame, scorers: list[str]) -> DataFrame:
    """The same as a square table."""
    return agreement.groupBy(*KEYS, "scorer_a").pivot("scorer_b", scorers).agg(F.first("agreement"))
