"""Severity of instants and a readable explanation of the worst ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import texts
from tidepanel.functions.scalar import TINY, percent_change, z_score
from tidepanel.model import KEYS
from tidepanel.operators.detect import SCORED, on_common_range
from tidepanel.operators.layout import Layout, join_groups, settle
from tidepanel.operators.scorers import SCORERS
from tidepanel.session import materialize

RECENT_ROWS = 10
MAX_BROADCAST_TOP = 10_000


def severity(scores: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Mean over scorers of the score scaled to 0..1, on the range all of them cover.

    Scorers whose scores are all the same are left out. ``layout`` tells of large groups.
    """
    layout = layout or Layout(0)
    spans = scores.groupBy(*SCORED).agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    spread = spans.where(F.col("__hi") - F.col("__lo") >= TINY)
    scaled = join_groups(scores, settle(spread, layout), SCORED, layout).withColumn(
        "scaled", (F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    )
    if layout.blocked:
        scaled = materialize(scaled)  # its ranges and its rows are both read
    aligned = on_common_range(scaled, KEYS, ["scorer"], layout)
    return aligned.groupBy(*KEYS, "ts").agg(
        F.min("pos").alias("pos"), F.avg("scaled").alias("severity")
    )


def top_anomalies(
    scores: DataFrame, top_n: int = 5, per_series: bool = True, layout: Layout | None = None
) -> DataFrame:
    """The ``top_n`` worst (variable, instant) pairs of each series, over all its variables.

    ``per_series=False`` takes them of the whole table. Each task passes on only the first
    ``top_n`` of a series (Spark's group limit, up to 1,000), so a long series is not gathered.
    """
    order = [F.col("severity").desc(), *KEYS, "ts"]
    if not per_series:
        return severity(scores, layout).orderBy(*order).limit(top_n)
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(*order))
    ranked = severity(scores, layout).withColumn("__rank", rank)
    return ranked.where(F.col("__rank") <= top_n).drop("__rank")


def _when_text(ts: Column) -> Column:
    fraction = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def explain_top_anomalies(
    scores: DataFrame,
    positioned: DataFrame,
    sizes: DataFrame,
    top_n: int = 5,
    per_series: bool = True,
    layout: Layout | None = None,
) -> DataFrame:
    """Value, distance from the train part, recent change and agreeing scorers of the worst instants.

    Only the few rows around each chosen instant are looked up: the chosen rows are the small side
    of every join, and they are counted before they are broadcast.
    """
    # written once: it is the side of four joins, and behind it lies the whole scoring
    top = materialize(top_anomalies(scores, top_n, per_series, layout))
    few = top.count() <= MAX_BROADCAST_TOP

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    wanted = top.select(
        *KEYS,
        F.col("pos").alias("at"),
        F.explode(F.sequence(F.col("pos") - RECENT_ROWS, F.col("pos"))).alias("pos"),
    )
    around = positioned.select(*KEYS, "pos", "value").join(small(wanted), KEYS + ["pos"])
    values = around.groupBy(*KEYS, F.col("at").alias("pos")).agg(
        F.max(F.when(F.col("pos") == F.col("at"), F.col("value"))).alias("value"),
        F.avg(F.when(F.col("pos") < F.col("at"), F.col("value"))).alias("recent_mean"),
    )
    chosen = top.select(*KEYS).distinct()
    cuts = sizes.select(*KEYS, "cut").join(small(chosen), KEYS)
    train = positioned.select(*KEYS, "pos", "value").join(small(cuts), KEYS)
    baseline = train.where(F.col("pos") < F.col("cut")).groupBy(*KEYS).agg(
        F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std")
    )
    rank = F.coalesce(
        *[F.when(F.col("scorer") == key, F.lit(i)) for i, key in enumerate(SCORERS)],
        F.lit(len(SCORERS)),
    )
    hits = scores.where(F.col("is_anomaly") == 1).select(*SCORED, "ts").join(
        small(top.select(*KEYS, "ts")), KEYS + ["ts"]
    )
    found = hits.groupBy(*KEYS, "ts").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(rank.alias("i"), "scorer"))), lambda s: s["scorer"]
        ).alias("detected_by")
    )
    facts = (
        top.join(values, KEYS + ["pos"])
        .join(baseline, KEYS)
        .join(found, KEYS + ["ts"], "left")
        .withColumn("detected_by", F.coalesce("detected_by", F.array().cast("array<string>")))
        .withColumn(
            "sigma_from_mean", z_score(F.col("value"), F.col("base_mean"), F.col("base_std"))
        )
        .withColumn("recent_mean", F.coalesce("recent_mean", "base_mean"))
        .withColumn("pct_change_recent", percent_change(F.col("value"), F.col("recent_mean")))
        .withColumn(
            "direction",
            F.when(F.col("value") > F.col("base_mean"), texts.DIRECTION_UP).otherwise(
                texts.DIRECTION_DOWN
            ),
        )
    )
    many = F.size("detected_by")
    confidence = (
        F.when(many >= 2, texts.CONFIDENCE_HIGH)
        .when(many == 1, texts.CONFIDENCE_MEDIUM)
        .otherwise(texts.CONFIDENCE_REFERENCE)
    )
    names = F.create_map(*[F.lit(x) for k, s in SCORERS.items() for x in (k, s.label)])
    labels = F.transform("detected_by", lambda k: F.coalesce(F.element_at(names, k), k))
    facts = facts.withColumn("confidence_label", confidence).withColumn("__labels", labels)
    lines = F.array(
        _when_text(F.col("ts")),
        F.format_string(texts.LINE_VARIABLE, "variable"),
        F.format_string(texts.LINE_SIGMA, "sigma_from_mean"),
        F.col("direction"),
        F.when(
            F.col("pct_change_recent").isNotNull(),
            F.format_string(texts.LINE_CHANGE, "pct_change_recent"),
        ),
        F.when(
            many >= 2, F.format_string(texts.LINE_DETECTED_MANY, F.array_join("__labels", ", "))
        ).when(many == 1, F.format_string(texts.LINE_DETECTED_ONE, F.col("__labels")[0])),
        F.format_string(texts.LINE_CONFIDENCE, "confidence_label"),
    )
    return facts.select(
        *KEYS,
        "ts",
        "severity",
        "value",
        "sigma_from_mean",
        "pct_change_recent",
        "direction",
        "detected_by",
        "confidence_label",
        F.filter(lines, lambda line: line.isNotNull()).alias("summary_lines"),
    )
