"""Seasonal-trend decomposition of every variable, spread over overlapping chunks.

All smoothers have finite windows, so a row's result depends on a known number of rows to either
side. A chunk carries that many extra rows; the rows it keeps then equal the decomposition of the
whole series, and a long series is worked on by many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import loess
from tidepanel.model import KEYS
from tidepanel.operators.layout import Layout, exact_quantiles, join_groups, settle
from tidepanel.operators.season import component_strength
from tidepanel.session import materialize

MIN_ROWS = 8
PLAIN_ROUNDS = 5
ROBUST_ROUNDS = 2
ROBUST_PASSES = 15

_OUT = (
    "series_id string, variable string, ts timestamp_ntz, pos bigint, n bigint, period bigint, "
    "observed double, trend double, seasonal double"
)


def _reach(rounds: int):
    """Column: rows a chunk needs beyond each end, in closed form of :func:`reach_per_round`."""
    period = F.col("period")
    trend = F.ceil(1.5 * period / (1 - 1.5 / 7))
    trend = F.when(trend % 2 == 1, trend).otherwise(trend + 1)
    low = F.when(period % 2 == 0, period + 1).otherwise(period + 2)
    once = 3 * period + period + 1 + F.floor((low - 1) / 2) + F.floor((trend - 1) / 2)
    return (once * rounds).cast("bigint")


def decomposable(sized: DataFrame, rounds: int, chunk_rows: int) -> DataFrame:
    """Groups with ``chunk``, ``reach`` and the reason why a group is left out (NULL: it is not)."""
    reach = _reach(rounds)
    chunk = F.greatest(F.lit(chunk_rows), 2 * reach)
    reason = (
        F.when(F.col("n") < MIN_ROWS, "fewer than 8 rows")
        .when(F.col("period").isNull(), "shorter than two seasons")
        .when(F.col("period") < 2, "period below 2")
    )
    return sized.withColumn("reach", reach).withColumn("chunk", chunk).withColumn("reason", reason)


def _pass(rows: DataFrame, sizes: DataFrame, rounds: int, weighted: bool, layout: Layout) -> DataFrame:
    """One run of ``rounds`` inner rounds over all groups."""
    placed = join_groups(rows, sizes.drop("n"), KEYS, layout)
    first = F.greatest(F.floor((F.col("pos") - F.col("reach")) / F.col("chunk")), F.lit(0))
    last = F.least(
        F.floor((F.col("pos") + F.col("reach")) / F.col("chunk")),
        F.floor((F.col("n") - 1) / F.col("chunk")),
    )
    placed = placed.withColumn(
        "part", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))
    )
    columns = ["ts", "pos", "n", "period", "chunk", "value"]
    columns += ["trend0", "weight"] if weighted else []

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", kind="stable")
        values = block["value"].to_numpy()
        period = int(block["period"].iloc[0])
        season, trend = loess.seasonal_trend(
            values,
            period,
            rounds,
            block["trend0"].to_numpy() if weighted else None,
            block["weight"].to_numpy() if weighted else None,
            int(block["pos"].iloc[0]),
            int(block["n"].iloc[0]),
        )
        out = block[["ts", "pos", "n", "period"]].assign(
            series_id=key[0], variable=key[1], observed=values, trend=trend, seasonal=season
        )
        own = (block["pos"] // block["chunk"].iloc[0]) == key[2]
        return out[own.to_numpy()]

    grouped = placed.select(*KEYS, "part", *columns).groupBy(*KEYS, "part")
    return grouped.applyInPandas(run, _OUT)


def stl(
    positioned: DataFrame,
    periods: DataFrame,
    robust: bool = False,
    layout: Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decompose each group with the ``period`` given for it in ``periods``.

    Returns the decomposed rows (observed, trend, seasonal, resid) and notes on groups left out.
    Robust weights need the median remainder of the whole series, so each robust pass is a Spark
    job over all chunks followed by an exact median per group.
    """
    layout = Layout.of(positioned, layout)
    rounds = ROBUST_ROUNDS if robust else PLAIN_ROUNDS
    sizes = positioned.groupBy(*KEYS).agg(F.first("n").alias("n"))
    sized = sizes.join(periods.select(*KEYS, F.col("period").cast("bigint").alias("period")), KEYS)
    judged = decomposable(sized, rounds, layout.block_rows)
    notes = judged.where(F.col("reason").isNotNull()).select(
        *KEYS, F.lit("stl").alias("step"), F.col("reason").alias("note")
    )
    usable = judged.where(F.col("reason").isNull()).select(*KEYS, "n", "period", "reach", "chunk")
    usable = settle(usable, layout)
    rows = positioned.select(*KEYS, "ts", "pos", "n", "value")
    resid = F.col("observed") - F.col("trend") - F.col("seasonal")
    done = _pass(rows, usable, rounds, False, layout)
    for _ in range(ROBUST_PASSES if robust else 0):
        done = materialize(done)
        size = F.abs(resid)
        sized_resid = done.withColumn("size", size)
        middle = exact_quantiles(sized_resid, "size", [0.5], layout).select(
            *KEYS, (6 * F.col("quantiles")[0]).alias("six")
        )
        ratio = F.col("size") / F.col("six")
        weight = (
            F.when((F.col("six") <= 0) | (ratio <= 0.001), 1.0)
            .when(ratio <= 0.999, F.pow(1 - ratio * ratio, 2))
            .otherwise(0.0)
        )
        again = join_groups(sized_resid, settle(middle, layout), KEYS, layout).select(
            *KEYS,
            "ts",
            "pos",
            "n",
            F.col("observed").alias("value"),
            F.col("trend").alias("trend0"),
            weight.alias("weight"),
        )
        done = _pass(again, usable, rounds, True, layout)
    return done.withColumn("resid", resid), notes


def stl_strength(decomposed: DataFrame, formula: str = "observed") -> DataFrame:
    """Period, trend strength and seasonal strength of each decomposed variable."""
    periods = decomposed.groupBy(*KEYS).agg(F.first("period").alias("period"))
    return periods.join(component_strength(decomposed, formula), KEYS)


__all__ = ["decomposable", "stl", "stl_strength"]
