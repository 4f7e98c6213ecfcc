"""Autocorrelation and seasonal period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.frequency import default_period
from tidepanel.functions.scalar import TINY, clip01
from tidepanel.model import KEYS
from tidepanel.operators.grams import lag_products
from tidepanel.operators.layout import Layout

NO_PEAK_PERIOD = 12


def acf(positioned: DataFrame, max_lag: int = 200, layout: Layout | None = None) -> DataFrame:
    """Autocorrelation at lags 0..max_lag of each group (divided by the lag-0 sum)."""
    layout = Layout.of(positioned, layout)
    sums = lag_products(positioned, max_lag, layout)
    cells = sums.select(
        *KEYS, "n", F.col("sums")[0].alias("__s0"), F.posexplode("sums").alias("lag", "__s")
    )
    return cells.where(F.col("lag") < F.col("n")).select(
        *KEYS,
        "n",
        F.col("lag").cast("bigint").alias("lag"),
        F.when(F.col("__s0") > 0, F.col("__s") / F.col("__s0")).alias("acf"),
    )


def estimate_period(
    positioned: DataFrame, max_lag: int = 200, layout: Layout | None = None
) -> DataFrame:
    """Seasonal period: the lag of the highest local peak of the autocorrelation.

    Short series (below twice ``max_lag``) get a tenth of their length, series without a peak 12.
    """
    lags = acf(positioned, max_lag, layout)
    along = Window.partitionBy(*KEYS).orderBy("lag")
    near = lags.select(
        *KEYS,
        "n",
        "lag",
        "acf",
        F.lag("acf").over(along).alias("left"),
        F.lead("acf").over(along).alias("right"),
    )
    is_peak = (
        F.col("lag").between(2, max_lag - 1)
        & (F.col("acf") > F.col("left"))
        & (F.col("acf") > F.col("right"))
    )
    best = near.groupBy(*KEYS).agg(
        F.first("n").alias("n"),
        F.min(F.when(is_peak, F.struct((-F.col("acf")).alias("a"), F.col("lag").alias("k")))).alias("b"),
    )
    short = F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    period = F.when(F.col("n") < 2 * max_lag, short).otherwise(
        F.coalesce(F.col("b.k"), F.lit(NO_PEAK_PERIOD))
    )
    return best.select(*KEYS, "n", period.cast("bigint").alias("period"))


def period_from_frequency(sizes: DataFrame, freq: str = "freq", n: str = "n") -> DataFrame:
    """Default period of each row's frequency code and length."""
    return sizes.withColumn("period", default_period(F.col(freq), F.col(n)))


def component_strength(decomposed: DataFrame, formula: str = "observed") -> DataFrame:
    """Trend and seasonal strength in 0..1 of decomposed rows.

    ``formula="observed"`` compares the remainder with observed - trend + remainder (and with
    observed - seasonal + remainder); ``"standard"`` with trend + remainder and
    seasonal + remainder.
    """
    observed, trend, seasonal, resid = (
        F.col(c) for c in ("observed", "trend", "seasonal", "resid")
    )
    if formula == "observed":
        against_trend = observed - trend + resid
        against_seasonal = observed - seasonal + resid
    elif formula == "standard":
        against_trend, against_seasonal = trend + resid, seasonal + resid
    else:
        raise ValueError(f"unknown formula: {formula!r}")
    variances = decomposed.groupBy(*KEYS).agg(
        F.var_pop(resid).alias("__r"),
        F.var_pop(against_trend).alias("__t"),
        F.var_pop(against_seasonal).alias("__s"),
    )

    def strength(base: str):
        share = clip01(1 - F.col("__r") / F.col(base))
        return F.when(F.col(base) > TINY, share).otherwise(F.lit(0.0))

    return variances.select(
        *KEYS, strength("__t").alias("trend_strength"), strength("__s").alias("seasonal_strength")
    )
