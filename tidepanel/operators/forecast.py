"""Train/test split, scaling and one-step-ahead forecasts on lagged values."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepanel.model import KEYS
from tidepanel.operators.grams import block_sums, from_triangle, gram, solve_normal
from tidepanel.operators.layout import Layout, attach, halo_blocks
from tidepanel.operators.windows import lag_columns
from tidepanel.session import materialize, shared_folder

MIN_ROWS = 20
MAX_LAGS = 14
MAX_WINDOW = 20
SEED = 42
FITS_AT_A_TIME = 4


def check_ratio(test_ratio: float) -> float:
    if not 0.1 <= test_ratio <= 0.6:
        raise ValueError("test_ratio must lie between 0.10 and 0.60")
    return test_ratio


def sizing(positioned: DataFrame, test_ratio: float = 0.5, lags: int | None = None) -> DataFrame:
    """Per group: ``n``, ``cut`` (first test position), lag count, window width, train mean, spread.

    The spread is the population one; a constant train part is scaled by 1.
    """
    cut = F.floor((F.col("n") - 1) * F.lit(1 - check_ratio(test_ratio))).cast("bigint")
    in_train = F.col("pos") < cut
    stats = positioned.groupBy(*KEYS).agg(
        F.first("n").alias("n"),
        F.first(cut).alias("cut"),
        F.avg(F.when(in_train, F.col("value"))).alias("mean"),
        F.stddev_pop(F.when(in_train, F.col("value"))).alias("spread"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    chosen = F.least(F.lit(MAX_LAGS), F.floor(F.col("cut") / 4))
    width = F.least(F.lit(MAX_WINDOW), F.floor(F.col("cut") / 6))
    lag_count = F.greatest(F.lit(2), chosen) if lags is None else F.lit(lags)
    return stats.select(
        *KEYS,
        "n",
        "cut",
        lag_count.cast("int").alias("lags"),
        F.greatest(F.lit(2), width).cast("int").alias("window"),
        "mean",
        F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0)).alias("spread"),
        "n_missing",
    )


def guard_notes(sizes: DataFrame) -> DataFrame:
    """Why a variable is left out, or why its result deserves care."""
    n, cut = F.col("n"), F.col("cut")
    note = (
        F.when(n < MIN_ROWS, "left out: fewer than 20 rows")
        .when(F.col("n_missing") > 0, "left out: missing values remain")
        .when(cut < F.col("lags") + 5, "short train part: less precise")
    )
    return (
        sizes.withColumn("note", note)
        .where(F.col("note").isNotNull())
        .select(*KEYS, F.lit("detect").alias("step"), "note")
    )


def usable(sizes: DataFrame) -> DataFrame:
    return sizes.where((F.col("n") >= MIN_ROWS) & (F.col("n_missing") == 0)).drop("n_missing")


def split_standardise(
    positioned: DataFrame, test_ratio: float = 0.5, layout: Layout | None = None
) -> DataFrame:
    """Rows with ``split`` and the value scaled by the train part's mean and spread."""
    layout = Layout.of(positioned, layout)
    sizes = usable(sizing(positioned, test_ratio))
    rows = attach(halo_blocks(positioned, layout), sizes, layout)
    return rows.select(
        *KEYS,
        "ts",
        "pos",
        "n",
        "cut",
        "lags",
        "window",
        F.when(F.col("pos") < F.col("cut"), "train").otherwise("test").alias("split"),
        "value",
        ((F.col("value") - F.col("mean")) / F.col("spread")).alias("scaled"),
    )


def linear_coefficients(
    positioned: DataFrame, sizes: DataFrame, layout: Layout, reach: int = MAX_LAGS
) -> DataFrame:
    """Least-squares ``coefficients`` [lag 1.., constant] of every group, in one job.

    A group that cannot be solved (an infinite value, say) has an ``error`` instead of coefficients.
    """
    blocks = attach(halo_blocks(positioned, layout, before=reach), sizes, layout)
    train = blocks.where(F.col("pos") < F.col("cut"))

    def kernel(rows: pd.DataFrame) -> np.ndarray:
        lags = int(rows["lags"].iloc[0])
        z = (rows["value"].to_numpy() - rows["mean"].iloc[0]) / rows["spread"].iloc[0]
        core = rows["core"].to_numpy()
        start = max(int(np.argmax(core)), lags - int(rows["pos"].iloc[0]))
        stop = int(np.argmax(core)) + int(core.sum())
        if not core.any() or start >= stop:
            return np.zeros((lags + 2) * (lags + 3) // 2)
        columns = [z[start:stop]]
        columns += [z[start - i : stop - i] for i in range(1, lags + 1)]
        columns.append(np.ones(stop - start))
        return gram(np.column_stack(columns))

    sums = block_sums(train, ["value", "mean", "spread", "lags"], kernel, layout)

    def solve(batches):
        for batch in batches:
            found = [_solved(np.asarray(s)) for s in batch["sums"]]
            yield batch[["series_id", "variable", "n"]].assign(
                coefficients=[f[0] for f in found], error=[f[1] for f in found]
            )

    return sums.mapInPandas(
        solve,
        "series_id string, variable string, n bigint, coefficients array<double>, error string",
    )


def _solved(sums: np.ndarray) -> tuple[np.ndarray | None, str | None]:
    if not np.isfinite(sums).all():
        return None, "values that are not finite"
    try:
        return solve_normal(from_triangle(sums))[0], None
    except np.linalg.LinAlgError as error:
        return None, str(error)


def fit_linear(
    positioned: DataFrame,
    test_ratio: float = 0.5,
    lags: int | None = None,
    layout: Layout | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per usable group: its sizes, scaling and ``coefficients``, or the ``error`` of its fit."""
    layout = Layout.of(positioned, layout)
    sizes = materialize(usable(sizing(positioned, test_ratio, lags)) if sizes is None else sizes)
    reach = MAX_LAGS if lags is None else lags
    beta = linear_coefficients(positioned, sizes, layout, reach).drop("n")
    return materialize(sizes.join(beta, KEYS))


def _lagged(positioned: DataFrame, values: DataFrame, layout: Layout, reach: int) -> DataFrame:
    """Scaled rows with their lags, kept where all lags lie in the row's own split."""
    blocks = attach(halo_blocks(positioned, layout, before=reach), values, layout)
    scaled = blocks.withColumn("scaled", (F.col("value") - F.col("mean")) / F.col("spread"))
    lagged = scaled.withColumn("past", lag_columns(F.col("scaled"), reach))
    in_split = F.when(F.col("pos") < F.col("cut"), F.col("pos")).otherwise(
        F.col("pos") - F.col("cut")
    )
    return (
        lagged.withColumn("spos", in_split)
        .where(F.col("core") & (F.col("spos") >= F.col("lags")))
        .withColumn("past", F.slice("past", F.lit(1), F.col("lags")))
        .withColumn("is_train", F.col("pos") < F.col("cut"))
    )


_INPUT = [*KEYS, "ts", "pos", "n", "cut", "lags", "window", "spos", "is_train", "value"]
_RESIDUAL = [*_INPUT, "resid"]


def apply_linear(
    positioned: DataFrame, fits: DataFrame, layout: Layout, reach: int = MAX_LAGS
) -> DataFrame:
    """Residuals of the groups whose fit went well, on rows with a full past in their own split."""
    rows = _lagged(positioned, fits.where("error is null").drop("error"), layout, reach)
    products = F.zip_with("past", F.slice("coefficients", F.lit(1), F.col("lags")),
                          lambda z, c: z * c)
    constant = F.element_at("coefficients", F.col("lags") + 1)
    forecast = F.aggregate(products, F.lit(0.0), lambda total, p: total + p) + constant
    return rows.withColumn("resid", F.col("scaled") - forecast).select(*_RESIDUAL)


def forecast_residuals(
    positioned: DataFrame,
    test_ratio: float = 0.5,
    forecaster: str = "linear",
    lags: int | None = None,
    layout: Layout | None = None,
    trees: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Residuals (see :func:`residuals`), and (series_id, variable, error) of fits that failed."""
    layout = Layout.of(positioned, layout)
    reach = MAX_LAGS if lags is None else lags
    if forecaster == "linear":
        fits = fit_linear(positioned, test_ratio, lags, layout)
        errors = fits.where("error is not null").select(*KEYS, "error")
        return apply_linear(positioned, fits, layout, reach), errors
    if forecaster != "gbt":
        raise ValueError(f"unknown forecaster: {forecaster!r}; choose linear or gbt")
    sizes = usable(sizing(positioned, test_ratio, lags))
    # written before the number is used: it must not change from one read to the next
    numbered = materialize(sizes.withColumn("fit", F.monotonically_increasing_id()))
    rest, failed = _boosted(_lagged(positioned, numbered, layout, reach), trees)
    told = positioned.sparkSession.createDataFrame(failed, "fit bigint, error string")
    return rest, numbered.join(told, "fit").select(*KEYS, "error")


def residuals(
    positioned: DataFrame,
    test_ratio: float = 0.5,
    forecaster: str = "linear",
    lags: int | None = None,
    layout: Layout | None = None,
    trees: int = 100,
) -> DataFrame:
    """Scaled value minus its one-step forecast, on train and test rows with a full past.

    ``linear`` solves all groups in one job; ``gbt`` trains boosted trees, one distributed fit per
    variable. The fit is done once per variable and shared by all scorers. A group whose fit fails
    has no residuals.
    """
    return forecast_residuals(positioned, test_ratio, forecaster, lags, layout, trees)[0]


def _boosted(rows: DataFrame, trees: int) -> tuple[DataFrame, list[tuple[int, str]]]:
    """One distributed boosted-tree fit per variable, for panels of a few large variables.

    The rows are written in one folder per variable, so a fit reads only its own files. A few fits
    run at a time, and each writes its residuals; the plan of the result does not grow with them.
    A fit that fails (a variable without train rows, say) is told, the others go on.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/tidepanel-{uuid.uuid4().hex}"
    (
        rows.select(*_INPUT, array_to_vector("past").alias("features"), "scaled", "fit")
        .write.partitionBy("fit")
        .parquet(f"{folder}/rows")
    )
    written = spark.read.schema(_schema(rows)).parquet(f"{folder}/rows")
    fits = [r["fit"] for r in written.select("fit").distinct().collect()]
    empty = written.withColumn("resid", F.lit(0.0)).select(*_RESIDUAL)
    if not fits:
        return empty, []

    def run(fit: int) -> tuple[int, str] | None:
        try:
            fit_one(fit)
        except Exception as error:  # noqa: BLE001 - the variable's note says what went wrong
            return fit, str(error).splitlines()[0][:200]

    def fit_one(fit: int) -> None:
        mine = written.where(F.col("fit") == fit)
        model = GBTRegressor(
            featuresCol="features",
            labelCol="scaled",
            predictionCol="forecast",
            maxIter=trees,
            stepSize=0.1,
            maxDepth=5,
            minInstancesPerNode=20,
            seed=SEED,
        ).fit(mine.where("is_train"))
        (
            model.transform(mine)
            .withColumn("resid", F.col("scaled") - F.col("forecast"))
            .select(*_RESIDUAL)
            .write.parquet(f"{folder}/residuals/fit={fit}")
        )

    with ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        failed = [f for f in pool.map(inheritable_thread_target(spark)(run), fits) if f]
    if len(failed) == len(fits):
        return empty.limit(0), failed
    return spark.read.schema(empty.schema).parquet(f"{folder}/residuals").select(*_RESIDUAL), failed


def _schema(rows: DataFrame) -> StructType:
    """Of the written rows; the folder's name is the last column."""
    known = {f.name: f for f in rows.schema}
    fields = [known[c] for c in _INPUT] + [StructField("features", VectorUDT())]
    return StructType([*fields, known["scaled"], StructField("fit", LongType())])
