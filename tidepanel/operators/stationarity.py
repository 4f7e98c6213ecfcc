"""Unit-root test, test for autocorrelation and their reading."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import tails, texts
from tidepanel.model import KEYS
from tidepanel.operators.grams import block_sums, group_mean, solve_normal
from tidepanel.operators.layout import Layout, attach, halo_blocks
from tidepanel.operators.season import acf
from tidepanel.session import materialize

MIN_ROWS = 10
ALPHA = 0.05
RESULT_COLUMNS = [
    "series_id", "variable", "n", "adf_statistic", "adf_pvalue", "n_lags_used", "n_obs", "critical",
]


def ljung_box(
    positioned: DataFrame, lags: int = 10, layout: Layout | None = None
) -> DataFrame:
    """Portmanteau statistic over the first ``min(lags, n // 5)`` autocorrelations."""
    used = F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(F.col("n") / 5))).cast("bigint")
    terms = (
        acf(positioned, lags, layout)
        .withColumn("lb_lags", used)
        .where((F.col("lag") >= 1) & (F.col("lag") <= F.col("lb_lags")))
    )
    summed = terms.groupBy(*KEYS, "n", "lb_lags").agg(
        F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("__s")
    )
    statistic = F.col("n") * (F.col("n") + 2) * F.col("__s")
    scored = summed.withColumn("lb_statistic", statistic)
    return scored.select(
        *KEYS,
        "n",
        "lb_lags",
        "lb_statistic",
        tails.chi_square_tail(F.col("lb_statistic"), F.col("lb_lags")).alias("lb_pvalue"),
    )


def lag_limit(n: int) -> int:
    """Largest number of lagged differences tried for a series of n rows."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)


def _unit_root_design(y: np.ndarray, start: int, stop: int, lags: int) -> np.ndarray:
    """Rows start..stop-1 of [difference, level before, 1, lagged differences]."""
    step = np.diff(y, prepend=np.nan)
    columns = [step[start:stop], y[start - 1 : stop - 1], np.ones(stop - start)]
    columns += [step[start - i : stop - i] for i in range(1, lags + 1)]
    return np.column_stack(columns)


def _criterion(rss: float, rows: int, parameters: int) -> float:
    rss = max(rss, 1e-300)
    return rows * (math.log(2 * math.pi) + math.log(rss / rows) + 1) + 2 * parameters


def _lag_sums(y: np.ndarray, start: int, stop: int, lags: int) -> np.ndarray:
    """Sums over rows start..stop-1 from which the whole system follows, 2 * lags + 4 of them.

    Of the difference and of the level before, each with the differences 0..lags rows back; then the
    squares and the sum of the level before.
    """
    step = np.diff(y, prepend=np.nan)
    now, before = step[start:stop], y[start - 1 : stop - 1]
    past = [step[start - i : stop - i] for i in range(lags + 1)]
    return np.array([now @ p for p in past] + [before @ p for p in past] + [before @ before, before.sum()])


def unit_root_system(sums: np.ndarray, head: np.ndarray, tail: np.ndarray, rows: int) -> np.ndarray:
    """X'X of [difference, level before, 1, lagged differences] over the rows that all lags allow.

    Products of two lagged differences depend on their distance but for the edges: going one row back
    on both sides adds a pair from the first rows and takes one from the last. So the first row of
    products, the first and the last levels (``head``, ``tail``, one more than lags) give all of them.
    """
    lags = len(head) - 1
    own, levels = sums[: lags + 1], sums[lags + 1 : 2 * lags + 2]
    first, last = np.diff(head)[::-1], np.diff(tail)[::-1]
    steps = np.zeros((lags + 1, lags + 1))
    steps[0] = own
    edges = np.outer(first, first) - np.outer(last, last)
    for i in range(lags):
        steps[i + 1, i + 1 :] = steps[i, i:lags] + edges[i, i:]
    steps = np.triu(steps) + np.triu(steps, 1).T
    # sums of differences telescope
    totals = tail[::-1] - head[::-1]
    system = np.empty((lags + 3, lags + 3))
    order = [0, *range(3, lags + 3)]
    system[np.ix_(order, order)] = steps
    system[1, order] = system[order, 1] = levels
    system[2, order] = system[order, 2] = totals
    system[1, 1], system[1, 2], system[2, 1], system[2, 2] = sums[-2], sums[-1], sums[-1], rows
    return system


def residual_squares(system: np.ndarray) -> list[float]:
    """Residual sum of squares with 0, 1, .. lagged differences, all from one Cholesky factor.

    The factor of the first columns is the corner of the factor of all, so each further lag only
    takes the square of one more projection. A system that is singular is solved lag by lag.
    """
    target, xtx = system[0], system[1:, 1:]
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    try:
        factor = np.linalg.cholesky(xtx / np.outer(scale, scale))
        if np.diag(factor).min() > 1e-6:
            # rows of the inverse factor times the target, one after the other
            projections = np.linalg.solve(factor, target[1:] / scale)
            return list(np.maximum(target[0] - np.cumsum(projections**2), 0.0)[1:])
    except np.linalg.LinAlgError:
        pass
    return [solve_normal(system[: k + 1, : k + 1])[1] for k in range(2, len(system))]


def _unit_root(n: int, sums: np.ndarray, head: np.ndarray, tail: np.ndarray) -> dict | None:
    """Choose the lag by AIC on the common rows, then refit on all rows that lag allows."""
    limit = len(head) - 1
    rows = n - 1 - limit
    whole = unit_root_system(sums, head, tail, rows)
    scores = [
        (_criterion(rss, rows, lags + 2), lags) for lags, rss in enumerate(residual_squares(whole))
    ]
    best = min(scores)[1]
    chosen = whole[: best + 3, : best + 3]
    if best < limit:
        first_rows = _unit_root_design(head, best + 1, limit + 1, best)
        chosen = chosen + first_rows.T @ first_rows
    used = n - 1 - best
    beta, rss, inverse = solve_normal(chosen)
    freedom = used - (best + 2)
    variance = rss / freedom if freedom > 0 else float("nan")
    spread = math.sqrt(variance * inverse[0, 0])
    if not spread > 0:
        return None
    tau = float(beta[0] / spread)
    return {
        "adf_statistic": tau,
        "adf_pvalue": tails.unit_root_pvalue(tau),
        "n_lags_used": best,
        "n_obs": used,
        "critical": tails.unit_root_critical(used),
    }


def adf(
    positioned: DataFrame, max_lag: int | None = None, layout: Layout | None = None
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC.

    One pass: each block returns sums of products, two for each lag; the first and last rows of each
    series ride along, and a system of at most a few hundred unknowns is solved per group.
    """
    layout = Layout.of(positioned, layout)
    usable = positioned.where(F.col("n") >= MIN_ROWS)
    # from the series themselves: the layout decides how the work is cut up, never the result
    longest = usable.agg(F.max("n")).first()[0] or MIN_ROWS
    reach = lag_limit(longest) if max_lag is None else min(lag_limit(longest), max_lag)
    means = materialize(group_mean(usable)) if layout.blocked else group_mean(usable)
    blocks = halo_blocks(usable, layout, before=reach + 1)
    blocks = attach(blocks, means, layout)

    def limit_of(n: int) -> int:
        return min(lag_limit(n), reach)

    def kernel(rows: pd.DataFrame) -> np.ndarray:
        n = int(rows["n"].iloc[0])
        limit = limit_of(n)
        y = rows["value"].to_numpy() - rows["mean"].iloc[0]
        offset = int(rows["pos"].iloc[0])
        core = rows["core"].to_numpy()
        first = max(int(np.argmax(core)), limit + 1 - offset)
        last = int(np.argmax(core)) + int(core.sum())
        if first >= last:
            return np.zeros(2 * limit + 4)
        return _lag_sums(y, first, last, limit)

    sums = block_sums(blocks, ["value", "mean"], kernel, layout)
    edges = (
        usable.where((F.col("pos") <= reach) | (F.col("pos") >= F.col("n") - 1 - reach))
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("h"))
        .select(*KEYS, F.transform("h", lambda r: r["value"]).alias("edges"))
    )

    def solve(batches):
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                n = int(row.n)
                y, limit = np.asarray(row.edges) - row.mean, limit_of(n)
                result = _unit_root(n, np.asarray(row.sums), y[: limit + 1], y[len(y) - limit - 1 :])
                if result is not None:
                    found.append(
                        {"series_id": row.series_id, "variable": row.variable, "n": n, **result}
                    )
            yield pd.DataFrame(found, columns=RESULT_COLUMNS)

    ready = sums.join(edges, KEYS).join(means.drop("n"), KEYS)
    return ready.mapInPandas(
        solve,
        "series_id string, variable string, n bigint, adf_statistic double, adf_pvalue double, "
        "n_lags_used bigint, n_obs bigint, critical map<string,double>",
    )


def stationarity(
    positioned: DataFrame,
    ljungbox_lags: int = 10,
    max_lag: int | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Both tests per variable with a one-line reading. Series too short to test are left out."""
    layout = Layout.of(positioned, layout)
    unit_root = adf(positioned, max_lag, layout)
    portmanteau = ljung_box(positioned, ljungbox_lags, layout).drop("n")
    joined = unit_root.join(portmanteau, KEYS, "left")
    is_stationary = F.col("adf_pvalue") < ALPHA
    correlated = F.col("lb_pvalue") < ALPHA
    reading = F.concat(
        F.when(is_stationary, texts.STATIONARY_YES).otherwise(texts.STATIONARY_NO),
        F.when(correlated, texts.AUTOCORRELATED_YES)
        .when(~correlated, texts.AUTOCORRELATED_NO)
        .otherwise(""),
    )
    return joined.select(
        *KEYS,
        "adf_statistic",
        "adf_pvalue",
        F.col("critical").alias("adf_critical_values"),
        is_stationary.cast("int").alias("is_stationary"),
        "n_lags_used",
        F.col("lb_pvalue").alias("ljungbox_pvalue"),
        correlated.cast("int").alias("has_autocorrelation"),
        reading.alias("interpretation"),
    )


def stationarity_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("series_id").agg(
        F.sum("is_stationary").cast("bigint").alias("n_stationary"),
        F.sum(1 - F.col("is_stationary")).cast("bigint").alias("n_nonstationary"),
        F.count(F.lit(1)).alias("n_variables"),
    )
