"""Sums of products over lags, built block by block and added up in Spark.

Every statistic that needs "this row times the row k before it" (autocorrelation, lag regressions,
unit-root test) comes down to a small table of sums per group. A task sees one block plus its halo
and returns its part of the sums; the parts are added with an ordinary aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators.layout import Layout, attach, halo_blocks

SLICE_ROWS = 8192


def group_mean(positioned: DataFrame, value: str = "value") -> DataFrame:
    return positioned.groupBy(*KEYS).agg(F.first("n").alias("n"), F.avg(value).alias("mean"))


def add_up(parts: DataFrame, column: str, layout: Layout, keys: list[str] = KEYS) -> DataFrame:
    """Element-wise sum of an array column per group. With single blocks there is nothing to add."""
    if not layout.blocked:
        return parts.select(*keys, "n", column)
    cells = parts.select(*keys, "n", F.posexplode(column).alias("__i", "__v"))
    sums = cells.groupBy(*keys, "n", "__i").agg(F.sum("__v").alias("__v"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__v")))
    return sums.groupBy(*keys, "n").agg(F.transform(ordered, lambda c: c["__v"]).alias(column))


def block_sums(
    blocks: DataFrame,
    columns: list[str],
    kernel: Callable[[pd.DataFrame], np.ndarray],
    layout: Layout,
) -> DataFrame:
    """Run ``kernel`` on each block (rows ordered by position) and add its sums up per group."""
    schema = "series_id string, variable string, n bigint, sums array<double>"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        sums = kernel(rows)
        return pd.DataFrame(
            {"series_id": [key[0]], "variable": [key[1]], "n": [rows["n"].iloc[0]], "sums": [sums]}
        )

    wanted = list(dict.fromkeys([*KEYS, "block", "pos", "n", "core", *columns]))
    parts = blocks.select(*wanted).groupBy(*KEYS, "block").applyInPandas(run, schema)
    return add_up(parts, "sums", layout)


def lag_products(positioned: DataFrame, max_lag: int, layout: Layout) -> DataFrame:
    """Per group: array of sum(x[t] * x[t-k]) for k = 0..max_lag, x being the demeaned value."""
    blocks = halo_blocks(positioned, layout, before=max_lag)
    blocks = attach(blocks, group_mean(positioned), layout)

    def kernel(rows: pd.DataFrame) -> np.ndarray:
        x = rows["value"].to_numpy() - rows["mean"].iloc[0]
        first = int(np.argmax(rows["core"].to_numpy()))
        last = int(rows["core"].to_numpy().sum()) + first
        sums = np.zeros(max_lag + 1)
        for k in range(max_lag + 1):
            start = max(first, k)
            if start < last:
                sums[k] = x[start:last] @ x[start - k : last - k]
        return sums

    return block_sums(blocks, ["value", "mean"], kernel, layout)


def gram(design: np.ndarray) -> np.ndarray:
    """Upper triangle of design' * design, row by row; built in slices to keep memory small."""
    width = design.shape[1]
    total = np.zeros((width, width))
    for start in range(0, len(design), SLICE_ROWS):
        part = design[start : start + SLICE_ROWS]
        total += part.T @ part
    return total[np.triu_indices(width)]


def from_triangle(values: np.ndarray) -> np.ndarray:
    width = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    square = np.zeros((width, width))
    square[np.triu_indices(width)] = values
    return square + np.triu(square, 1).T


def solve_normal(gram_matrix: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares from the Gram matrix of [target, regressors].

    Returns coefficients, residual sum of squares and the inverse of X'X. Columns are scaled to
    unit length first, which keeps the small system well conditioned.
    """
    xty, xtx, yty = gram_matrix[1:, 0], gram_matrix[1:, 1:], gram_matrix[0, 0]
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    scaled = xtx / np.outer(scale, scale)
    inverse = np.linalg.pinv(scaled, rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ xty
    return beta, max(float(yty - beta @ xty), 0.0), inverse
