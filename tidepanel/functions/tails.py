"""Tail probabilities and published test constants. Tiny per-group arithmetic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# --- fixed values: unit-root p-value (MacKinnon 1994, constant only) --------------------------
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_SWITCH = -1.61
TAU_SMALL = [2.1659, 1.4412, 0.038269]
TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]

# --- fixed values: unit-root critical values (MacKinnon 2010, constant only) ------------------
TAU_CRITICAL = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def unit_root_pvalue(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = TAU_SMALL if tau <= TAU_SWITCH else TAU_LARGE
    return normal_cdf(sum(c * tau**i for i, c in enumerate(terms)))


def unit_root_critical(n: int) -> dict[str, float]:
    return {k: sum(c / n**i for i, c in enumerate(b)) for k, b in TAU_CRITICAL.items()}


def chi_square_tail(q: Column, dof: Column) -> Column:
    """P(X > q) in closed form. Even degrees of freedom stay in SQL; odd ones need erfc."""
    half = q / 2
    steps = F.sequence(F.lit(0), (F.greatest(dof, F.lit(2)) / 2).cast("int") - 1)
    terms = F.aggregate(
        steps, F.lit(0.0), lambda acc, i: acc + F.pow(half, i) / F.factorial(i).cast("double")
    )
    return F.when(dof % 2 == 0, F.exp(-half) * terms).otherwise(_odd_tail(q, dof))


@F.pandas_udf(DoubleType())
def _odd_tail(q: pd.Series, dof: pd.Series) -> pd.Series:
    def tail(x: float, m: float) -> float | None:
        if x is None or math.isnan(x) or int(m) % 2 == 0:
            return None
        term, total = 1.0, 0.0
        for i in range((int(m) - 1) // 2):
            term = term * x / (2 * i + 1) if i else 1.0
            total += term
        return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total

    return pd.Series([tail(x, m) for x, m in zip(q, dof)], dtype="float64")
