import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel import build_session  # noqa: E402
from tidepanel.operators.layout import Layout  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


START = dt.datetime(2024, 1, 1)

PLAIN = Layout(max_group_rows=1, block_rows=1 << 17)


def blocked(rows: int) -> Layout:
    """A layout that treats every group as too large for one task."""
    return Layout(max_group_rows=1 << 40, block_rows=rows)


def panel_of(spark, series: dict[str, list], step_minutes: int = 60):
    """Positioned panel with the variables given as lists (None: missing)."""
    rows = [
        ("s", name, START + dt.timedelta(minutes=step_minutes * i), i, len(values), _plain(v))
        for name, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows,
        "series_id string, variable string, ts timestamp_ntz, pos bigint, n bigint, value double",
    )


def _plain(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return None
    return float(value)


def sorted_frame(df, by=("variable", "pos")) -> pd.DataFrame:
    keys = [c for c in by if c in df.columns]
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def wavy(n: int, seed: int = 0, period: int = 24, slope: float = 0.01) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return slope * t + np.sin(2 * np.pi * t / period) * 2 + rng.normal(0, 0.3, n)
