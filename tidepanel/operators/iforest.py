"""Isolation forest per variable (Liu, Ting and Zhou 2008) on moving-window features.

All choices come from a small integer hash of (seed, group, tree, ...), so a repeated task repeats
them, and so does anything else that can do integer arithmetic. A tree's sample are the first distinct
of its drawn positions. Short groups send their rows once and grow all trees in one task; of long ones
the draws are spread over parts of the trees, and only drawn rows travel. The trees of a part grow
together, level by level. Rows are scored block by block, with the trees of their variable beside them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.model import KEYS
from tidepanel.operators.layout import Layout, exact_quantiles, halo_blocks, join_groups, per_block, settle
from tidepanel.operators.windows import rolling_features
from tidepanel.session import materialize

FEATURES = ["value", "dev_from_rolling_mean", "rolling_std", "diff"]
SAMPLE_ROWS = 256
TREES = 200
EULER = 0.5772156649
#: Groups up to so many rows are sent whole; the trees of longer ones grow in so many parts.
SHORT_ROWS = 2048
PARTS = 8
#: Rows that walk down all trees at once.
SLICE_ROWS = 2048
#: Codes of nodes: the root is 1, the children of i are 2 i and 2 i + 1.
CODES = 1024
#: Numbers hashed for cuts start here, those for draws at 0.
CUT_NUMBERS = 1 << 20

_FOREST = (
    "series_id string, variable string, part int, feature array<int>, threshold array<double>, "
    "child array<int>, length array<double>, root array<int>"
)


def average_path(rows: int) -> float:
    """Mean depth at which an unsuccessful search in a random tree of ``rows`` rows ends."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + EULER) - 2.0 * (rows - 1.0) / rows


_AVERAGE_PATH = np.array([average_path(m) for m in range(SAMPLE_ROWS + 1)])


def mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit number with its bits spread over all of it, as unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def tree_keys(seed: int, series_id: str, variable: str, trees: np.ndarray) -> np.ndarray:
    name = "\x1f".join([str(seed), series_id, variable])
    group = np.uint64(int(hashlib.md5(name.encode()).hexdigest()[:8], 16))
    return mix32(mix32(trees.astype(np.uint64)) ^ group)


def _pairs(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each key and number (broadcast against each other)."""
    twice = numbers.astype(np.uint64) * np.uint64(2)
    return mix32(keys ^ mix32(twice)), mix32(keys ^ mix32(twice + np.uint64(1)))


def sample_positions(keys: np.ndarray, n: int) -> np.ndarray:
    """For each tree the positions of its sample, drawn without replacement; all, if they are few."""
    if n <= SAMPLE_ROWS:
        return np.tile(np.arange(n), (len(keys), 1))
    draws = 2 * SAMPLE_ROWS
    while True:
        h1, h2 = _pairs(keys[:, None], np.arange(draws)[None, :])
        share = (h1 * np.uint64(1 << 21) + (h2 >> np.uint64(11))).astype(np.float64) / float(1 << 53)
        drawn = np.floor(share * n).astype(np.int64)
        first = [np.sort(np.unique(row, return_index=True)[1])[:SAMPLE_ROWS] for row in drawn]
        if min(map(len, first)) == SAMPLE_ROWS:
            return np.stack([row[at] for row, at in zip(drawn, first)])
        draws *= 2


def _trees_of(part: int, parts: int, trees: int) -> np.ndarray:
    return np.arange(trees * part // parts, trees * (part + 1) // parts)


def grow(points: np.ndarray, samples: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Trees over rows ``samples`` (one row of indices per tree) of ``points``, all together.

    Random cuts until a node has one row, no spread, or the depth limit. Nodes of a tree are in the
    order of their codes, so a right child follows its left one.
    """
    trees, size = samples.shape
    limit = math.ceil(math.log2(max(size, 2)))
    tree = np.repeat(np.arange(trees), size)
    x, code = points[samples.ravel()], np.ones(trees * size, dtype=np.int64)
    nodes = []
    for depth in range(limit + 1):
        if not len(x):
            break
        order = np.argsort(tree * CODES + code, kind="stable")
        tree, code, x = tree[order], code[order], x[order]
        name = tree * CODES + code
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        counts = np.diff(np.append(starts, len(name)))
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        opened = high > low
        width = opened.sum(axis=1)
        inner = (counts > 1) & (width > 0) & (depth < limit)
        h1, h2 = _pairs(keys[tree[starts]], CUT_NUMBERS + code[starts])
        nth = ((h1 * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + 1
        chosen = np.argmax(np.cumsum(opened, axis=1) == nth[:, None], axis=1)
        at = np.arange(len(starts))
        lo, hi = low[at, chosen], high[at, chosen]
        cut = lo + h2.astype(np.float64) / float(1 << 32) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        nodes.append(
            (name[starts], np.where(inner, chosen, -1), np.where(inner, cut, 0.0),
             np.where(inner, 0.0, depth + _AVERAGE_PATH[counts]))
        )
        mine = np.repeat(at, counts)
        goes = inner[mine]
        right = x[np.arange(len(x)), chosen[mine]] > cut[mine]
        tree, code, x = tree[goes], (2 * code + right)[goes], x[goes]
    name, feature, threshold, length = (np.concatenate(c) for c in zip(*nodes))
    order = np.argsort(name)
    name, feature = name[order], feature[order]
    below = (name // CODES) * CODES + 2 * (name % CODES)
    child = np.where(feature >= 0, np.searchsorted(name, below), -1)
    return {
        "feature": feature, "threshold": threshold[order], "child": child, "length": length[order],
        "root": np.searchsorted(name, np.arange(trees) * CODES + 1),
    }


def grow_forest(features: DataFrame, sizes: DataFrame, trees: int, seed: int) -> DataFrame:
    """One row per group and part of its trees, the nodes as arrays."""
    parts = min(PARTS, trees)
    # of long groups each part of the trees draws by itself
    jobs = sizes.where(F.col("n") > SHORT_ROWS).select(
        *KEYS, "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    )

    def draw(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                mine = _trees_of(row.part, parts, trees)
                keys = tree_keys(seed, row.series_id, row.variable, mine)
                wanted = np.unique(sample_positions(keys, int(row.n)))
                yield pd.DataFrame(
                    {"series_id": row.series_id, "variable": row.variable, "part": row.part, "pos": wanted}
                )

    wanted = jobs.repartition(*KEYS, "part").mapInPandas(
        draw, "series_id string, variable string, part int, pos bigint"
    )
    rows = features.select(*KEYS, "pos", "n", *FEATURES)
    short = rows.where(F.col("n") <= SHORT_ROWS).withColumn("part", F.lit(0))
    drawn = rows.where(F.col("n") > SHORT_ROWS).join(wanted, KEYS + ["pos"])

    def grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos", kind="stable"), int(rows["n"].iloc[0])
        mine = _trees_of(key[2], parts, trees) if n > SHORT_ROWS else np.arange(trees)
        keys = tree_keys(seed, key[0], key[1], mine)
        samples = np.searchsorted(rows["pos"].to_numpy(), sample_positions(keys, n))
        nodes = grow(rows[FEATURES].to_numpy(dtype=float), samples, keys)
        return pd.DataFrame([{"series_id": key[0], "variable": key[1], "part": key[2], **nodes}])

    sample = short.unionByName(drawn.select(*short.columns))
    return sample.groupBy(*KEYS, "part").applyInPandas(grown, _FOREST)


def depths(points: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length of each row over the trees; all trees at once for a slice of rows."""
    total = np.empty(len(points))
    feature, child = forest["feature"], forest["child"]
    for start in range(0, len(points), SLICE_ROWS):
        x = points[start : start + SLICE_ROWS]
        node = np.tile(forest["root"], (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            right = x[row, np.maximum(feature[node], 0)] > forest["threshold"][node]
            node = np.where(inner, child[node] + right, node)
        total[start : start + len(x)] = forest["length"][node].mean(axis=1)
    return total


def _joined(parts: pd.DataFrame) -> dict[str, np.ndarray]:
    """The nodes of all parts of a forest behind each other."""
    parts = parts.sort_values("part")
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts["feature"]])])
    forest = {c: np.concatenate([np.asarray(x) for x in parts[c]]) for c in ("feature", "threshold", "length")}
    for c in ("child", "root"):
        forest[c] = np.concatenate([np.asarray(x, dtype=np.int64) + a for x, a in zip(parts[c], at)])
    return forest


def forest_scores(
    features: DataFrame, forest: DataFrame, sizes: DataFrame, layout: Layout
) -> DataFrame:
    """``raw_score`` 2^(-mean path / average path) of every row."""
    blocks = halo_blocks(features.drop("block", "core"), layout).select(
        *KEYS, "block", "ts", "pos", "n", *FEATURES
    )
    # the trees of a group go to its blocks in two steps, so that no task writes them all
    trees = per_block(forest.join(sizes.select(*KEYS, "n"), KEYS), layout, spread=True).drop("n")

    def score(key: tuple, rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = rows[["series_id", "variable", "ts", "pos", "n"]]
        if not len(rows):
            return out.assign(raw_score=[])
        usual = average_path(min(SAMPLE_ROWS, int(rows["n"].iloc[0])))
        path = depths(rows[FEATURES].to_numpy(dtype=float), _joined(mine))
        return out.assign(raw_score=2.0 ** (-path / max(usual, 1e-300)))

    of = {name: f"of_{name}" for name in [*KEYS, "block"]}
    left = blocks.groupBy(*of)
    right = trees.withColumnsRenamed(of).groupBy(*of.values())
    return left.cogroup(right).applyInPandas(
        score,
        "series_id string, variable string, ts timestamp_ntz, pos bigint, n bigint, raw_score double",
    )


def detect_isolation_forest(
    positioned: DataFrame,
    contamination: float = 0.05,
    window: int = 10,
    seed: int = 42,
    trees: int = TREES,
    layout: Layout | None = None,
) -> DataFrame:
    """Scores shifted so that the worst ``contamination`` share is above zero, and flags.

    Works on all rows, train and test. Variables that still have missing values are left out.
    """
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must lie in (0, 0.5]")
    layout = Layout.of(positioned, layout)
    sizes = positioned.groupBy(*KEYS).agg(
        F.first("n").alias("n"), F.count_if(F.col("value").isNull()).alias("__gaps")
    )
    sizes = materialize(sizes.where("__gaps = 0").drop("__gaps"))
    whole = join_groups(positioned, sizes.select(*KEYS), KEYS, layout, "left_semi")
    features = materialize(rolling_features(whole, layout, window))
    forest = materialize(grow_forest(features, sizes, trees, seed))
    raw = materialize(forest_scores(features, forest, sizes, layout))
    limits = exact_quantiles(raw, "raw_score", [1.0 - contamination], layout)
    shifted = join_groups(raw, settle(limits, layout), KEYS, layout).withColumn(
        "score", F.col("raw_score") - F.col("quantiles")[0]
    )
    return shifted.select(
        *KEYS,
        F.lit("iforest").alias("scorer"),
        "ts",
        "pos",
        "n",
        "score",
        (F.col("score") > 0).cast("int").alias("is_anomaly"),
    )


def combine_forest(scores: DataFrame) -> DataFrame:
    """An instant is flagged if any variable is."""
    return scores.groupBy("series_id", "ts").agg(
        F.max("is_anomaly").alias("any_anomaly_iforest")
    )
