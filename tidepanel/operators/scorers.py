"""Scores of forecast residuals: size, distance to usual patterns, distance of distributions.

A scorer has two halves. ``fit`` turns the residuals of the train part into tables (the scorer's
state, none for the size). ``score`` takes residuals, of the test part or of rows that came later, and
such tables, and returns ``(series_id, variable, scorer, ts, pos, n, score, error)``. A window's score
is stamped at its last row; the first rows, which have no whole window, get none (or, with
``window_agg``, the mean of the windows over each row). Where the computation of one group fails, the
group has a row with the ``error`` instead of scores, and the other groups keep theirs.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import texts
from tidepanel.model import KEYS
from tidepanel.operators.forecast import MAX_WINDOW
from tidepanel.operators.layout import (
    Layout,
    attach,
    block_window,
    halo_blocks,
    per_block,
    running,
    running_at,
)
from tidepanel.session import materialize

SCORE_COLUMNS = [*KEYS, "scorer", "ts", "pos", "n", "score"]
ROUNDS_PER_JOB = 5
MAX_BROADCAST_GROUPS = 10_000
SLICE_WINDOWS = 16_384


State = dict[str, DataFrame]


def _no_error() -> Column:
    return F.lit(None).cast("string").alias("error")


def _train(residuals: DataFrame) -> DataFrame:
    return residuals.where("is_train")


def _test(residuals: DataFrame) -> DataFrame:
    return residuals.where(~F.col("is_train"))


def _scores_only(scored: DataFrame) -> DataFrame:
    return scored.where("error is null").select(*SCORE_COLUMNS)


def norm_fit(train: DataFrame, layout: Layout) -> State:
    return {}


def norm_score(
    test: DataFrame, state: State, layout: Layout, window_agg: bool = False
) -> DataFrame:
    """Size of the residual. The same with and without ``window_agg``: its windows have one row."""
    size = F.abs("resid")
    return test.where(~F.isnan(size)).select(
        *KEYS, F.lit("norm").alias("scorer"), "ts", "pos", "n", size.alias("score"), _no_error()
    )


def norm_scores(residuals: DataFrame, layout: Layout, window_agg: bool = False) -> DataFrame:
    return _scores_only(norm_score(_test(residuals), {}, layout, window_agg))


def _spread_over_rows(rows: DataFrame, layout: Layout) -> DataFrame:
    """Mean, for each row, of the scores of the windows that cover it."""
    blocks = halo_blocks(rows, layout, after=MAX_WINDOW - 1)
    order = block_window()
    ahead = F.array(*[F.lead("score", i).over(order) for i in range(MAX_WINDOW)])
    mine = F.filter(F.slice(ahead, F.lit(1), F.col("window")), lambda s: s.isNotNull())
    total = F.aggregate(mine, F.lit(0.0), lambda acc, s: acc + s)
    return (
        blocks.withColumn("__mean", F.when(F.size(mine) > 0, total / F.size(mine)))
        .where("core")
        .withColumn("score", F.col("__mean"))
    )


def _finish(rows: DataFrame, scorer: str, layout: Layout, window_agg: bool) -> DataFrame:
    """Known scores of rows without an error, and one row for each block that has one."""
    right = rows.where("error is null")
    scored = _spread_over_rows(right, layout) if window_agg else right
    known = F.col("score").isNotNull() & ~F.isnan("score")
    name = F.lit(scorer).alias("scorer")
    wrong = rows.where("error is not null")
    return scored.where(known).select(*KEYS, name, "ts", "pos", "n", "score", _no_error()).unionByName(
        wrong.select(*KEYS, name, "ts", "pos", "n", F.lit(None).cast("double").alias("score"), "error")
    )


# ---------------------------------------------------------------------------------------------
# Distance of distributions
# ---------------------------------------------------------------------------------------------


def _sizes(signed: bool) -> Column:
    return F.col("resid") if signed else F.abs("resid")


def wasserstein_fit(train: DataFrame, layout: Layout, signed: bool = False) -> State:
    """The train quantile function: distinct residuals ``x`` with running counts and sums up to each."""
    x = _sizes(signed).alias("x")
    known = train.select(*KEYS, "window", x).where(~F.isnan("x"))
    values = known.groupBy(*KEYS, "x", "window").agg(F.count(F.lit(1)).alias("c"))
    ranked = running(
        values, KEYS, "x", {"cnt": F.col("c"), "mass": F.col("c") * F.col("x")}, layout
    )
    return {
        "quantiles": ranked.select(
            *KEYS, "window", "x", "c", "cnt", "mass", F.col("cnt_total").alias("total")
        )
    }


def _integrals(quantiles: DataFrame) -> DataFrame:
    """Per group ``grid``: the integral of the train quantile function up to i/w, i = 0 to w."""
    total, w = F.col("total"), F.col("window").cast("bigint")
    before = F.col("cnt") - F.col("c")
    first = F.floor(before * w / total) + 1
    last = F.floor(F.col("cnt") * w / total)
    edges = (
        quantiles.where(first <= last)
        .withColumn("i", F.explode(F.sequence(first, last)))
        .withColumn(
            "g",
            (F.col("mass") - F.col("c") * F.col("x")
             + (F.col("i") * total / w - before) * F.col("x")) / total,
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "g")))
    return edges.groupBy(*KEYS).agg(
        F.concat(F.array(F.lit(0.0)), F.transform(ordered, lambda e: e["g"])).alias("grid")
    )


def wasserstein_score(
    test: DataFrame, state: State, layout: Layout, window_agg: bool = False, signed: bool = False
) -> DataFrame:
    """First Wasserstein distance between a window's residuals and all train residuals, exact.

    Written over quantiles, the distance is a sum over the window's sorted residuals x_i of the
    integral of |x_i - Q(p)| for p in ((i-1)/w, i/w], with Q the train quantile function. With
    F(x) the share of train residuals up to x and S(x) their sum over the train size, and with the
    integral G of Q at the w+1 points i/w, each term is plain arithmetic. So no window ever meets the
    train residuals themselves: F and S are looked up once per row, in a group of one block by binary
    search, in larger ones by merging rows and train values in buckets of x.
    """
    quantiles = state["quantiles"]
    rows = test.select(*KEYS, "ts", "pos", "n", "window", _sizes(signed).alias("x"))
    known = _integrals(quantiles)
    nothing = F.lit(None).cast("array<double>")
    if layout.blocked:
        found = running_at(quantiles, rows, KEYS, "x", {"cnt": "c", "mass": F.col("c") * F.col("x")}, layout)
        totals = quantiles.groupBy(*KEYS).agg(F.first("total").alias("total"))
        sizes = rows.groupBy(*KEYS).agg(F.first("n").alias("n"))
        known = materialize(
            known.join(totals, KEYS).join(sizes, KEYS).select(
                "*", nothing.alias("xs"), nothing.alias("cnts"), nothing.alias("masses")
            )
        )
        rows = found.select(*rows.columns, F.col("cnt").cast("double").alias("cnt"), "mass")
    else:
        steps = F.array_sort(F.collect_list(F.struct("x", F.col("cnt").cast("double").alias("cnt"), "mass")))
        held = quantiles.groupBy(*KEYS).agg(F.first("total").alias("total"), steps.alias("steps"))
        held = held.select(
            *KEYS,
            "total",
            *[F.col("steps")[c].alias(f"{c}{end}") for c, end in (("x", "s"), ("cnt", "s"), ("mass", "es"))],
        )
        known = known.join(held, KEYS).withColumn("n", F.lit(0))
        none = F.lit(None).cast("double")
        rows = rows.select("*", none.alias("cnt"), none.alias("mass"))
    left = halo_blocks(rows, layout, before=MAX_WINDOW - 1).select(
        *KEYS, "block", "core", "ts", "pos", "n", "window", "x", "cnt", "mass"
    )
    # other names: both sides may come from one table
    of = {name: f"of_{name}" for name in [*KEYS, "block"]}
    right = per_block(known, layout).withColumnsRenamed(of)
    scored = left.groupBy(*of).cogroup(right.groupBy(*of.values())).applyInPandas(
        _transport,
        "series_id string, variable string, ts timestamp_ntz, pos bigint, n bigint, window int, "
        "score double, error string",
    )
    return _finish(scored, "wasserstein", layout, window_agg)


def _transport(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Scores of the windows that end in one block, or its error."""
    out = rows[["series_id", "variable", "ts", "pos", "n", "window"]].assign(score=np.nan, error=None)
    if not len(rows) or not len(known):
        return out[:0]
    try:
        rows = rows.sort_values("pos", kind="stable")
        out = out.loc[rows.index].assign(score=_distances(rows, known.iloc[0]))
        return out[rows["core"].to_numpy()]
    except Exception as error:  # noqa: BLE001 - the group's note says what went wrong
        return out[:1].assign(error=f"{type(error).__name__}: {error}")


def _distances(rows: pd.DataFrame, known: pd.Series) -> np.ndarray:
    """The arithmetic of ``wasserstein_score`` for rows of one block, in order."""
    w, grid = int(rows["window"].iloc[0]), np.asarray(known["grid"])
    score = np.full(len(rows), np.nan)
    if len(rows) < w:
        return score
    x = rows["x"].to_numpy()
    if known["xs"] is None:
        cnt, mass = rows["cnt"].to_numpy(), rows["mass"].to_numpy()
    else:
        at = np.searchsorted(known["xs"], x, side="right")
        cnt, mass = (np.concatenate([[0.0], known[c]])[at] for c in ("cnts", "masses"))
    total = float(known["total"])
    views = [np.lib.stride_tricks.sliding_window_view(c, w) for c in (x, cnt / total, mass / total)]
    low, high = np.arange(w) / w, np.arange(1, w + 1) / w
    for start in range(0, len(views[0]), SLICE_WINDOWS):
        some = slice(start, start + SLICE_WINDOWS)
        order = np.argsort(views[0][some], axis=1, kind="stable")
        x, share, part = (np.take_along_axis(v[some], order, axis=1) for v in views)
        turn = np.clip(share, low, high)
        at_turn = np.where(share <= low, grid[:-1], np.where(share >= high, grid[1:], part))
        below = (turn - low) * x - (at_turn - grid[:-1])
        above = (grid[1:] - at_turn) - (high - turn) * x
        score[w - 1 + start : w - 1 + start + len(x)] = (below + above).sum(axis=1)
    return score


def wasserstein_scores(
    residuals: DataFrame, layout: Layout, window_agg: bool = False, signed: bool = False
) -> DataFrame:
    """Fit on the train rows, score the test rows."""
    state = wasserstein_fit(_train(residuals), layout, signed)
    if layout.blocked:
        state = {name: materialize(table) for name, table in state.items()}
    return _scores_only(wasserstein_score(_test(residuals), state, layout, window_agg, signed))


# ---------------------------------------------------------------------------------------------
# Distance to usual patterns
# ---------------------------------------------------------------------------------------------


def _pack(residuals: DataFrame, layout: Layout, signed: bool) -> DataFrame:
    """One row per block of one split's residuals, as one array, oldest first.

    The residuals of a split are consecutive, and a block carries just the rows before its own that
    its first window needs: so the windows of the array are the windows that end in the block, and
    the rounds below need neither positions nor a shuffle of rows.
    """
    x = _sizes(signed)
    blocks = halo_blocks(residuals, layout, before=MAX_WINDOW - 1)
    if layout.blocked:
        own_start = F.col("block") * layout.block_rows
        blocks = blocks.where(F.col("pos") >= own_start - (F.col("window") - 1))
    ordered = F.array_sort(F.collect_list(F.struct("pos", x.alias("x"))))
    packed = blocks.groupBy(*KEYS, "block", "n", "window").agg(ordered.alias("rows"))
    return packed.select(
        *KEYS,
        "block",
        "n",
        "window",
        F.col("rows")[0]["pos"].alias("first_pos"),
        F.transform("rows", lambda r: r["x"]).alias("x"),
    ).where(F.size("x") >= F.col("window"))


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _moments(batches):
    """Count, sum and sum of squares of the windows of each block, place by place."""
    names = [*KEYS, "n", "window", "total", "square"]
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            x, w = np.asarray(row.x, dtype=float), int(row.window)
            m = len(x) - w + 1
            sums = [x[i : i + m].sum() for i in range(w)]
            squares = [x[i : i + m] @ x[i : i + m] for i in range(w)]
            out.append({**_key(row), "total": [m, *sums], "square": squares})
        yield _frame(out, names)


def _nearer_sums(x: np.ndarray, w: int, whole: np.ndarray, low: np.ndarray, high: np.ndarray):
    """[count, sums..] of the windows nearer to ``low`` and of those nearer to ``high``.

    Which centre is nearer depends on one inner product with the difference of the centres, so the
    windows are never laid out as a table. ``whole`` are the sums of all windows.
    """
    m = len(x) - w + 1
    towards_high = 2 * np.correlate(x, high - low, "valid") > high @ high - low @ low
    second = towards_high.astype(float)
    upper = np.array([second @ x[i : i + m] for i in range(w)])
    count = float(second.sum())
    return [m - count, *(whole - upper)], [count, *upper]


def _window_sums(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x) - w + 1
    return np.array([x[i : i + m].sum() for i in range(w)])


def _settle(max_iter: int):
    """All rounds of groups that lie in one row each, until their centres move no more."""
    names = [*KEYS, "n", "window", "low", "high", "still", "shift"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, w = np.asarray(row.x, dtype=float), int(row.window)
                centres = [np.asarray(row.low), np.asarray(row.high)]
                whole, shift = _window_sums(x, w), np.inf
                for _ in range(max_iter):
                    sums = _nearer_sums(x, w, whole, *centres)
                    new = [np.array(s[1:]) / s[0] if s[0] > 0 else c for s, c in zip(sums, centres)]
                    shift = sum(float((a - b) @ (a - b)) for a, b in zip(new, centres))
                    centres = new
                    if shift <= row.still:
                        break
                out.append({**_key(row), "low": centres[0], "high": centres[1], "still": row.still, "shift": shift})
            yield _frame(out, names)

    return run


def _assign(batches):
    """Count and sum of the windows nearer to either centre, place by place."""
    names = [*KEYS, "n", "window", "low", "high", "still", "s0", "s1"]
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            x, w = np.asarray(row.x, dtype=float), int(row.window)
            s0, s1 = _nearer_sums(x, w, _window_sums(x, w), np.asarray(row.low), np.asarray(row.high))
            out.append(
                {
                    **_key(row),
                    "low": row.low,
                    "high": row.high,
                    "still": row.still,
                    "s0": s0,
                    "s1": s1,
                }
            )
        yield _frame(out, names)


def _key(row) -> dict:
    return {
        "series_id": row.series_id, "variable": row.variable, "n": row.n, "window": row.window
    }


_KEY = "series_id string, variable string, n bigint, window int"


def _added(name: str, places: int) -> Column:
    """Element-wise sum of an array column of bounded length, with map-side partial sums."""
    return F.expr("array(" + ", ".join(f"sum(get({name}, {i}))" for i in range(places)) + ")")


def _centre(sums: str, old: str) -> str:
    """Mean of a cluster from its [count, sums..]; an empty cluster keeps its centre."""
    mean = f"transform(slice({sums}, 2, window), s -> s / get({sums}, 0))"
    return f"IF(get({sums}, 0) > 0, {mean}, {old}) AS {old}2"


def _moved(new: str, old: str) -> str:
    squares = f"zip_with({new}, {old}, (a, b) -> (a - b) * (a - b))"
    return f"aggregate({squares}, 0D, (total, d) -> total + d)"


def _two_means(packed: DataFrame, layout: Layout, max_iter: int, tolerance: float) -> DataFrame:
    """Two centres per group, for all groups at once: a narrow pass and a small sum each round.

    Starts from the mean window one spread below and above, so that every run gives the same
    result, and ends when no group's centres move any more. Several rounds make one job. Where no
    group is cut into blocks a group is one row, and all its rounds run in one pass.
    """
    w = F.col("window")
    train = packed.select(*KEYS, "block", "n", "window", "x")
    totals = (
        train.mapInPandas(_moments, f"{_KEY}, total array<double>, square array<double>")
        .groupBy(*KEYS, "n", "window")
        .agg(
            _added("total", MAX_WINDOW + 1).alias("total"), _added("square", MAX_WINDOW).alias("square")
        )
    )
    count = F.col("total")[0]
    mean = F.transform(F.slice("total", F.lit(2), w), lambda s: s / count)
    square = F.transform(F.slice("square", F.lit(1), w), lambda s: s / count)
    variance = F.zip_with(square, mean, lambda q, m: F.greatest(q - m * m, F.lit(0.0)))
    average = F.aggregate("variance", F.lit(0.0), lambda acc, v: acc + v) / w
    start = totals.select(
        *KEYS, "n", "window", mean.alias("mean"), variance.alias("variance")
    )
    centres = materialize(
        start.select(
            *KEYS,
            "n",
            F.zip_with("mean", "variance", lambda m, v: m - F.sqrt(v)).alias("low"),
            F.zip_with("mean", "variance", lambda m, v: m + F.sqrt(v)).alias("high"),
            (average * tolerance).alias("still"),
        )
    )

    few = centres.count() <= MAX_BROADCAST_GROUPS

    def one_round(current: DataFrame) -> DataFrame:
        # two arrays of at most MAX_WINDOW numbers per group: a counted number of groups bounds them
        beside = (
            train.join(F.broadcast(current.drop("n", "shift")), KEYS)
            if few
            else attach(train, current, layout)
        )
        moved = beside.mapInPandas(
            _assign,
            f"{_KEY}, low array<double>, high array<double>, still double, "
            "s0 array<double>, s1 array<double>",
        )
        sums = moved.groupBy(*KEYS, "n", "window").agg(
            F.expr("first(low) AS low"),
            F.expr("first(high) AS high"),
            F.expr("first(still) AS still"),
            _added("s0", MAX_WINDOW + 1).alias("s0"),
            _added("s1", MAX_WINDOW + 1).alias("s1"),
        )
        return sums.selectExpr("*", _centre("s0", "low"), _centre("s1", "high")).selectExpr(
            *KEYS, "n", "low2 AS low", "high2 AS high", "still",
            f"{_moved('low2', 'low')} + {_moved('high2', 'high')} AS shift",
        )

    if not layout.blocked:
        schema = f"{_KEY}, low array<double>, high array<double>, still double, shift double"
        beside = train.join(centres.drop("n", "window"), KEYS)
        centres = materialize(beside.mapInPandas(_settle(max_iter), schema))
    else:
        for _ in range(0, max_iter, ROUNDS_PER_JOB):
            for _ in range(ROUNDS_PER_JOB):
                centres = one_round(centres)
            centres = materialize(centres)
            if centres.where(F.col("shift") > F.col("still")).isEmpty():
                break
    moving = centres.where(F.col("shift") > F.col("still")).count()
    if moving:
        warnings.warn(f"centres of {moving:,} groups still moved after {max_iter} rounds", stacklevel=3)
    settled = F.col("shift") <= F.col("still")
    return centres.select(*KEYS, "low", "high", settled.alias("settled"))


def _nearest(batches):
    """Distance of each window to the nearer centre, stamped at the window's last position."""
    names = ["series_id", "variable", "pos", "score", "error"]
    for batch in batches:
        out = [_frame([], names)]
        for row in batch.itertuples(index=False):
            found = {"series_id": row.series_id, "variable": row.variable}
            try:
                last = row.first_pos + int(row.window) - 1
                near = _distance_to_nearer(row)
                found |= {"pos": last + np.arange(len(near)), "score": near, "error": None}
                out.append(pd.DataFrame(found))
            except Exception as error:  # noqa: BLE001 - the group's note says what went wrong
                told = f"{type(error).__name__}: {error}"
                out.append(_frame([{**found, "pos": row.first_pos, "score": np.nan, "error": told}], names))
        yield pd.concat(out[1:]) if len(out) > 1 else out[0]


def _distance_to_nearer(row) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(row.x, dtype=float), int(row.window))
    near = np.full(len(view), np.inf)
    for centre in (row.low, row.high):
        near = np.minimum(near, ((view - np.asarray(centre)) ** 2).sum(axis=1))
    return np.sqrt(near)


def kmeans_fit(
    train: DataFrame,
    layout: Layout,
    signed: bool = False,
    max_iter: int = 300,
    tolerance: float = 1e-12,
) -> State:
    """Two centres of the windows of train residuals, and whether they had settled."""
    packed = materialize(_pack(train, layout, signed))
    return {"centres": _two_means(packed, layout, max_iter, tolerance)}


def kmeans_score(
    test: DataFrame, state: State, layout: Layout, window_agg: bool = False, signed: bool = False
) -> DataFrame:
    """Distance of each window of residuals to the nearer of two centres."""
    packed = materialize(_pack(test, layout, signed))
    centres = state["centres"].select(*KEYS, "low", "high")
    sizes = packed.groupBy(*KEYS).agg(F.first("n").alias("n"))
    centres = materialize(centres.join(sizes, KEYS))
    scores = attach(packed, centres, layout).mapInPandas(
        _nearest, "series_id string, variable string, pos bigint, score double, error string"
    )
    rows = test.join(scores, KEYS + ["pos"], "left")
    return _finish(rows, "kmeans", layout, window_agg)


def kmeans_scores(
    residuals: DataFrame,
    layout: Layout,
    window_agg: bool = False,
    signed: bool = False,
    max_iter: int = 300,
    tolerance: float = 1e-12,
) -> DataFrame:
    """Fit on the train rows, score the test rows."""
    state = kmeans_fit(_train(residuals), layout, signed, max_iter, tolerance)
    return _scores_only(kmeans_score(_test(residuals), state, layout, window_agg, signed))


@dataclass(frozen=True)
class Scorer:
    """An entry of the registry: add one to give :func:`detect` another way to score.

    ``windowed`` says that a score needs a whole window of residuals.
    """

    label: str
    description: str
    fit: Callable[..., State]
    score: Callable[..., DataFrame]
    windowed: bool = True


SCORERS: dict[str, Scorer] = {
    "norm": Scorer(
        texts.SCORER_LABELS["norm"],
        "size of the difference of value and forecast",
        norm_fit,
        norm_score,
        windowed=False,
    ),
    "kmeans": Scorer(
        texts.SCORER_LABELS["kmeans"],
        "distance of a window of differences to the usual patterns",
        kmeans_fit,
        kmeans_score,
    ),
    "wasserstein": Scorer(
        texts.SCORER_LABELS["wasserstein"],
        "distance of a window's distribution of differences to the train part's",
        wasserstein_fit,
        wasserstein_score,
    ),
}
