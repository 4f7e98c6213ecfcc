"""How ordered work is spread when one group may hold a third of all rows.

A window partitioned by ``(series_id, variable)`` puts a whole group into one task. The helpers
here keep every task bounded instead:

* :func:`running` - running sums in key order. Rows are put into order-preserving buckets, bucket
  totals are added up in a small table, and only the rows of one bucket meet in a task.
* :func:`running_at` - running sums of one table at the rows of another, in the same buckets.
* :func:`with_position` - row numbers, a special case of the former.
* :func:`halo_blocks` - blocks of ``block_rows`` consecutive positions, each with copies of the
  neighbouring rows a bounded frame needs. A window over (group, block) then equals the window
  over the group.
* :func:`nearest_known` - unbounded look-around (previous / next known value), by carrying the
  block edges over the small table of blocks.
* :func:`attach` - joins per-group values on (group, block) rather than on the group alone.
* :func:`join_groups` - joins per-group values to rows without blocks, large groups apart.

A :class:`Layout` says whether any group is larger than a block; where none is, the same calls give
the plain window, with fewer exchanges. Results are equal either way (see tests/test_layout.py).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.model import KEYS, micros
from tidepanel.session import materialize

BLOCK_ROWS = 1 << 17
FINE_SPLIT = 4
#: Groups with a larger share of the rows are joined apart; there are at most 1 / SHARE of them.
SHARE = 1e-5


@dataclass(frozen=True)
class Layout:
    """Largest group of a table, and the rows one task may be given in order."""

    max_group_rows: int
    block_rows: int = BLOCK_ROWS

    @property
    def blocked(self) -> bool:
        return self.max_group_rows > self.block_rows

    @staticmethod
    def measure(df: DataFrame, keys: list[str] = KEYS, block_rows: int = BLOCK_ROWS) -> "Layout":
        """One partial-aggregating job; a single number reaches the driver."""
        top = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
        return Layout(int(top["m"] or 0), block_rows)

    @staticmethod
    def of(df: DataFrame, layout: "Layout | None", keys: list[str] = KEYS) -> "Layout":
        return layout if layout is not None else Layout.measure(df, keys)


def _bucketed(
    rows: DataFrame, keys: list[str], sums: list[str], target: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Add columns ``__b0..`` whose order follows ``__o``, and give the totals of each bucket.

    A level cuts the value range of each crowded bucket evenly, in proportion to its row count, and
    the next level looks whether any bucket is still crowded; this ends when none is or when a level
    has parted nothing. A bucket of one value cannot be cut and may stay crowded: it is marked
    ``__one``, and its rows are ``__c``. Totals are small tables, written once, so that later joins
    know their size. Where the cuts fall never changes results.
    """
    current, path, buckets = rows, [], 0
    while True:
        totals = materialize(
            current.groupBy(*keys, *path).agg(
                F.count(F.lit(1)).alias("__c"),
                F.min("__o").alias("__lo"),
                F.max("__o").alias("__hi"),
                *[F.sum(name).alias(name) for name in sums],
            )
        )
        level, before = len(path), buckets
        crowd, buckets = totals.agg(
            F.max(F.when(F.col("__hi") > F.col("__lo"), F.col("__c"))), F.count(F.lit(1))
        ).first()
        if level and ((crowd or 0) <= FINE_SPLIT * target or (level > 1 and buckets == before)):
            one = (F.col("__hi") == F.col("__lo")).alias("__one")
            return current, totals.select(*keys, *path, *sums, "__c", one), path
        parts = F.when(F.col("__c") <= target, F.lit(1)).otherwise(
            F.ceil(F.col("__c") / F.lit(target)) * FINE_SPLIT
        )
        spans = totals.select(*keys, *path, "__lo", "__hi", parts.cast("long").alias("__k"))
        share = (F.col("__o") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        cut = F.when(
            (F.col("__k") > 1) & (F.col("__hi") > F.col("__lo")),
            F.least(F.floor(share * F.col("__k")), F.col("__k") - 1),
        ).otherwise(F.lit(0))
        current = (
            current.join(spans, keys + path)
            .withColumn(f"__b{level}", cut.cast("long"))
            .drop("__lo", "__hi", "__k")
        )
        path = [*path, f"__b{level}"]


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, Column],
    layout: Layout,
    descending: bool = False,
) -> DataFrame:
    """Add for each measure ``m``: ``m`` (running sum up to and with the row) and ``m_total``.

    ``order`` must be distinct inside a group; add up ties first, which also takes the heat out of
    a value that repeats very often. ``order`` is numeric or TIMESTAMP_NTZ.
    """
    raw = {f"__m_{name}": expr for name, expr in measures.items()}
    base = df.select("*", *[expr.alias(name) for name, expr in raw.items()])
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if not layout.blocked:
        upto = Window.partitionBy(*keys).orderBy(direction).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        whole = Window.partitionBy(*keys).orderBy(direction).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        return base.select(
            *df.columns,
            *[F.sum(f"__m_{m}").over(upto).alias(m) for m in measures],
            *[F.sum(f"__m_{m}").over(whole).alias(f"{m}_total") for m in measures],
        )

    is_time = dict(df.dtypes)[order].startswith("timestamp")
    number = micros(F.col(order)) if is_time else F.col(order)
    if descending:
        number = -number
    base = materialize(base.withColumn("__o", number))
    cut, totals, path = _bucketed(base, keys, list(raw), layout.block_rows)
    by_bucket = Window.partitionBy(*keys).orderBy(*path)
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *keys,
        *path,
        *[F.coalesce(F.sum(f"__m_{m}").over(before), F.lit(0)).alias(f"__at_{m}") for m in measures],
        *[F.sum(f"__m_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys, *path).orderBy("__o").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return cut.join(offsets, keys + path).select(
        *df.columns,
        *[(F.sum(f"__m_{m}").over(inside) + F.col(f"__at_{m}")).alias(m) for m in measures],
        *[f"{m}_total" for m in measures],
    )


def running_at(
    steps: DataFrame,
    probes: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, Column | str],
    layout: Layout,
) -> DataFrame:
    """Rows of ``probes`` with, for each measure, its sum over the ``steps`` that are not behind the row.

    Both tables have ``keys`` and a numeric ``order``; the steps' values are distinct inside a group,
    the rows' may repeat. Both go into the same order-preserving buckets, so nothing is joined on the
    values. A value that very many rows share makes a bucket of its own, in which all rows have the
    same sums; it is dealt out by the number of its rows.
    """
    raw = {f"__m_{name}": F.col(e) if isinstance(e, str) else e for name, e in measures.items()}
    row = F.struct(*probes.columns)
    empty = F.lit(None).cast(probes.select(row.alias("r")).schema["r"].dataType)
    both = steps.select(*keys, F.col(order).alias("__o"), *[e.cast("double").alias(m) for m, e in raw.items()], empty.alias("__row"))
    both = both.unionByName(
        probes.select(*keys, F.col(order).alias("__o"), *[F.lit(0.0).alias(m) for m in raw], row.alias("__row"))
    )
    cut, totals, path = _bucketed(materialize(both), keys, list(raw), layout.block_rows)
    before = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    parts = F.greatest(F.ceil(F.col("__c") / layout.block_rows), F.lit(1))
    offsets = totals.select(
        *keys,
        *path,
        F.when(F.col("__one"), parts).otherwise(F.lit(1)).cast("bigint").alias("__parts"),
        "__one",
        *[F.coalesce(F.sum(m).over(before), F.lit(0.0)).alias(f"__at{m}") for m in raw],
        *[F.col(m).alias(f"__all{m}") for m in raw],
    )
    dealt = cut.join(offsets, keys + path).withColumn(
        "__part", F.pmod(F.xxhash64("__row"), F.col("__parts"))
    )
    upto = Window.partitionBy(*keys, *path, "__part").orderBy("__o").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = [
        (F.when(F.col("__one"), F.col(f"__all__m_{m}")).otherwise(F.sum(f"__m_{m}").over(upto))
         + F.col(f"__at__m_{m}")).alias(m)
        for m in measures
    ]
    return dealt.select("__row", *sums).where("__row is not null").select("__row.*", *measures)


def with_position(
    df: DataFrame, layout: Layout, keys: list[str] = KEYS, order: str = "ts"
) -> DataFrame:
    """Add ``pos`` (0-based) and ``n`` (rows of the group)."""
    counted = running(df, keys, order, {"__p": F.lit(1).cast("long")}, layout)
    return (
        counted.withColumn("pos", (F.col("__p") - 1).cast("long"))
        .withColumn("n", F.col("__p_total").cast("long"))
        .drop("__p", "__p_total")
    )


def halo_blocks(df: DataFrame, layout: Layout, before: int = 0, after: int = 0) -> DataFrame:
    """Add ``block`` and ``core``; rows near a block edge are copied to the neighbour as non-core."""
    if not layout.blocked:
        return df.withColumn("block", F.lit(0).cast("long")).withColumn("core", F.lit(True))
    size = layout.block_rows
    first = F.greatest(F.floor((F.col("pos") - after) / size), F.lit(0)).cast("long")
    last = F.least(
        F.floor((F.col("pos") + before) / size), F.floor((F.col("n") - 1) / size)
    ).cast("long")
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "core", F.col("block") == F.floor(F.col("pos") / size)
    )


def block_window(keys: list[str] = KEYS, order: str = "pos"):
    return Window.partitionBy(*keys, "block").orderBy(order)


def attach(
    df: DataFrame, values: DataFrame, layout: Layout, keys: list[str] = KEYS, how: str = "inner"
) -> DataFrame:
    """Join per-group ``values`` (which must carry ``n``) to a table that has ``block``.

    With large groups the small side is repeated once per block, so the join key is
    (group, block), the partitioning the block windows already use.
    """
    if not layout.blocked:
        return df.join(values.drop("n"), keys, how)
    return df.join(per_block(values, layout).drop("n"), keys + ["block"], how)


def per_block(values: DataFrame, layout: Layout, spread: bool = False) -> DataFrame:
    """Per-group rows (with ``n``) repeated for each block of their group.

    ``spread`` repeats large rows in two steps, first for stretches of blocks that are dealt out, then
    for the blocks of each, so that no task writes more than the root of their number.
    """
    first = F.lit(0).cast("long")
    if not layout.blocked:
        return values.withColumn("block", first)
    last = F.floor((F.col("n") - 1) / layout.block_rows)
    if not spread:
        return values.withColumn("block", F.explode(F.sequence(first, last)))
    stretch = F.ceil(F.sqrt(last + 1)).cast("long")
    starts = values.withColumn("__from", F.explode(F.sequence(first, last, stretch)))
    starts = starts.repartition(*KEYS, "__from")
    until = F.least(F.col("__from") + stretch - 1, last)
    return starts.withColumn("block", F.explode(F.sequence(F.col("__from"), until))).drop("__from")


def join_groups(
    rows: DataFrame, values: DataFrame, keys: list[str], layout: Layout, how: str = "inner"
) -> DataFrame:
    """Join (inner, left, left_semi or left_anti) per-group ``values`` to rows that have no block.

    With large groups the values of those with more than ``SHARE`` of all rows are broadcast: at most
    1 / ``SHARE`` rows, whatever the data. All other groups are small beside a task's part of the
    rows, so the shuffle of theirs is even.
    """
    if not layout.blocked:
        return rows.join(values, keys, how)
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
    total = sizes.agg(F.sum("__rows")).first()[0] or 0
    large = materialize(sizes.where(F.col("__rows") > total * SHARE).select(*keys))
    marked = rows.join(F.broadcast(large.withColumn("__large", F.lit(True))), keys, "left")
    near = values.join(F.broadcast(large), keys, "left_semi")
    far = values.join(F.broadcast(large), keys, "left_anti")
    at_hand = marked.where("__large").drop("__large").join(F.broadcast(near), keys, how)
    return at_hand.unionByName(marked.where("__large is null").drop("__large").join(far, keys, how))


def settle(values: DataFrame, layout: Layout) -> DataFrame:
    """Write a small per-group table before it is joined to a large one.

    Spark then knows its size when it plans: it broadcasts the table only if it is below the
    session's threshold, and the large side, hot groups included, stays where it is.
    """
    return materialize(values) if layout.blocked else values


def nearest_known(
    df: DataFrame, layout: Layout, value: str = "value", keys: list[str] = KEYS
) -> DataFrame:
    """Add ``prev`` and ``next``: struct(pos, value) of the nearest known row at or around each row."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("pos"), F.col(value).alias("value")))
    if not layout.blocked:
        back, ahead = _both_ways(keys)
        return df.select(
            "*",
            F.last(known, ignorenulls=True).over(back).alias("prev"),
            F.last(known, ignorenulls=True).over(ahead).alias("next"),
        )
    blocks = halo_blocks(df, layout)
    edges = blocks.groupBy(*keys, "block").agg(
        F.min(known).alias("__first"), F.max(known).alias("__last")
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.col("block").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys,
        "block",
        F.last("__last", ignorenulls=True).over(earlier).alias("__before"),
        F.last("__first", ignorenulls=True).over(later).alias("__after"),
    )
    back, ahead = _both_ways([*keys, "block"])
    return blocks.join(carried, keys + ["block"]).select(
        *df.columns,
        F.coalesce(F.last(known, ignorenulls=True).over(back), F.col("__before")).alias("prev"),
        F.coalesce(F.last(known, ignorenulls=True).over(ahead), F.col("__after")).alias("next"),
    )


def _both_ways(keys: list[str]):
    """Growing frames from either end. (A frame open to the following side would be recomputed
    from every row, which is quadratic; reading backwards is not.)"""
    part = Window.partitionBy(*keys)
    back = part.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = part.orderBy(F.col("pos").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return back, ahead


def exact_quantiles(
    df: DataFrame, value: str, points: list[float], layout: Layout, keys: list[str] = KEYS
) -> DataFrame:
    """Linear-interpolated quantiles per group, as array ``quantiles``; NULLs are left out.

    Exact at any size: beyond one block the order statistics are picked by running counts over
    distinct values, because the ``percentile`` aggregate keeps a group's values in one task.
    """
    rows = df.where(F.col(value).isNotNull())
    if not layout.blocked:
        points_column = F.array(*[F.lit(float(p)) for p in points])
        return rows.groupBy(*keys).agg(F.percentile(value, points_column).alias("quantiles"))
    distinct = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(distinct, keys, value, {"__r": F.col("__c")}, layout)

    def at_rank(rank: Column) -> Column:
        hit = (F.col("__r") - F.col("__c") <= rank) & (rank < F.col("__r"))
        return F.max(F.when(hit, F.col(value)))

    picks: list[Column] = []
    names: list[Column] = []
    for i, point in enumerate(points):
        place = (F.col("__r_total") - 1) * F.lit(float(point))
        picks.append(at_rank(F.floor(place)).alias(f"__lo{i}"))
        picks.append(at_rank(F.ceil(place)).alias(f"__hi{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"__f{i}"))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        names.append(low + (high - low) * F.col(f"__f{i}"))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, F.array(*names).alias("quantiles"))
