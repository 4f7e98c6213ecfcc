"""Delimited text files: delimiter, row order, column roles."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import texts
from tidepanel.model import frame_to_panel
from tidepanel.operators.clean import merge_labels, merge_repeated
from tidepanel.sources import roles
from tidepanel.sources.roles import Roles
from tidepanel.session import materialize

DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 50
POSITION = "__position"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The separator that occurs equally often, and at all, in each of the first lines."""
    lines = [r[0] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    records, open_ = [], ""
    for line in lines:
        open_ = f"{open_}\n{line}" if open_ else line
        if open_.count('"') % 2 == 0:
            records.append(open_)
            open_ = ""
    best = (0, ",")
    for mark in DELIMITERS:
        counts = {_outside_quotes(record, mark) for record in records if record.strip()}
        if len(counts) == 1 and (count := counts.pop()) > best[0]:
            best = (count, mark)
    return best[1]


def _outside_quotes(line: str, mark: str) -> int:
    return sum(part.count(mark) for part in line.split('"')[::2])


def file_rows(
    spark: SparkSession, path: str, sep: str | None = None, header: bool = True
) -> DataFrame:
    """All cells as text with column ``__position``: the row's place in file order.

    Rows of one split are numbered as they are read; the splits' row counts, a small table, give
    each split its offset. So no row is moved and nothing is sorted. Files whose records go on over
    line breaks inside quotes take the longer way of :func:`spanning_rows`.
    """
    sep = sep or sniff_delimiter(spark, path)
    if spans_lines(spark, path, sep):
        return spanning_rows(spark, path, sep, header)
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False, escape='"')
    names = [c.strip() for c in raw.columns]
    numbered = raw.select(
        *[_cell(f"`{old}`").alias(new) for old, new in zip(raw.columns, names)],
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = numbered.groupBy("__file", "__start").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    in_order = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__file",
        "__start",
        (F.coalesce(F.sum("__rows").over(in_order), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    placed = numbered.join(offsets, ["__file", "__start"])
    return placed.select(
        *[f"`{c}`" for c in names], (F.col("__id") + F.col("__shift")).cast("bigint").alias(POSITION)
    )


def _quotes(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes (0 or 1), for either way it may begin: outside, inside.

    A quote opens a cell only at its beginning; two quotes inside a cell are one of its characters.
    """
    mark = re.escape(sep)

    def left_open(rest: Column) -> Column:
        without = F.regexp_replace(rest, f'(^|{mark}) *+"(?:[^"]|"")*+"', "$1")
        return without.rlike(f'(^|{mark}) *+"').cast("int")

    closing = '^(?:[^"]|"")*+"'
    behind = F.concat(F.lit("."), F.regexp_replace(line, closing, ""))
    return left_open(line), F.when(line.rlike(closing), left_open(behind)).otherwise(1)


def spans_lines(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether any record goes on over a line break. One scan without a shuffle."""
    outside, _ = _quotes(F.col("value"), sep)
    return not spark.read.text(path).where(outside == 1).isEmpty()


def _through(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``before`` and ``after``: what the rows of a group, up to this one, do to the quote state.

    A row maps each state to one: ``to`` where both go to the same, else it keeps (``swap`` 0) or
    changes (1) the state. The maps of consecutive rows compose to the last fixed state, if there is
    one, and the number of changes since: struct(fixed, swaps).
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("__swaps", F.sum("swap").over(upto))
    fixed = F.last(F.when(F.col("to").isNotNull(), F.struct("to", "__swaps")), ignorenulls=True).over(upto)
    done = counted.withColumn("__fixed", fixed).withColumn(
        "after",
        F.struct(
            F.col("__fixed.to").alias("fixed"),
            ((F.col("__swaps") - F.coalesce("__fixed.__swaps", F.lit(0))) % 2).cast("int").alias("swaps"),
        ),
    )
    start = F.struct(F.lit(None).cast("int").alias("fixed"), F.lit(0).alias("swaps"))
    previous = F.lag("after").over(Window.partitionBy(*keys).orderBy(order))
    return done.withColumn("before", F.coalesce(previous, start)).drop("__swaps", "__fixed")


def _state(through: str, entry: Column | int) -> Column:
    begin = F.coalesce(F.col(f"{through}.fixed"), entry if isinstance(entry, Column) else F.lit(entry))
    return (begin + F.col(f"{through}.swaps")) % 2


def spanning_rows(spark: SparkSession, path: str, sep: str, header: bool = True) -> DataFrame:
    """As :func:`file_rows` for files whose records may go on over line breaks inside quotes.

    Lines of a split are looked at in order; what a split as a whole does to the quote state is one row
    of a small table, from which every split learns whether it begins inside quotes and how many
    records came before. Only the lines of records that do go on are brought together. A line break
    inside a cell is read as a line feed. The cells of a record are parsed by Spark.
    """
    split = ["__file", "__start"]
    outside, inside = _quotes(F.col("value"), sep)
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
        outside.alias("__out"),
        inside.alias("__in"),
    )
    mapped = lines.withColumn("to", F.when(F.col("__out") == F.col("__in"), F.col("__out"))).withColumn(
        "swap", (F.col("__out") > F.col("__in")).cast("int")
    )
    # for either state that the split may begin with: before and after the line, and records begun so far
    upto = Window.partitionBy(*split).orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ways = [
        F.struct(
            (_state("before", entry) == 0).cast("int").alias("begins"),
            (_state("after", entry) == 0).alias("ends"),
            # a blank line between records is none
            F.sum(((_state("before", entry) == 0) & (F.trim("value") != "")).cast("int")).over(upto).alias("nth"),
        ).alias(f"__way{entry}")
        for entry in (0, 1)
    ]
    mapped = materialize(_through(mapped, split, "__id").select("value", *split, "__id", "after", *ways))
    ends = mapped.groupBy(*split).agg(
        F.max_by("after", "__id").alias("end"), *[F.max(f"__way{entry}.nth").alias(f"__n{entry}") for entry in (0, 1)]
    )
    ends = ends.select(
        *split,
        F.when(F.col("end.fixed").isNotNull(), (F.col("end.fixed") + F.col("end.swaps")) % 2).alias("to"),
        F.when(F.col("end.fixed").isNull(), F.col("end.swaps")).otherwise(0).alias("swap"),
        "__n0",
        "__n1",
    )
    entries = _through(ends, ["__file"], "__start").withColumn("__entry", _state("before", 0))
    entries = entries.withColumn("__records", F.when(F.col("__entry") == 0, F.col("__n0")).otherwise(F.col("__n1")))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("__offset", F.coalesce(F.sum("__records").over(earlier), F.lit(0)))
    entries = materialize(entries.select(*split, "__entry", "__offset"))
    way = F.when(F.col("__entry") == 0, F.col("__way0")).otherwise(F.col("__way1"))
    numbered = mapped.join(entries, split).withColumn("__way", way).select(
        "value",
        *split,
        "__id",
        F.col("__way.begins").alias("__begins"),
        F.col("__way.ends").alias("__ends"),
        (F.col("__offset") + F.col("__way.nth")).alias("__record"),
    )
    numbered = numbered.where((F.col("__begins") == 0) | (F.trim("value") != ""))
    whole = numbered.where("__begins = 1 and __ends").select("__file", "__record", "value")
    ordered = F.array_sort(F.collect_list(F.struct("__start", "__id", "value")))
    joined = numbered.where("__begins = 0 or not __ends").groupBy("__file", "__record").agg(ordered.alias("__l"))
    joined = joined.select("__file", "__record", F.array_join(F.transform("__l", lambda x: x["value"]), "\n").alias("value"))
    records = materialize(whole.unionByName(joined))

    first = records.orderBy("__file", "__record").first()
    cells = next(csv.reader(io.StringIO(first["value"]), delimiter=sep))
    names = [c.strip() for c in cells] if header else [f"_c{i}" for i in range(len(cells))]
    # positions: records of earlier files, without their headers, and of this file
    skipped = 1 if header else 0
    files = records.groupBy("__file").agg(F.min("__record").alias("__least"), F.count(F.lit(1)).alias("__n"))
    in_order = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = materialize(
        files.withColumn("__from", F.coalesce(F.sum(F.col("__n") - skipped).over(in_order), F.lit(0)))
    )
    kept = records.join(files, "__file").where(F.col("__record") >= F.col("__least") + skipped)
    place = F.col("__from") + F.col("__record") - F.col("__least") - skipped
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'})
    # written, so that a record is parsed once and not for each column and use of it
    rows = materialize(kept.select(parsed.alias("__cells"), place.cast("bigint").alias(POSITION)))
    return rows.select(*[_cell(f"`__cells`.c{i}").alias(name) for i, name in enumerate(names)], POSITION)


def _cell(name: str) -> Column:
    """A cell as text; the usual spellings of "missing" become NULL."""
    text = F.trim(F.col(name))
    return F.when(~text.isin(*texts.MISSING_TEXTS), text)


def most_recent(rows: DataFrame, max_rows: int, order: str = POSITION) -> DataFrame:
    """The last ``max_rows`` rows in file order. Positions are dense, so a filter is enough."""
    last = rows.agg(F.max(order).alias("__last"))
    return (
        rows.crossJoin(F.broadcast(last))  # one row
        .where(F.col(order) > F.col("__last") - max_rows)
        .drop("__last")
    )


def synthetic_axis(rows: DataFrame, position: str = POSITION) -> DataFrame:
    """Time column ``ts`` from row order: one day per row from 2000-01-01 on."""
    start = F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'")
    return rows.withColumn("ts", F.timestamp_add("DAY", F.col(position), start))


@dataclass(frozen=True)
class Ingest:
    """What a file was found to hold."""

    panel: DataFrame
    labels: DataFrame | None
    frame: DataFrame
    features: list[str]
    time_col: str | None
    label_col: str | None
    dropped_cols: list[str]
    warnings: list[str] = field(default_factory=list)

    def meta(self, spark: SparkSession) -> DataFrame:
        """The findings as a table of one row."""
        return spark.createDataFrame(
            [(self.time_col, self.label_col, self.dropped_cols, self.warnings)],
            "time_col string, label_col string, dropped_cols array<string>, warnings array<string>",
        )


def read_series(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    max_rows: int | None = None,
    series_id: str = "all",
    strict_reference: bool = False,
) -> Ingest:
    """Read delimited files and find out by themselves the time, label and numeric columns."""
    rows = file_rows(spark, path, sep)
    warnings: list[str] = []
    if max_rows is not None:
        if rows.count() > max_rows:
            warnings.append(f"only the most recent {max_rows:,} rows are used")
        rows = most_recent(rows, max_rows)
    return infer_series(rows, series_id, strict_reference, warnings)


def infer_series(
    rows: DataFrame,
    series_id: str = "all",
    strict_reference: bool = False,
    warnings: list[str] | None = None,
) -> Ingest:
    """Roles of the columns of any table, then panel and labels.

    All facts about all columns come from one aggregation over the data; the choice between
    columns is made on that single row.
    """
    notes = list(warnings or [])
    columns = [c for c in rows.columns if c != POSITION]
    profile = roles.profile(rows.select(*[f"`{c}`" for c in columns]), strict_reference)
    found: Roles = roles.choose(profile, strict_reference)
    if not found.features:
        raise ValueError("no numeric column is left to analyse; at least one is needed")
    if found.time_col is not None:
        parsed = rows.withColumn("ts", roles.parse_time(found.time_col, profile))
        failed = profile[found.time_col].rows - profile[found.time_col].times
        if failed:
            notes.append(f"{failed} rows without a readable time in {found.time_col!r} were removed")
        timed = parsed.where(F.col("ts").isNotNull())
    else:
        notes.append("no time column was found: row order is taken as a daily axis")
        if POSITION not in rows.columns:
            raise ValueError("a table without row order needs a time column")
        timed = synthetic_axis(rows)
    if found.dropped:
        notes.append(f"columns that are not numeric were left out: {', '.join(found.dropped)}")
    frame = timed.select(
        "ts",
        *[F.col(f"`{c}`").cast("double").alias(c) for c in found.features],
        *([roles.label_value(found.label_col).alias("__y")] if found.label_col else []),
    )
    panel = merge_repeated(frame_to_panel(frame, found.features, series_id=series_id))
    labels = None
    if found.label_col:
        labels = merge_labels(
            frame.select(F.lit(series_id).alias("series_id"), "ts", F.col("__y").alias("y"))
        )
    return Ingest(
        panel=panel,
        labels=labels,
        frame=frame.drop("__y"),
        features=found.features,
        time_col=found.time_col,
        label_col=found.label_col,
        dropped_cols=found.dropped,
        warnings=notes,
    )
