"""Writing result tables: a run is published at once, panels lie in a fixed number of buckets.

Tables of a run are written first, its row of the manifest last. Readers go by the manifest, so they
see all tables of a run or none, also while a run is written or after one broke off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
BUCKETS = 64
_MANIFEST = "run_id string, created timestamp, facts map<string,string>, tables array<string>"


@dataclass(frozen=True)
class Published:
    """A run as the manifest names it."""

    run_id: str
    facts: dict[str, str]
    tables: dict[str, DataFrame]


def publish(
    tables: dict[str, DataFrame], folder: str, run_id: str, facts: dict[str, str] | None = None
) -> str:
    """Write the tables under ``folder/run_id``, then the run's one row of the manifest."""
    spark = next(iter(tables.values())).sparkSession
    folder = folder.rstrip("/")
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{run_id}/{name}")
    told = spark.createDataFrame([(run_id, None, facts or {}, list(tables))], _MANIFEST)
    told = told.withColumn("created", F.current_timestamp()).coalesce(1)
    told.write.mode("append").parquet(f"{folder}/{MANIFEST}")
    return run_id


def published(spark: SparkSession, folder: str, run_id: str | None = None) -> Published:
    """The tables of a run, by default of the one that was published last."""
    folder = folder.rstrip("/")
    known = spark.read.schema(_MANIFEST).parquet(f"{folder}/{MANIFEST}")
    if run_id is not None:
        known = known.where(F.col("run_id") == run_id)
    row = known.orderBy(F.col("created").desc(), "run_id").first()
    if row is None:
        raise ValueError(f"nothing published {run_id or ''} in {folder}")
    tables = {name: spark.read.parquet(f"{folder}/{row['run_id']}/{name}") for name in row["tables"]}
    return Published(row["run_id"], dict(row["facts"]), tables)


def write_tables(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """One Parquet table per result, published as one run."""
    publish(tables, folder, run_id)


def _bucket(series_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(series_id), F.lit(buckets)).cast("int")


def write_panel(panel: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """A panel in a fixed number of folders, so that reading one series touches one of them.

    Rows are spread by instant as well as by series, then sorted inside each file: a long series is
    written by many tasks, and many series do not make many folders. A file names its own range of
    series and instants, by which a reader skips it.
    """
    (
        panel.withColumn("bucket", _bucket(F.col("series_id"), buckets))
        .repartitionByRange("bucket", "series_id", "ts")
        .sortWithinPartitions("bucket", "series_id", "variable", "ts")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def read_series_panel(spark: SparkSession, path: str, series_id: str, buckets: int = BUCKETS) -> DataFrame:
    """One series of a panel written with as many buckets: only its folder is read."""
    bucket = spark.range(1).select(_bucket(F.lit(series_id), buckets)).first()[0]
    rows = spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("series_id") == series_id))
    return rows.drop("bucket")
