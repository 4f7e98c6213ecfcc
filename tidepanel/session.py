"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tidepanel", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local session may fall back on a temporary folder: on a cluster a folder of one
    machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
    return context.getCheckpointDir()


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what :func:`materialize` wrote inside.

    Results that are still to be computed from those tables have to be written before.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Unlike a cached or locally checkpointed table it survives the loss of executors, and being
    Parquet it keeps column pruning, filter pushdown and real sizes for the join choice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidepanel-{uuid.uuid4().hex}"
    if _written.get() is not None:
        _written.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
