"""Exact duplicates by 128-bit content hash, with the texts themselves compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import ascii_lower, text_of


def content_hash(text: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col("doc_id"), ascii_lower(text_of()).alias("norm")).withColumn("h", hashed(F.col("norm")))


def classes(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct text: h, variant, norm, keep_id, group_size, text_sha256.

    Grouping by (hash, text) compares the texts of a hash group byte by byte. It is aggregated before
    the shuffle, so a text that fills a third of the table crosses the network once per map task.
    ``variant`` is null where the hash stands for one text, which is practically always; texts that
    share a hash carry their text in it.
    """
    texts = (
        _keyed(docs, hashed)
        .groupBy("h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text_sha256", F.sha2("norm", 256))
    )
    return texts.drop("norm")


def colliding(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Hashes that stand for more than one text (h)."""
    return classes(docs, hashed).groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")


def mark_copies(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group
    stays; of rows that repeat id and text one stays; a group of null ids keeps one of them. A null
    text is an empty one.

    Rows find their group by hash and by the SHA-256 of the text, which tells apart the texts that
    the byte comparison separated. The join side of the documents holds no text, and a hash with very
    many rows is split by Spark's skew handling, since nothing above the join needs its rows together.
    """
    groups = classes(docs, hashed)
    rows = (
        _keyed(docs, hashed)
        .select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("doc_id", "h", "text_sha256")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    joined = rows.alias("r").join(groups.alias("g"), ["h", "text_sha256"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"),
        "text_sha256",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``mark_copies`` keeps, with all their columns."""
    from pyspark.sql import Window

    groups = classes(docs).select("h", "text_sha256", F.col("keep_id").alias("id"))
    norm = ascii_lower(text_of())
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("id"),
        content_hash(norm).alias("h"),
        F.sha2(norm, 256).alias("text_sha256"),
    ).alias("p")
    kept = packed.join(
        groups.alias("g"),
        (F.col("p.h") == F.col("g.h"))
        & (F.col("p.text_sha256") == F.col("g.text_sha256"))
        & F.col("p.id").eqNullSafe(F.col("g.id")),
        "left_semi",
    )
    one = Window.partitionBy("h", "text_sha256", "id").orderBy("id")
    return kept.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select("row.*")
