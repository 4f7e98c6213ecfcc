"""A corpus pipeline: documents that are good, unlike each other, mixed to target weights, and encoded.

Each stage takes the documents that its predecessor kept, with all their columns; the last returns
token digests. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import quality
from tidepanel.llm.exact_dedup import drop_copies
from tidepanel.llm.ngram_join import drop_near_copies
from tidepanel.llm.piece_bpe import encode_digests
from tidepanel.llm.source_mix import sample
from tidepanel.llm.tables import documents, table
from tidepanel.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is not below the cut."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z and a-z alike: the one with the largest id."""
    return drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return drop_near_copies(docs)


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens."""
    return sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents as digests."""
    return encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("exact copies", keep_one_copy),
    ("near copies", keep_one_near_copy),
    ("mix", keep_mix),
    ("encode", encode),
]

#: The classifier, the hash order of shingles and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
