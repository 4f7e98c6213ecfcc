"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed per cell (source, language, topic). Cell weights are raked: scaled so that the
source sums meet their targets, then the language sums, then the topic sums, round after round until
all agree. A document is kept with the ratio of its cell's raked weight to its tokens, scaled so that
the largest ratio is one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of
from tidepanel.session import materialize

#: Targets are the token shares of a margin to this power, so large sources and languages shrink.
FLATTEN = {"source": 0.7, "lang": 0.9, "topic": 1.0}
ROUNDS = 4
TOLERANCE = 1e-6
#: Raking ends short of the targets when twice in a row no weight grows by more than this share of the drift.
LEAST_GROWTH = 1 / 256
UNKNOWN = "(none)"


def topic_of(text: Column) -> Column:
    """A rough topic by form: table, listing, figures, long or short prose; null is short prose."""
    size = F.greatest(F.length(text), F.lit(1))

    def share(sign: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / size

    return (
        F.when(share("|") > 0.02, "table")
        .when(share("\n") > 0.03, "listing")
        .when(share("%") + share("$") + share("#") > 0.02, "figures")
        .when(F.length(text) > 4000, "long prose")
        .otherwise("short prose")
    )


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def cells_of(docs: DataFrame) -> DataFrame:
    """source, lang, topic (null: a value of its own) and tokens of each row."""
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit(UNKNOWN)).alias("source"),
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
        topic_of(text_of()).alias("topic"),
        tokens_of(text_of()).alias("n_tokens"),
    )


def rake(cells: DataFrame, flatten: dict[str, float] | None = None) -> DataFrame:
    """Cells with the column ``weight`` raked to the targets; ``tokens`` must be positive.

    The targets of each margin are its token shares raised to a power, made to sum to one. A few
    rounds at a time run in one job, over written cells, until all margins agree or no weight grows
    any more (the drift itself can stand still while small cells grow). Targets that the cells at
    hand cannot meet together leave the topic sums exact and the others as near as they came; a
    warning then names the drift that is left.
    """
    flatten = flatten or FLATTEN
    with_targets = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name, power in flatten.items():
        margin = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("margin"))
        raised = margin.withColumn("raised", F.pow("margin", F.lit(power)))
        whole = raised.agg(F.sum("raised").alias("whole"))
        target = raised.crossJoin(F.broadcast(whole)).select(
            name, (F.col("raised") / F.col("whole")).alias(f"target_{name}")
        )
        with_targets = with_targets.join(target, name)
    current = materialize(with_targets)

    def summed(name: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(name))

    slow = 0
    while True:
        step = current.withColumn("before", F.col("weight"))
        for _ in range(ROUNDS):
            for name in flatten:
                step = step.withColumn("weight", F.col("weight") * F.col(f"target_{name}") / summed(name))
        for name in flatten:
            step = step.withColumn(f"drift_{name}", F.abs(summed(name) / F.col(f"target_{name}") - 1))
        drifts = [f"drift_{name}" for name in flatten]
        current = materialize(step)
        growth = F.try_divide(F.col("weight"), F.col("before")) - 1
        worst, grown = current.agg(F.max(F.array_max(F.array(*drifts))), F.max(growth)).first()
        current = current.drop("before", *drifts)
        if worst is None or worst < TOLERANCE:
            return current
        slow = slow + 1 if (grown or 0.0) < worst * LEAST_GROWTH else 0
        if slow == 2:
            warnings.warn(f"margins still differ from their targets by up to {worst:.2g} of them", stacklevel=2)
            return current


def uniform(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, flatten: dict[str, float] | None = None) -> DataFrame:
    """Cells with ``probability``: source, lang, topic, tokens, weight, probability.

    Cells without tokens have probability one, since they weigh nothing.
    """
    cells = materialize(cells_of(docs).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells.filter("tokens > 0"), flatten)
    ratio = F.col("weight") / F.col("tokens")
    top = raked.agg(F.max(ratio).alias("top"))
    scaled = raked.crossJoin(F.broadcast(top)).select(
        "source", "lang", "topic", "tokens", "weight", (ratio / F.col("top")).alias("probability")
    )
    empty = cells.filter("tokens = 0 or tokens is null").select(
        "source", "lang", "topic", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability")
    )
    return materialize(scaled.unionByName(empty))


def mix(docs: DataFrame, flatten: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, kept.

    A row is kept when a uniform number made from its id is below the probability of its cell, so
    runs repeat; rows of one id and cell are kept or dropped together. Null source and language are
    values of their own, a null text has no tokens. One source may hold most rows: cells are summed
    before the shuffle, and rows find their cell without being gathered by it.
    """
    found = rates(docs, flatten).select("source", "lang", "topic", "probability")
    rows = cells_of(docs).join(found, ["source", "lang", "topic"])
    return rows.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        "probability",
        (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"),
    )


def sample(docs: DataFrame, flatten: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns."""
    found = rates(docs, flatten).select(
        F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), "probability"
    )
    packed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce("source", F.lit(UNKNOWN)).alias("s"),
        F.coalesce("lang", F.lit(UNKNOWN)).alias("l"),
        topic_of(text_of()).alias("t"),
        uniform(F.col("doc_id"), seed).alias("u"),
    )
    return packed.join(found, ["s", "l", "t"]).filter("u < probability").select("row.*")
