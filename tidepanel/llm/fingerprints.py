"""Threshold-scaled fingerprints of documents, in DataFrame functions only.

Of the hashes of all five-word shingles those below a fixed fraction of the hash range stay. The
choice depends on the hash alone, so fingerprints of unequal documents compare without bias: unions of
fingerprints are fingerprints of unions, and shares of common hashes estimate containment.

A short text may have no hash below the threshold. Its least hash then stands in, so that it still has
a fingerprint and equal texts are found alike; a stand-in lies above the threshold, which marks it, and
takes no part in containment or in unions with texts that have sampled hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of

SHINGLE = 5
FRACTION = 4
#: Stands for a null id inside the job: the smallest.
NO_ID = -(1 << 63)
SPACE = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sampled(hashes: Column, fraction: int = FRACTION) -> Column:
    """The hashes below the threshold."""
    most = -(1 << 63) + (1 << 64) // fraction
    return F.filter(hashes, lambda x: x < F.lit(most))


def sketch(text: Column, shingle: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Ascending array of the retained shingle hashes.

    A hash stays when it is below 1/fraction of the range of 64-bit hashes. A text with fewer words
    than a shingle is one shingle; without words the array is empty. Where no hash is below, the least
    stands in.
    """
    words = word_list(text)

    def hashes(words: Column) -> Column:
        found = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(words, i, shingle)),
        )
        return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))

    def retained(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(sampled(h, fraction)))
        least = F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
        return F.when(F.size(low) > 0, low).otherwise(least)

    # transform() over one element names an intermediate value, which is then worked out once
    return F.get(F.transform(F.transform(F.array(words), hashes), retained), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Estimated share of a's shingles that b holds; null where none of a's is sampled.

    Sizes may be very unequal: whether a hash of a is in b does not depend on what else b has.
    """
    mine = sampled(a, fraction)
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, b)) / F.size(mine))


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Sketch of two texts together (without the shingles across their border)."""
    both = F.array_sort(F.array_union(a, b))
    low = sampled(both, fraction)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def as_text(sketch: Column) -> Column:
    """Hexadecimal hashes, joined by commas."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def _sliced(docs: DataFrame, n: int) -> DataFrame:
    """Rows with their slice of the id order. Only the n borders go to the driver."""
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], F.lit(10_000))).first()
    borders = [F.lit(b).cast("bigint") for b in sorted(set(found[0] or []))]
    below = F.filter(F.array(*borders), lambda b: b < F.col("doc_id")) if borders else F.array()
    return docs.withColumn("slice", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(below)).cast("int"))


def fingerprint_edits(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's in ascending (doc_id, text) order; the first row follows the last. A null id sorts
    first, a null text is empty, a single row follows itself. near_edited and near_next estimate the
    likeness to the edited text and to the next document, contained_edited and contained_next the share
    of the row's shingles that those hold (null where none is sampled).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = _sliced(docs.select("doc_id", text_of().alias("text")), 2 * parts)
    firsts = sliced.groupBy("slice").agg(
        F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")
    )
    slices = sorted((r["slice"], None if r["nulls"] else r["first"]) for r in firsts.collect())
    before = {s: slices[i - 1][0] for i, (s, _) in enumerate(slices)} or {0: 0}
    first_id = F.create_map(*[F.lit(x) for s, f in slices or [(0, 0)] for x in (s, NO_ID if f is None else f)])
    is_first = F.coalesce("doc_id", F.lit(NO_ID)) == F.element_at(first_id, F.col("slice")).cast("bigint")
    earlier = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    extra = F.when(is_first, F.element_at(earlier, F.col("slice")))
    copies = F.filter(
        F.array(
            F.struct(F.col("slice").alias("slice"), F.lit(0).alias("ghost")),
            F.struct(extra.alias("slice"), F.lit(1).alias("ghost")),
        ),
        lambda c: c["slice"].isNotNull(),
    )
    dealt = (
        sliced.select("doc_id", "text", F.explode(copies).alias("c"))
        .select("doc_id", "text", "c.slice", "c.ghost")
        .repartition(parts, "slice")
        .withColumn("sketch", sketch(F.col("text"), shingle, fraction))
    )
    order = Window.partitionBy("slice").orderBy("ghost", "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    paired = dealt.select(
        "doc_id",
        "ghost",
        "text",
        "sketch",
        F.lead("text").over(order).alias("next_text"),
        F.lead("sketch").over(order).alias("next_sketch"),
    ).filter("ghost = 0")
    edited = paired.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        "sketch",
        "next_sketch",
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.length("text") - half),
            F.substring(F.col("next_text"), F.lit(1), half),
        ).alias("edited"),
    ).withColumn("edited_sketch", sketch(F.col("edited"), shingle, fraction))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), fraction).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), fraction).alias("contained_next"),
    )
