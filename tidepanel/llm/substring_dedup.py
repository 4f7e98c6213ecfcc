"""Removal of word passages that an earlier document already holds.

Rabin-Karp hashes of every window of words are compared across documents. To keep windows that occur
once off the network, documents first exchange only anchors: the least hash of the five-word stretches
inside a window. Equal windows have equal anchors, so a window whose anchor occurs in one document
alone cannot repeat; all others are counted in Spark by 96 bits of two hashes, each made of another,
independent hash of the words. What repeats inside one batch
of a task is settled there, so a passage that a third of all documents share reaches its group once
per batch and not once per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of
from tidepanel.llm.words import SLICE, Words, giving_back, rolling, slices, text_groups

WINDOW = 13
#: Words of a stretch. Longer ones repeat less often by chance, but more of them are anchors.
STRETCH = 5
#: Rows that a task hands over at once: the executor holds them beside the worker.
HANDED = 1 << 16
#: Stands for a null id inside the jobs: the smallest.
NO_ID = -(1 << 63)
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _windows(words: Words, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of text i and the anchors of its windows."""
    h = words.h[words.first[i] : words.first[i + 1]]
    if len(h) < k:
        return h, np.zeros(0, np.uint64)
    inner = min(STRETCH, k)
    stretches = np.lib.stride_tricks.sliding_window_view(rolling(h, inner, 7), k - inner + 1)
    return h, stretches.min(axis=1)


def _anchors(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("repeats", pa.bool_())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("id").to_numpy()
            found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j, words in text_groups(batch.column("text")):
                for t in range(j - i):
                    anchors = np.unique(_windows(words, k, t)[1])
                    found.append(anchors)
                    owner.append(np.full(len(anchors), ids[i + t]))
            anchors, owners = np.concatenate(found), np.concatenate(owner)
            _, first, place, times = np.unique(anchors, return_index=True, return_inverse=True, return_counts=True)
            repeats = times[place] > 1
            single = first[times > 1]  # one of each goes to the others as well
            yield from _handed(
                pa.record_batch(
                    [
                        pa.array(np.concatenate([anchors, anchors[single]]).view(np.int64)),
                        pa.array(np.concatenate([owners, owners[single]])),
                        pa.array(np.concatenate([repeats, np.zeros(len(single), bool)])),
                    ],
                    schema=schema,
                )
            )

    return run


def repeated_anchors(docs: DataFrame, k: int) -> DataFrame:
    """(id, first half of the anchor) of anchors that more than one row holds."""
    rows = docs.select("id", "text").mapInArrow(_anchors(k), "anchor bigint, id bigint, repeats boolean")
    # rows already known to repeat need no group, so they are spread
    rows = rows.withColumn("salt", F.when(F.col("repeats"), F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(0))
    group = Window.partitionBy("anchor", "salt").orderBy("id")
    near = rows.withColumn("before", F.lag("id").over(group)).withColumn("behind", F.lead("id").over(group))
    near = near.filter("repeats or before is not null or behind is not null")
    # half of an anchor is enough to find its windows again: at worst a few more are looked at
    return near.select("id", F.shiftright("anchor", 32).cast("int").alias("anchor"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _packed(pos: np.ndarray, starts: np.ndarray, alone: np.ndarray) -> list[bytes | None]:
    """The places of each run as bytes; none is made for runs of one that travel as a number."""
    ends = np.append(starts[1:], len(pos))
    pos = pos.astype("<i4")
    return [None if a else pos[x:y].tobytes() for a, x, y in zip(alone.tolist(), starts.tolist(), ends.tolist())]


def _handed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, HANDED):
        yield batch.slice(i, HANDED)


def _candidates(k: int):
    schema = pa.schema(
        [("w1", pa.int64()), ("w2", pa.int32()), ("id", pa.int64()), ("th", pa.int64())]
        + [("place", pa.int32()), ("places", pa.binary())]
    )

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 * SLICE):
            ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            lists = batch.column("anchors")
            edges = lists.offsets.to_numpy()
            known = lists.values.to_numpy(zero_copy_only=False)
            types = (np.int64, np.int32, np.int32, np.int32)  # w1, w2, row, place
            parts = [[np.zeros(0, t)] for t in types]
            for i, j, words in text_groups(batch.column("text")):
                for t in range(j - i):
                    h, anchors = _windows(words, k, t)
                    halves = (anchors.view(np.int64) >> 32).astype(np.int32)
                    at = np.flatnonzero(np.isin(halves, known[edges[i + t] : edges[i + t + 1]]))
                    if len(at):
                        g = words.g[words.first[t] : words.first[t + 1]]
                        one, two = (rolling(x, k, seed).view(np.int64)[at] for x, seed in ((h, 1), (g, 2)))
                        for some, x in zip(parts, (one, two >> 32, np.full(len(at), i + t), at)):
                            some.append(x.astype(some[0].dtype))
            w1, w2, row, pos = (np.concatenate(x) for x in parts)
            del parts
            doc = ids[row]
            order = np.lexsort((row, doc, w2, w1))
            first = _runs(w1[order], w2[order])
            least = np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
            later = np.zeros(len(order), bool)
            later[order] = doc[order] > least
            del doc, least
            open_ = order[~later[order]]
            sure = np.flatnonzero(later)
            sure = sure[np.argsort(row[sure], kind="stable")]
            # one row for all places of a window in a text, and one for all settled places of a text
            o, s = _runs(w1[open_], w2[open_], row[open_]), _runs(row[sure])
            # the one place of most windows travels as a number
            alone = np.diff(np.append(o, len(open_))) == 1
            places = [*_packed(pos[open_], o, alone), *_packed(pos[sure], s, np.zeros(len(s), bool))]
            alone = np.concatenate([alone, np.zeros(len(s), bool)])
            runs = np.concatenate([open_[o], sure[s]])
            settled = [None] * len(s)
            made = pa.record_batch(
                [
                    pa.concat_arrays([pa.array(w1[open_[o]]), pa.array(settled, pa.int64())]),
                    pa.concat_arrays([pa.array(w2[open_[o]]), pa.array(settled, pa.int32())]),
                    pa.array(ids[row[runs]], pa.int64()),
                    pa.array(th[row[runs]], pa.int64()),
                    pa.array(pos[runs], pa.int32(), mask=~alone),
                    pa.array(places, pa.binary()),
                ],
                schema=schema,
            )
            del w1, w2, row, pos, order, later, open_, sure, places
            yield from _handed(made)

    return run


def _kept(k: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        + [("removed", pa.list_(pa.list_(pa.int32())))]
    )

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "single", "places"))
            for doc, text, single, places in zip(*columns):
                words = _WORDS.findall(text.encode())
                spans = removal_spans([np.array(single or [], "<i4").tobytes(), *(places or [])], k)
                gone = 0
                if spans:
                    parts, at = [], 0
                    for a, b in spans:
                        parts += words[at:a]
                        gone, at = gone + b - a, b
                    parts += words[at:]
                else:
                    parts = words
                out.append((doc, len(words), gone, hashlib.sha256(b" ".join(parts)).hexdigest(), spans))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def removal_spans(packed: list[bytes], k: int) -> list[list[int]]:
    """Maximal spans [a, b) of words that windows of k words at these starts cover."""
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i4") for x in packed)]))
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > k]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return [[int(a), int(b) + k] for a, b in zip(at[first], at[last])]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, removed (spans of words, end exclusive).

    A word goes when a window of ``window`` words over it also starts in a row of smaller doc_id.
    Words are runs of anything but space and tab to carriage return. A null id is smaller than any
    other; rows of one id do not remove from each other. Texts shorter than a window, empty and null
    ones keep all their words.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    # only rows that share their id need a hash of the text to tell them apart
    times = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    anchors = repeated_anchors(rows, window).groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    th = F.when(F.col("shared"), F.xxhash64("text")).otherwise(0)
    found = rows.join(anchors.join(times, "id"), "id").select("id", "text", "anchors", th.alias("th")).mapInArrow(
        _candidates(window), "w1 bigint, w2 int, id bigint, th bigint, place int, places binary"
    )
    found = found.withColumn("salt", F.when(F.col("w1").isNull(), F.xxhash64("id")).otherwise(0))
    group = Window.partitionBy("w1", "w2", "salt").orderBy("id")
    later = found.withColumn("least", F.first("id").over(group)).filter("w1 is null or id > least")
    lists = [F.collect_list("place").alias("single"), F.collect_list("places").alias("places")]
    gone = later.groupBy("id", "th").agg(*lists)
    # joined on the id alone, so that the texts dealt out for the first join serve here again
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("th", "single", "places")).alias("gone"))
    mine = F.filter("gone", lambda g: (g["th"] == 0) | (g["th"] == F.xxhash64("text")))
    return (
        rows.join(gone, "id", "left")
        .select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
            "text",
            F.get(mine, F.lit(0))["single"].alias("single"),
            F.get(mine, F.lit(0))["places"].alias("places"),
        )
        .mapInArrow(
            _kept(window),
            "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<array<int>>",
        )
    )
