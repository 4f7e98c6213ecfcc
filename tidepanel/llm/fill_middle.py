"""Fill-in-middle: whole texts cut into prefix, middle and suffix and put together in another order.

Cuts are counted in code points, texts are UTF-8 bytes. Per text a learned index answers "at which
byte does code point r begin": a few line segments fitted to all boundary offsets, none further than
``ERROR`` bytes off, and one small stored residual for each boundary that makes the answer exact. The
offsets themselves are only ever there for one block of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of

#: Most bytes a line may be off before its rounding; residuals are stored in one byte each.
ERROR = 60
#: Bytes of a text whose boundaries are laid out at once.
BLOCK = 1 << 20
#: Bytes of results in one batch.
SLICE = 4 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT_RATE, SUFFIX_FIRST_RATE = 90, 20


def fit_segments(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First index and slope of the segments of an increasing sequence.

    A segment starts at its first point and goes on while some slope passes all its points within
    ``error``: the slopes allowed so far are an interval that every further point can only narrow.
    """
    starts, slopes = [], []
    i, n = 0, len(y)
    while i < n:
        low, high = -np.inf, np.inf
        j, step = i + 1, 512
        while j < n:
            e = min(n, j + step)
            run = np.arange(j - i, e - i, dtype=np.float64)
            rise = (y[j:e] - y[i]).astype(np.float64)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            shut = int(np.searchsorted(lows > highs, True)) if lows[-1] > highs[-1] else e - j
            if shut:
                low, high = lows[shut - 1], highs[shut - 1]
            j += shut
            if j < e:
                break
            step *= 2
        starts.append(i)
        slopes.append((low + high) / 2 if j > i + 1 else 1.0)
        i = j
    return np.array(starts, np.int64), np.array(slopes)


class RankIndex:
    """From the rank of a code point to its first byte; rank ``n`` is the end of the text."""

    def __init__(self, text: bytes, error: int = ERROR, block: int = BLOCK):
        if not 1 <= error <= 120:
            raise ValueError("residuals of more than 120 bytes do not fit")
        data = np.frombuffer(text, np.uint8)
        starts, bases, slopes, residuals, n = [], [], [], [], 0
        for a in range(0, len(data) + 1, block):
            piece = data[a : a + block]
            y = np.flatnonzero((piece & 0xC0) != 0x80) + a
            if a + block > len(data):
                y = np.append(y, len(data))
            if not len(y):
                continue
            first, slope = fit_segments(y, error)
            ranks = np.arange(len(y))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(y))))
            line = y[first][owner] + np.rint((ranks - first[owner]) * slope[owner]).astype(np.int64)
            residuals.append((y - line).astype(np.int8))
            starts.append(first + n)
            bases.append(y[first])
            slopes.append(slope)
            n += len(y)
        self.n = n - 1
        self.starts, self.bases, self.slopes = (np.concatenate(x) for x in (starts, bases, slopes))
        self.residuals = np.concatenate(residuals)

    def predict(self, rank: int) -> int:
        """Where the segment's line has the boundary; off by at most the error of the fit and a half."""
        k = int(np.searchsorted(self.starts, rank, side="right")) - 1
        return int(self.bases[k]) + int(np.rint((rank - self.starts[k]) * self.slopes[k]))

    def offset(self, rank: int) -> int:
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        return self.predict(rank) + int(self.residuals[rank])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers that the seed and the id decide; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id: int | None, text: bytes, seed: int = 1) -> tuple:
    """n, form, prefix_chars, middle_chars, output, segments of the index."""
    index = RankIndex(text)
    n, segments = index.n, len(index.starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= CUT_RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text, segments
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offset(first), index.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_RATE:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, first, second - first, b"".join(parts), segments


def _fill(seed: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64())]
        + [("middle_chars", pa.int64()), ("output", pa.binary()), ("segments", pa.int64())]
    )
    out_schema = schema.set(5, pa.field("output", pa.string()))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]
        columns[5] = columns[5].cast(pa.string())
        return pa.record_batch(columns, schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, size = [], 0
            for doc, text in zip(ids, texts):
                doc = doc.as_py()
                text = text.as_py().encode()
                rows.append((doc, *transform(doc, text, seed)))
                size += len(text)
                if size >= SLICE:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n (code points), form, prefix_chars, middle_chars, output, segments.

    Form is plain (the text as it is), psm or spm; ids decide forms and cuts, so runs agree and rows
    that repeat an id and a text have one result. A null text is an empty one; an empty text, and one
    that holds a mark, stays plain; cuts may meet or lie at either end, which leaves a part empty. A
    null id counts as an empty one. A text of any length is one row: its index takes a byte per code
    point, its offsets a block at a time. Other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(
        _fill(seed),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, segments bigint",
    )


def _between(output: Column, left: bytes, right: bytes) -> Column:
    head = F.substring_index(output, right.decode(), 1)
    return F.substring_index(head, left.decode(), -1)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. Each mark is there once, so it divides."""
    middle = F.substring_index(output, MIDDLE.decode(), -1)
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """As ``fill_in_middle``, the output and the text restored from it as SHA-256."""
    filled = fill_in_middle(docs, seed)
    return filled.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
        "segments",
    )
