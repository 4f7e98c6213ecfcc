"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so the pairwise interactions cost time in proportion to the features of a document. Words enter as
hash buckets weighted by their share of the document, structure as shares and logarithms of counts,
metadata as the logarithm of the length in characters. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of
from tidepanel.llm.words import giving_back, slices, text_bytes, text_groups

BUCKETS = 1 << 13
RANK = 4
#: Labelled documents that the model is fitted on, at most; those of least hash of the id.
FIT_ROWS = 8_000
CUT = 0.3

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "mark": (33, 63, 46, 44, 59, 58),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126),
    "bar": (124,),
    "shout": (33,),
    "line": (10,),
    "high": range(128, 256),
}
STATISTICS = [*_CLASSES, "space", "words", "word_bytes", "distinct", "top_word", "repeated_pairs", "chars", "short"]


def _statistics(data: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> list[float]:
    counts = np.bincount(data, minlength=256)
    n = max(len(data), 1)
    shares = [float(counts[list(c)].sum()) / n for c in _CLASSES.values()]
    m = max(len(words), 1)
    _, times = np.unique(words, return_counts=True)
    pairs = np.unique(words[1:] * np.uint64(31) + words[:-1]) if len(words) > 1 else words
    return [
        *shares,
        float(counts[[9, 10, 13, 32]].sum()) / n,
        np.log1p(len(words)) / 8,
        float(lengths.mean()) / 8 if len(words) else 0.0,
        len(times) / m,
        float(times.max()) / m if len(times) else 0.0,
        1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        np.log1p(len(data) - int(((data & 0xC0) == 0x80).sum())) / 10,
        float((lengths < 3).sum()) / m,
    ]


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: places and values of its features; statistics first, then word buckets."""
    data, offsets = text_bytes(column)
    for i, j, words in text_groups(column, lower=True):
        buckets = (words.h % np.uint64(BUCKETS)).astype(np.int64) + len(STATISTICS)
        for t in range(j - i):
            a, b = words.first[t], words.first[t + 1]
            found, times = np.unique(buckets[a:b], return_counts=True)
            stats = _statistics(data[offsets[i + t] : offsets[i + t + 1]], words.h[a:b], (words.ends - words.starts)[a:b])
            values = np.sqrt(times / max(b - a, 1))
            yield np.concatenate([np.arange(len(STATISTICS)), found]), np.concatenate([stats, values])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, values: np.ndarray) -> np.ndarray:
        k = len(STATISTICS)
        return np.concatenate([(values[:k] - self.mean) / self.spread, values[k:]])

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        x = self.scaled(values)
        v = self.factors[places]
        inner = x @ v
        z = self.bias + self.weights[places] @ x + 0.5 * float((inner**2 - (x**2) @ v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, seed: int = 5) -> Machine:
    """Adaptive gradient descent on the logistic loss, in mini-batches of a fixed random order.

    Both classes weigh alike; without rows of both, the score is the share of label 1 everywhere.
    """
    size, k = len(STATISTICS) + BUCKETS, len(STATISTICS)
    rng = np.random.default_rng(seed)
    stats = np.array([v[:k] for _, v in rows]).reshape(-1, k)
    mean = stats.mean(axis=0) if len(rows) else np.zeros(k)
    spread = stats.std(axis=0) + 1e-3 if len(rows) else np.ones(k)
    share = float(labels.mean()) if len(rows) else 0.5
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, RANK)), mean, spread)
    if not len(rows) or not 0 < share < 1:
        machine.factors[:] = 0
        machine.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return machine
    machine.bias = float(np.log(share / (1 - share)))
    data = [(p, machine.scaled(v)) for p, v in rows]
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    w, v = machine.weights, machine.factors
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(data)), -(-len(data) // 32)):
            places = np.concatenate([data[i][0] for i in at])
            x = np.concatenate([data[i][1] for i in at])
            edges = np.concatenate([[0], np.cumsum([len(data[i][0]) for i in at])[:-1]])
            owner = np.repeat(np.arange(len(at)), [len(data[i][0]) for i in at])
            vx = v[places] * x[:, None]
            inner = np.add.reduceat(vx, edges, axis=0)
            z = machine.bias + np.add.reduceat(w[places] * x, edges)
            z = z + 0.5 * (inner**2 - np.add.reduceat(vx**2, edges, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / len(at)
            slope = error[owner] * x
            gw = np.bincount(places, slope, size) + 1e-5 * w
            gv = np.zeros_like(v)
            np.add.at(gv, places, slope[:, None] * (inner[owner] - vx))
            gv += 1e-4 * v * (gv != 0)
            seen_w += gw**2
            seen_v += gv**2
            w -= 0.1 * gw / np.sqrt(seen_w)
            v -= 0.05 * gv / np.sqrt(seen_v)
            gb = float(error.sum())
            seen_b += gb**2
            machine.bias -= 0.1 * gb / np.sqrt(seen_b)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurize():
    schema = pa.schema([("quality", pa.int32()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(features(batch.column("text")))
            yield pa.record_batch(
                [
                    batch.column("quality"),
                    pa.array([p for p, _ in rows], schema.field("places").type),
                    pa.array([v.astype(np.float32) for _, v in rows], schema.field("values").type),
                ],
                schema=schema,
            )

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``fit_rows`` labelled documents that are not held out.

    The bound is the size of the fitting sample, taken by hash of the id, and of the only broadcast.
    A document labelled more than once counts with its highest label; null ids and labels are no
    labels.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    rows = (
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("quality", "text", F.xxhash64("doc_id", "text").alias("order"))
        .sort("order")
        .select("quality", "text")
        .mapInArrow(_featurize(), "quality int, places array<int>, values array<float>")
        .toArrow()
    )
    labels_of = rows.column("quality").to_numpy().astype(float)
    pairs = [
        (np.asarray(p.values, np.int64), np.asarray(v.values, np.float64))
        for p, v in zip(rows.column("places"), rows.column("values"))
    ]
    return fit(pairs, labels_of)


def _score(machine: Machine):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(p, v) for p, v in features(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= cut).

    A null text scores as an empty one; the score depends on the text alone.
    """
    scored = docs.select("doc_id", text_of().alias("text")).mapInArrow(_score(machine), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def _keep(machine: Machine, cut: float):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = [machine.score(p, v) >= cut for p, v in features(part.column("text"))]
            yield part.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    The score depends on the text alone: rows that repeat a text go together, and a null text counts
    as an empty one. Rows pass through in pieces of a few megabytes of texts, one longer text by
    itself. Nulls in other columns, and an empty table, stay as they are.
    """
    return docs.mapInArrow(_keep(machine, cut), docs.schema)
