"""SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut where no piece of the vocabulary can reach across, which the constructor proves from the
vocabulary itself. Each cut segment is encoded by an agenda of adjacent symbol pairs: the pair whose
piece has the best score merges first, leftmost among equals. Segments recur, so their results are
kept, as one string each, in two generations: when the young one is full the old one goes. The sentencepiece library encodes and decodes every segment a batch meets for the first time as
well, without the space it puts before a text, and a difference stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.tables import text_of
from tidepanel.llm.words import giving_back

#: Segments that a generation of the memo keeps, and code points of the longest one it keeps.
MEMO_SEGMENTS = 200_000
MEMO_CHARS = 64
SPACE = "▁"
#: Cuts to try, finest first: runs of letters, digits, or anything else, with the spaces before them.
_LETTER, _OTHER = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", r"(?:[^\w ]|[_\xb2\xb3\xb9\xbc-\xbe])"
CUTS = [rf" *(?:{_LETTER}+|\d|{_OTHER}+| (?= )|$)", r" *[^ ]+| +", r"(?s).+"]
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        how = model.normalizer_spec
        plain = how.name == "identity" and how.escape_whitespaces and not how.remove_extra_whitespaces
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type vocabulary with plain normalisation is needed")
        self.prefix = " " if how.add_dummy_prefix else ""
        # segments are parts of a text: compared without the space that is put before a whole one
        how.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece.replace(SPACE, " "): i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece.replace(SPACE, " "): p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        whole = (x for x in map(re.compile, CUTS) if all(x.findall(p) in ([p], [p, ""]) for p in self.ids))
        self.cut = next(whole)
        self._rank_pairs()
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _rank_pairs(self) -> None:
        """Every way to put a piece together from two, with the rank of its score: best first."""
        ranks = {x: k for k, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for piece, found in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.rank[left << 32 | right] = ranks[self.scores[piece]]
                    self.made[left << 32 | right] = found

    def agenda(self, segment: str) -> list[int]:
        """Ids of a segment; spaces are already in place."""
        known, rank = self.ids.get, self.rank.get
        parts = [known(c, -1) for c in segment]
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # entries hold rank and place; one whose place holds another pair by now is stale
        todo = []
        for i in range(n - 1):
            found = rank(parts[i] << 32 | parts[i + 1])
            if found is not None:
                todo.append(found << 32 | i)
        heapify(todo)
        while todo:
            entry = heappop(todo)
            i, best = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or rank(pair := parts[i] << 32 | parts[j]) != best:
                continue
            merged = parts[i] = self.made[pair]
            parts[j] = -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank(merged << 32 | parts[k])
                if found is not None:
                    heappush(todo, found << 32 | i)
            k = before[i]
            if k >= 0:
                found = rank(parts[k] << 32 | merged)
                if found is not None:
                    heappush(todo, found << 32 | k)
        if -1 not in parts:
            return [x for x in parts if x >= 0]
        out = []
        for x, sign in zip(parts, segment):
            if x >= 0:
                out.append(x)
            elif x == -1:
                out += [self.bytes[b] for b in sign.replace(" ", SPACE).encode()] if self.bytes else [self.unknown]
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: bytes are joined, marks become spaces, the space put before a text goes."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif i not in self.silent:
                parts.append(self.names[i].replace(SPACE, " "))
        if held:
            parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if first and self.prefix and text.startswith(" ") else text

    def segments(self, text: str) -> list[str]:
        return [x for x in self.cut.findall(self.prefix + text.replace(SPACE, " ")) if x] if text else []

    def meet(self, texts: list[list[str]]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids joined by commas of the segments of some texts, and the decoded texts that are not the segment itself.

        Those not yet known are encoded and compared with the library.
        """
        found = {s: self.known.get(s) or self.old.get(s) for x in texts for s in x}
        new = [s for s, ids in found.items() if ids is None]
        ours = [self.agenda(s) for s in new]
        theirs = self.library.encode(new, num_threads=1)
        other = {}
        for segment, ids, expected, text in zip(new, ours, theirs, self.library.decode(theirs)):
            if ids != expected:
                raise ValueError(f"segment {segment!r}: {ids} here, {expected} by the library")
            decoded = self.decode(ids, False)
            if decoded != text:
                raise ValueError(f"segment {segment!r}: decoded as {decoded!r} here, {text!r} by the library")
            found[segment] = ",".join(map(str, ids))
            if decoded != segment:
                other[segment] = decoded
        self._keep(found, other)
        return found, other

    def _keep(self, found: dict[str, str], other: dict[str, str]) -> None:
        for segment, ids in found.items():
            # one that decodes to something else is rare, and is met anew each time
            if len(segment) <= MEMO_CHARS and segment not in other:
                self.known[segment] = ids
                if len(self.known) >= MEMO_SEGMENTS:
                    self.old, self.known = self.known, {}

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.agenda(s)]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _digests(path: str):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = [
                    (
                        n,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(text.encode()).hexdigest(),
                    )
                    for ids, n, text in _coded(path, some.column("text").to_pylist())
                ]
                yield pa.record_batch(
                    [some.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[1:]))],
                    schema=schema,
                )

    return run


def _coded(path: str, texts: list[str]) -> Iterator[tuple[str, int, str]]:
    """Ids joined by commas, their number, and the text decoded from them."""
    model = piece_model(path)
    cut = [model.segments(x) for x in texts]
    known, other = model.meet(cut)
    for segments in cut:
        ids = ",".join([known[s] for s in segments])
        text = "".join([other.get(s, s) for s in segments] if other else segments)
        yield ids, ids.count(",") + 1 if ids else 0, text[1:] if model.prefix else text


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are exactly the sentencepiece library's, without begin and end ids. A null text counts as
    empty: no ids, and the digest of the empty string twice. Repeated rows give repeated results.
    """
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _digests(model), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids, decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = list(_coded(model, some.column("text").to_pylist()))
                ids = [[int(i) for i in x[0].split(",")] if x[0] else [] for x in out]
                yield pa.record_batch(
                    [some.column("doc_id"), pa.array(ids, schema.field("ids").type), pa.array([x[2] for x in out])],
                    schema=schema,
                )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")

