"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that
has one, and a bitmap that says which ids go on to the next level. A directory holds the number of set
bits before each block of 512, so the place of an id on the next level is a rank, and any id is read
with one step per chunk, without decoding its neighbours.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of
from tidepanel.llm.token_transducer import SPACES, Splitter, normal
from tidepanel.llm.words import giving_back, slices
from tidepanel.session import materialize

RANK_BLOCK = 512
SHARD_IDS = 1 << 20
MAGIC = b"DAC1"
#: Bytes of texts that are cut and looked up together.
SLICE_BYTES = 1 << 23
#: Words whose ids an encoder keeps, and bytes of the longest one it keeps.
MEMO_WORDS = 600_000
MEMO_BYTES = 64


def pack_ids(ids: np.ndarray) -> bytes:
    """Levels, one behind the other: count, chunks, whether a bitmap follows, bitmap, directory."""
    parts, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        deeper = bool(more.any())
        parts += [struct.pack("<QB", len(left), deeper), (left & 255).astype(np.uint8).tobytes()]
        if not deeper:
            return b"".join(parts)
        padded = np.zeros(-(-len(left) // RANK_BLOCK) * RANK_BLOCK, dtype=bool)
        padded[: len(left)] = more
        per_block = padded.reshape(-1, RANK_BLOCK).sum(axis=1)
        parts.append(np.packbits(padded, bitorder="little").tobytes())
        parts.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u8").tobytes())
        left = left[more] >> np.uint32(8)


class IdReader:
    """Reads single ids or ranges from packed ids."""

    def __init__(self, data: bytes | memoryview):
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        at, deeper = 0, True
        while deeper:
            n, deeper = struct.unpack_from("<QB", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if deeper:
                blocks = -(-n // RANK_BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * RANK_BLOCK // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", blocks + 1, at)
                at += 8 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BLOCK
        head = bits[block * RANK_BLOCK // 8 : i // 8]
        count = int(ranks[block]) + int(np.bitwise_count(head).sum())
        return count + int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else count

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(k, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b (exclusive)."""
        values = np.zeros(b - a, dtype=np.uint32)
        at = np.arange(b - a)
        for k, (chunks, bits, _) in enumerate(self.levels):
            values[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or a == b:
                break
            lo = a // 8 * 8
            more = np.unpackbits(bits[lo // 8 : -(-b // 8)], bitorder="little")[a - lo : b - lo].astype(bool)
            at = at[more]
            a, b = (self._rank(k, a), 0)
            b = a + len(at)
        return values


def pack_shard(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file image: magic, document ids, ends of documents in ids, packed ids."""
    ids = np.frombuffer(b"".join(x for _, x in docs), dtype="<u4")
    known = np.array([d is not None for d, _ in docs], dtype=np.uint8)
    names = np.array([d or 0 for d, _ in docs], dtype="<i8")
    ends = np.cumsum([len(x) // 4 for _, x in docs], dtype=np.int64).astype("<i8")
    head = MAGIC + struct.pack("<Q", len(docs))
    return head + known.tobytes() + names.tobytes() + ends.tobytes() + pack_ids(ids)


class ShardReader:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        (n,) = struct.unpack_from("<Q", data, 4)
        known = np.frombuffer(data, np.uint8, n, 12)
        names = np.frombuffer(data, "<i8", n, 12 + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.ends = np.frombuffer(data, "<i8", n, 12 + 9 * n)
        self.ids = IdReader(memoryview(data)[12 + 17 * n :])

    def document(self, k: int) -> np.ndarray:
        return self.ids.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def split_pieces(texts: pa.StringArray) -> pa.ListArray:
    """The pieces of each text between white space, as ``pieces`` cuts them; empty ones at its ends stay."""
    # words are lower-cased anyway; done at once for plain texts, more pieces are equal
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # the kernel takes these for white space
        return pc.split_pattern_regex(texts, f"[{SPACES}]+")
    return pc.utf8_split_whitespace(texts)


def join_runs(parts: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The parts between neighbouring ends joined to one cell."""
    _, offsets, data = parts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(parts) + 1, 8 * parts.offset)
    ends = np.ascontiguousarray(offsets[ends])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


class _Encoder:
    """Ids of texts as little-endian 32-bit integers.

    Of a slice of texts the different pieces between white space are cut into words together, and of
    these words the different ones are looked up; the library encodes those not met before together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.splitter = Splitter(path)
        self.model = self.splitter.library.model
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        suffix, vocabulary = self.splitter.model["end_of_word_suffix"], self.splitter.model["vocab"]
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = {b: c for b, c in enumerate(self.splitter.symbols) if b != ord(" ")}
        self.lines = regex.compile(rf"\n|{self.splitter.word_cut.pattern}")
        self.known = {b"\n": b""}

    def _word(self, word: bytes) -> bytes:
        """Ids of one word in UTF-8."""
        tokens = self.model.tokenize(word.decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words in UTF-8 that hold no white space, encoded as one text and cut where tokens end words."""
        text = b" ".join(words).decode("latin-1").translate(self.letters)
        (found,) = self.bare.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.closing[ids]) + 1)
        if len(ends) != len(words):  # a vocabulary whose tokens do not tell
            return list(map(self._word, words))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, all different; those of short words are kept, and dropped together when they are many."""
        if len(self.known) > MEMO_WORDS:
            self.known = {b"\n": b""}
        new = [w for w in words if len(w) <= MEMO_BYTES and w not in self.known]
        self.known.update(zip(new, self._encode(new)))
        return [self.known[w] if len(w) <= MEMO_BYTES else self._word(w) for w in words]

    def _lines(self, text: str) -> pa.LargeBinaryArray:
        """Ids of the lines of a text, all of them plain pieces."""
        words = pa.array(self.lines.findall(normal(text)), pa.large_string())
        ends = np.flatnonzero(pc.equal(words, "\n").to_numpy(zero_copy_only=False)) + 1
        if len(ends) != text.count("\n"):
            raise ValueError("a word holds a line break")
        coded = words.cast(pa.large_binary()).dictionary_encode()
        ids = pa.array(self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        return join_runs(ids.take(coded.indices), np.concatenate([[0], ends]))

    def _piece(self, piece: str) -> bytes:
        """Ids of any piece."""
        special = self.splitter.special
        words = self.splitter.words(piece)
        return b"".join([struct.pack("<I", special[w]) if isinstance(w, str) else self._words([w])[0] for w in words])

    def _pieces(self, pieces: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of pieces, all different."""
        alone = pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False)
        different = pieces.to_numpy(zero_copy_only=False)
        if not self.splitter.knows("".join(different)):
            alone = alone | [not self.splitter.knows(p) for p in different]
        ids = self._lines("\n".join([*different[~alone], ""]))
        if not alone.any():
            return ids
        rest = pa.array(list(map(self._piece, different[alone])), pa.large_binary())
        place = np.empty(len(different), dtype=np.int64)
        place[np.argsort(alone, kind="stable")] = np.arange(len(different))
        return pa.concat_arrays([ids, rest]).take(pa.array(place))

    def encode(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        cut = split_pieces(texts)
        coded = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy()
        return join_runs(self._pieces(coded.dictionary).take(coded.indices), ends - ends[0])


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _write(path: str, end_id: int, shard_ids: int):
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64())]
        + [("payload", pa.large_binary())]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def image(part: int, shard: int, docs: list) -> pa.RecordBatch:
        n = sum(len(x) for _, x in docs) // 4
        cells = (part, shard, docs[0][0], n, pack_shard(docs))
        return pa.record_batch([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        encoder = _encoder(path)
        part, shard, docs, held = 0, 0, [], 0
        for some in slices(batches, most=SLICE_BYTES):
            part = some.column("part")[0].as_py()
            for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text")).to_pylist()):
                docs.append((doc, ids + end))
                held += len(ids) // 4 + 1
                if held >= shard_ids:
                    yield image(part, shard, docs)
                    shard, docs, held = shard + 1, [], 0
        if docs:
            yield image(part, shard, docs)

    return giving_back(run)


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS, parts: int | None = None
) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; returns the written table of shards.

    Columns: part, shard (both ascending with doc_id), first_doc, n_ids, payload (the file image).
    Documents go whole into a shard, which is closed at ``shard_ids`` ids. A null id sorts first,
    repeated ids by their text; a null text has the end id only. The shards are written through Spark,
    since only its writers reach every kind of shared folder.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", text_of().alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    shards = ordered.mapInArrow(
        _write(tokenizer, end_id, shard_ids),
        "part int, shard int, first_doc bigint, n_ids bigint, payload binary",
    )
    return materialize(shards)


def _read():
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64())]
        + [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = ShardReader(batch.column("payload")[i].as_py())
                n = len(shard.doc_ids)
                crc = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(n)]
                before = np.concatenate([[0], shard.ends[:-1]])
                place = [pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("part", "shard")]
                yield pa.record_batch(
                    [
                        *place,
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(shard.ends - before, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    schema=schema,
                )

    return run


def read_ids(shards: DataFrame) -> DataFrame:
    """Per document of written shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    Starts of shards come from sums per part, so that no task sees all shards.
    """
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(by_part), F.lit(0)).alias("part_start"))
    by_shard = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part", "shard", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(by_shard), F.lit(0))).alias("at")
    )
    rows = shards.select("part", "shard", "payload").mapInArrow(
        _read(), "part int, shard int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards written earlier to ``path``."""
    return spark.read.parquet(path)
