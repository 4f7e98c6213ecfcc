"""Token counts by a finite-state transducer compiled from a BPE tokenizer file.

A BPE encoding is the one sequence of tokens in which every two neighbours stay apart when they are
encoded together. So what the next symbol does depends only on the last token of the encodings of the
few prefixes that a longer token could still reach back to. That is the state. The transition for a
symbol carries the number of tokens it adds (or takes back, where tokens merge), so a word's count is
the sum along its path. States are made when first met and thrown away together when they are many.

Text is cut into chunks. The count of a chunk depends on the text before it only up to its first
white space, since no token and no special string holds any; its state map is therefore (open head,
tokens between, open tail), and maps of neighbouring chunks compose associatively. Spark composes the
maps of a document by a prefix scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of

CHUNK_CHARS = 1 << 16
MEMO_PIECES = 600_000
MAX_STATES = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, free = {}, 256
    for b in range(256):
        symbols[b] = chr(b) if b in plain else chr(free)
        free += b not in plain
    return [symbols[b] for b in range(256)]


class Transducer:
    """Counts the tokens of words; symbols are byte values, 256 more for the last byte of a word."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        names = byte_symbols()
        symbol = {names[b]: (b,) for b in range(256)} | {names[b] + suffix: (256 + b,) for b in range(256)}
        self.ranks: dict[tuple, int] = {}
        self.tokens: set[tuple] = set(symbol.values())
        for rank, (left, right) in enumerate(merges):
            a, b = symbol[left], symbol[right]
            self.ranks.setdefault((a, b), rank)
            symbol[left + right] = a + b
            self.tokens.add(a + b)
        self.heads = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.apart: dict[tuple, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {((), ((), 0)): 0}
        self.content: list[tuple] = [((), (((), 0),))]
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, symbols: tuple) -> list[tuple]:
        """Plain BPE: merges the pair of best rank, leftmost first, until none is left."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            ranked = [(self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, a: tuple, b: tuple) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 4 * MAX_STATES:
                self.apart.clear()
            known = self.apart[a, b] = self.encode(a + b) == ([a, b] if a else [b])
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens added; builds the transition."""
        tail, ends = self.content[state]
        grown = tail + (symbol,)
        for i, end in enumerate(ends):
            token = grown[i:]
            if end is not None and token in self.tokens and self.stay_apart(end[0], token):
                count = end[1]
                break
        else:
            raise ValueError("no token ends here")
        added = count + 1 - ends[-1][1]
        ends = (*ends, (token, count + 1))
        keep = next((i for i in range(len(grown)) if grown[i:] in self.heads), len(grown))
        base = count + 1
        tail = grown[keep:]
        # only the places where a token may have begun matter later
        content = (
            tail,
            tuple(
                (end[0], end[1] - base) if end and (i == len(tail) or tail[i:] in self.heads) else None
                for i, end in enumerate(ends[keep:])
            ),
        )
        if content not in self.states:
            self.states[content] = len(self.content)
            self.content.append(content)
            self.arcs.append({})
        arc = self.arcs[state][symbol] = (self.states[content], added)
        return arc

    def count(self, word: bytes) -> int:
        """Tokens of one word that is not empty."""
        if len(self.content) > MAX_STATES:
            self.forget()
        state, total, arcs = 0, 0, self.arcs
        for b in word[:-1]:
            arc = arcs[state].get(b) or self.step(state, b)
            state = arc[0]
            total += arc[1]
        last = 256 + word[-1]
        return total + (arcs[state].get(last) or self.step(state, last))[1]


class Splitter:
    """Cuts pieces of text without white space into special strings and words, as a tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if self.model["type"] != "BPE" or not split["invert"] or self.model["end_of_word_suffix"] is None:
            raise ValueError("a BPE file with word ends is needed")
        if any(t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("special strings that are normalised or hold white space are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word_cut = regex.compile(split["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.symbol_bytes = {c: b for b, c in enumerate(self.symbols)}
        self.same: dict[int, bool] = {}

    def agrees(self, block: int) -> bool:
        """Whether the characters of a block of 256 are normalised and split here as by the library.

        Versions of Unicode differ in a few, mostly unassigned, characters.
        """
        known = self.same.get(block)
        if known is None:
            signs = [chr(c) for c in range(256 * block, 256 * block + 256) if not 0xD800 <= c < 0xE000]
            known = self.same[block] = all(
                [w.encode() for w in self.word_cut.findall(normal(x))] == self.library_words(x)
                for c in signs
                for x in (f"a{c}a", f"1{c}!")
            )
        return known

    def library_words(self, text: str) -> list[bytes]:
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.symbol_bytes[c] for c in word) for word, _ in split]

    def knows(self, text: str) -> bool:
        """Whether all characters of a text are split here as by the library."""
        return text.isascii() or all(map(self.agrees, {ord(c) >> 8 for c in set(text)}))

    def words(self, piece: str) -> list[bytes | str]:
        """Words in UTF-8; special strings stay strings."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower().encode()]
        elif not self.knows(piece):
            return self._around_special(piece, self.library_words)
        if "<|" in piece:
            return self._around_special(piece, self._plain)
        return self._plain(piece)

    def _plain(self, piece: str) -> list[bytes | str]:
        return [w.encode() for w in self.word_cut.findall(normal(piece))]

    def _around_special(self, piece: str, plain: Callable) -> list[bytes | str]:
        out = []
        for part in self.special_cut.split(piece):
            out += [part] if part in self.special else plain(part) if part else []
        return out


class Counter:
    """Token counts of pieces of text without white space, for one tokenizer file."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(merges, model["end_of_word_suffix"])

    def piece(self, text: str) -> int:
        count = self.transducer.count
        return sum(1 if isinstance(w, str) else count(w) for w in self.splitter.words(text))


def normal(text: str) -> str:
    """Canonical composition, then lower case letter by letter (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


#: The characters that end pieces: Unicode's White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The runs of other characters."""
    if _ODD.search(text):  # str.split() takes these four for white space
        return [x for x in _SPACES.split(text) if x]
    return text.split()


class Memo(dict):
    """Values of pieces, worked out when missing; dropped together when they are many."""

    def __init__(self, make: Callable[[str], object], most: int = MEMO_PIECES, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def _counts(path: str) -> Memo:
    return Memo(Counter(path).piece)


#: State map of a chunk: tokens between its first and last white space, the open text before and
#: after them. Without white space all of it is head, and tail is None.
StateMap = tuple[int, str, "str | None"]


def state_map(chunk: str, count: Callable[[str], int]) -> StateMap:
    parts = _SPACES.split(chunk)
    if len(parts) == 1:
        return 0, chunk, None
    return sum(map(count, filter(None, parts[1:-1]))), parts[0], parts[-1]


def compose(a: StateMap, b: StateMap, count: Callable[[str], int]) -> StateMap:
    """The map of chunk a followed by chunk b; associative."""
    if a[2] is None:
        return b[0], a[1] + b[1], b[2]
    if b[2] is None:
        return a[0], a[1], a[2] + b[1]
    joint = a[2] + b[1]
    return a[0] + b[0] + (count(joint) if joint else 0), a[1], b[2]


def prefix_scan(maps: list[StateMap], count: Callable[[str], int]) -> list[StateMap]:
    """All prefix compositions, by halving: pairs, scan of the pairs, then the maps in between."""
    if len(maps) < 2:
        return list(maps)
    halves = prefix_scan([compose(a, b, count) for a, b in zip(maps[::2], maps[1::2])], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(halves[i // 2] if i % 2 else compose(halves[i // 2 - 1], maps[i], count))
    return out


def closed(m: StateMap, count: Callable[[str], int]) -> int:
    """Tokens of a text whose map is m."""
    return m[0] + sum(count(x) for x in (m[1], m[2]) if x)


def _chunk_maps(path: str, size: int):
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int32())]
        + [("inner", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counts(path)
        count = memo.__getitem__
        for batch in batches:
            out = []
            for row, doc, n, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes", "text"))):
                if len(text) <= size:
                    out.append((row, doc, n, 0, sum(map(count, pieces(text))), None, None))
                else:
                    for k in range(0, len(text), size):
                        out.append((row, doc, n, k // size, *state_map(text[k : k + size], count)))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def _scan_maps(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counts(path).__getitem__
        for batch in batches:
            totals = batch.column("inner").to_pylist()
            for i, maps in enumerate(batch.column("maps").to_pylist()):
                if maps:
                    last = prefix_scan([(m["inner"], m["head"], m["tail"]) for m in maps], count)[-1]
                    totals[i] = closed(last, count)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], schema=schema
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, most: int = 2048, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > most).

    Counts are those of the tokenizers library without special tokens added; special strings inside
    a text count as their token. A null text counts as empty and has 0 tokens; repeated ids are
    counted row by row. A run without white space is read as one piece, however long.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.octet_length(text_of()).cast("bigint").alias("n_bytes"),
        text_of().alias("text"),
    )
    maps = rows.mapInArrow(
        _chunk_maps(tokenizer, chunk_chars),
        "row bigint, doc_id bigint, n_bytes bigint, chunk int, inner bigint, head string, tail string",
    )
    open_map = F.when(F.col("head").isNotNull(), F.struct("chunk", "inner", "head", "tail"))
    found = (
        maps.groupBy("row", "doc_id", "n_bytes")
        .agg(F.sum("inner").alias("inner"), F.array_sort(F.collect_list(open_map)).alias("maps"))
        .mapInArrow(_scan_maps(tokenizer), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    )
    return found.withColumn("over_limit", F.col("n_tokens") > most)
