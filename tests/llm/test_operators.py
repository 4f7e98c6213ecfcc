"""The operators against brute force and the libraries, on small tables with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import fingerprints, ngram_join, personal_data, piece_bpe, quality, source_mix, substring_dedup, token_files, words
from tidepanel.llm.components import components
from tidepanel.llm.exact_dedup import drop_copies, mark_copies
from tidepanel.llm.piece_bpe import PieceModel, encode_digests, encode_ids
from tidepanel.llm.signature_trees import Tree, bitmap, candidate_pairs, could_link, required
from tidepanel.llm.substring_dedup import remove_repeats
from tidepanel.llm.token_files import IdReader, pack_ids, read_ids, write_ids
from tidepanel.llm.token_transducer import Counter, closed, count_tokens, pieces, prefix_scan, state_map

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h string, a bigint"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = text(40)
    base = text(120).split(" ")
    texts = [text(rng.randint(0, 80)) for _ in range(30)]
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(6)]
    for _ in range(40):  # near copies
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [" ".join(base).upper(), " ".join(base), texts[0], texts[0], "", "", " \n\t", "one", "One", "a b c", "a b c"]
    texts += [passage + " " + passage, "x " * 3000, "é" * 500, "it's <|endoftext|> ▁ 你好\x1c!", "\x00\x0b"]
    texts.append(text(30000))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t), "r", "h", i) for i, t in enumerate(texts)]
    rows += [(200, None, None, None, None, None, None, None), rows[0], rows[30]]
    rows += [(None, texts[3], "en", "s1", 1, "r", "h", 1), (None, "null id", None, None, 1, "r", "h", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0, *map(str, row[1:]))


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_words_are_runs_of_other_bytes(monkeypatch):
    texts = ["a b  c\n", "", None, " x\x0byy", "abc", "ABC d", "w" * 50]
    whole = [words.words_of(t, True).tolist() for t in texts]
    monkeypatch.setattr(words, "BLOCK", 8)
    assert [words.words_of(t, True).tolist() for t in texts] == whole
    assert [len(x) for x in whole] == [3, 0, 0, 2, 1, 2, 1]
    assert whole[4][0] == whole[5][0]


def test_token_counts_equal_the_library(docs, rows):
    library = Tokenizer.from_file(WORD_FILE)
    want = []
    for row in rows:
        text = row[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((row[0], len(text.encode()), n, n > 100))
    same(count_tokens(docs, WORD_FILE, most=100, chunk_chars=37).collect(), want)


def test_transducer_equals_the_library_on_odd_texts():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(25)) for _ in range(300)]
    texts += ["ΑΣ ΣΑΣ İs 's've'Sx", "<|ENDOFTEXT|>a<|startoftext|>", "aaaa" * 200, "½²x 12  b"]
    counter, library = Counter(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    for text in texts:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert sum(map(counter.piece, pieces(text))) == want
        maps = [state_map(text[k : k + 6], counter.piece) for k in range(0, len(text), 6)]
        assert closed(prefix_scan(maps, counter.piece)[-1], counter.piece) == want


def test_token_files_round_trip(docs, rows):
    library = Tokenizer.from_file(WORD_FILE)
    coded = []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [1]
        coded.append((row[0], ids))
    want, at = [], 0
    for doc, ids in coded:
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(read_ids(write_ids(docs, WORD_FILE, 1, shard_ids=500, parts=3)).collect(), want)


def test_each_word_is_encoded_once(monkeypatch):
    """Whatever stands around a word, the library gets it once, and only different pieces are cut."""
    encoder = token_files._Encoder(WORD_FILE)
    given, cut = [], []
    encode, lines = encoder._encode, encoder._lines
    monkeypatch.setattr(encoder, "_encode", lambda words: given.extend(words) or encode(words))
    monkeypatch.setattr(encoder, "_lines", lambda text: cut.extend(text.split()) or lines(text))
    texts = ["Word, word. (WORD) word!", "word, other word\nother", "éa éa, word"] * 50
    want = library_ids(texts)
    for _ in range(2):
        assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert sorted(w for w in given if w.isalpha()) == [b"other", b"word"] and len(given) == len(set(given))
    assert len(cut) == 2 * len(set(cut))


def library_ids(texts: list[str]) -> list[bytes]:
    library = Tokenizer.from_file(WORD_FILE)
    return [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_ids_of_odd_texts(monkeypatch):
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    between = ["", "", "a", "A", *filter(str.isspace, signs)]
    texts = ["".join(rng.choice(signs) + rng.choice(between) for _ in range(40)) for _ in range(300)]
    texts += ["", " ", "\x1c", "a\x1cb !\x1d! \x1f", "H\u0331 h\u0331 \u0331x \n\u0301", "ΑΣ ΣΑΣ İs 's've'Sx"]
    texts += ["</w> <|endoftext|>A<|", "aB" * 5000, "<|ENDOFTEXT|> x<|startoftext|>é", "½²x it's\u3000  they'LL ", *texts[:3]]
    encoder, want = token_files._Encoder(WORD_FILE), library_ids(texts)
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert encoder.encode(pa.array(texts).slice(200)).to_pylist() == want[200:]
    monkeypatch.setattr(token_files, "MEMO_WORDS", 5)
    assert [x for t in texts for x in encoder.encode(pa.array([t])).to_pylist()] == want
    encoder.closing[:] = False  # where tokens do not tell the ends of words, words are encoded one by one
    encoder.known = {b"\n": b""}
    assert encoder.encode(pa.array(texts)).to_pylist() == want


def test_any_id_is_read_alone():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        reader = IdReader(pack_ids(ids))
        assert len(reader) == n and [reader[i] for i in range(n)] == ids.tolist()
        assert np.array_equal(reader.range(n // 3, n), ids[n // 3 :])


def test_pieces_equal_the_library(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    want = []
    for row in rows:
        ids = library.encode(row[1] or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((row[0], len(ids), *digests))
    same(encode_digests(docs, PIECE_FILE).collect(), want)
    model = PieceModel(PIECE_FILE)
    for text in ["  a", "a  b ", " ", "\r\n;\r\n", "x².y", "▁x▁▁y", "日本", "a\x00b"]:
        assert model.encode(text) == library.encode(text)
        assert model.decode(library.encode(text)) == library.decode(library.encode(text))
    got = {r.decoded for r in encode_ids(docs.filter("doc_id < 9"), PIECE_FILE).collect()}
    assert got == {r[1] for r in rows if r[0] is not None and r[0] < 9}


def test_memo_of_pieces_stays_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO_SEGMENTS", 50)
    rng = random.Random(8)
    model, library = PieceModel(PIECE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdé▁x", k=rng.randint(1, 90))) for _ in range(15)) for _ in range(3)]
        known, other = model.meet([model.segments(x) for x in texts])
        for text in texts:
            assert ",".join(known[s] for s in model.segments(text)) == ",".join(map(str, library.encode(text)))
            assert "".join(other.get(s, s) for s in model.segments(text))[1:] == library.decode(library.encode(text))
        # one string for a segment, in two generations of which neither outgrows its bound
        assert len(model.known) < 50 and len(model.old) <= 50
        assert all(len(s) <= piece_bpe.MEMO_CHARS and isinstance(ids, str) for s, ids in model.known.items())


def lower(text):
    return (text or "").encode().lower().decode()


def test_exact_copies(docs, rows):
    for hashed in (None, lambda text: F.substring(F.md5(text), 1, 1)):
        got = mark_copies(docs, hashed).collect() if hashed else mark_copies(docs).collect()
        groups = {}
        for row in rows:
            groups.setdefault(lower(row[1]), []).append(row[0])
        want = []
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep = max(known) if known else None
            digest = hashlib.sha256(text.encode()).hexdigest()
            seen = False
            for i in ids:
                want.append((i, keep, len(ids), i == keep and not seen, digest))
                seen = seen or i == keep
        same(got, want)
    kept = drop_copies(docs).collect()
    assert len({lower(r.text) for r in kept}) == len(kept) == len(groups)
    assert kept[0].asDict().keys() == {*docs.columns}


def test_repeated_passages_are_handed_over_in_bounded_pieces():
    text = " ".join(f"w{i}" for i in range(3 * substring_dedup.HANDED))
    ((_, _, found),) = words.text_groups(pa.array([text]))
    anchors = np.unique(substring_dedup._windows(found, 13, 0)[1]).view(np.int64) >> 32
    batch = pa.record_batch(
        [pa.array([1]), pa.array([0]), pa.array([anchors.astype(np.int32)]), pa.array([text])],
        names=["id", "th", "anchors", "text"],
    )
    made = list(substring_dedup._candidates(13)(iter([batch])))
    assert sum(b.num_rows for b in made) == 3 * substring_dedup.HANDED - 12
    assert max(b.num_rows for b in made) <= substring_dedup.HANDED
    # a window of one place has no list beside the number
    assert all(b.column("places").null_count == b.num_rows for b in made)
    steps = (substring_dedup._anchors, substring_dedup._candidates, substring_dedup._kept)
    assert all(hasattr(step(13), "__wrapped__") for step in steps)  # memory goes back after each task


def test_repeated_passages(docs, rows):
    first = {}
    for row in rows:
        w = WORDS.findall((row[1] or "").encode())
        number = -1 if row[0] is None else row[0]
        for i in range(len(w) - 12):
            window = tuple(w[i : i + 13])
            first[window] = min(first.get(window, number), number)
    want = []
    for row in rows:
        w = WORDS.findall((row[1] or "").encode())
        number = -1 if row[0] is None else row[0]
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < number for j in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    same(remove_repeats(docs).drop("removed").collect(), want)
    assert sum(r[2] for r in want) > 100


def shingle_sets(rows):
    out = []
    for row in rows:
        w = WORDS.findall((row[1] or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_near_copies(docs, rows):
    sets = shingle_sets(rows)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    want = [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]
    same(ngram_join.near_copies(docs).drop("root", "th").collect(), want)
    kept = ngram_join.drop_near_copies(docs).collect()
    assert len(kept) == len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_trees_leave_no_possible_pair_out():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = []
    for k in range(120):
        size = int(rng.integers(5, 400))
        own = rng.integers(0, 1 << 62, int(rng.integers(0, 40)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[:size], own])))
    n = np.array([len(s) for s in sets])
    bits = [bitmap(s).tobytes() for s in sets]
    pos, part = np.zeros(120, np.int64), np.arange(120) // 3
    links = set()
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                assert both >= required(n[i], n[j], 75) and could_link(n[i], bits[i], n[j], bits[j], 75)
                if part[i] != part[j]:
                    links.add((j, i))
    found = {tuple(sorted(p)) for p in candidate_pairs(Tree(n, pos, bits, part), None, 75)}
    assert links <= found and len(found) < 120 * 119 // 2
    a, b = range(50), range(50, 120)
    halves = [Tree(n[x], pos[x], [bits[i] for i in x], part[x]) for x in (np.array(a), np.array(b))]
    assert {p for p in links if p[0] < 50 <= p[1]} <= {(p, q + 50) for p, q in candidate_pairs(*halves, 75)}


def variants(number, words_=60, edits=8, seed=5):
    """Near copies of one text, from few edits to so many that nothing links them."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words_)]
    out = []
    for k in range(number):
        edited = list(base)
        for _ in range(rng.randint(0, edits)):
            edited[rng.randrange(words_)] = f"e{rng.randrange(1 << 30)}"
        out.append(edited)
    return out


def linked(sets, side=None):
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if (side is None or side[i] != side[j]) and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {frozenset(i for i, g in enumerate(group) if g == top) for top in set(group)}


def grouped(pairs, count):
    group = list(range(count))
    for i, j in pairs:
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    return {frozenset(i for i, g in enumerate(group) if g == top) for top in set(group)}


def test_exact_links_are_a_forest_of_all_links():
    sets = [{hash(tuple(t[i : i + 5])) for i in range(56)} for t in variants(150)]
    sets = [*{frozenset(s): s for s in sets}.values()]
    arrays = [np.sort(np.array([*s], np.int64)) for s in sets]
    for side in (None, np.arange(len(sets)) % 2):
        for many in (len(sets), 7):
            part = None if side is None else side[:many]
            found = ngram_join.exact_links([*range(many)], arrays[:many], part, 75)
            assert grouped(found, many) == linked(sets[:many], part)
            assert len(found) == many - len(linked(sets[:many], part))


def test_large_group_of_near_copies_makes_no_pairs():
    """A group of m sets gives less than m rows, however many of its pairs could link."""
    sets = [np.unique(np.array([hash(tuple(t[i : i + 5])) for i in range(56)]).view(np.uint64)) for t in variants(900, edits=3)]
    rows = sorted((len(s), i, bitmap(s).tobytes()) for i, s in enumerate(sets))
    n, a, bits = zip(*rows)
    batch = pa.record_batch(
        [pa.array(x) for x in ([7] * 900, [0] * 900, n, [0] * 900, a, bits)], names=["key", "salt", "n", "pos", "a", "bits"]
    )
    run = ngram_join._in_groups(75)
    pairs = [p for out in run(iter([batch, batch])) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert len(pairs) < 900
    # sets that later blocks leave apart are compared in pairs of blocks
    part = {}
    for group in grouped(pairs, 900):
        part |= dict.fromkeys(group, min(group))
    halves = [(7, 0, 1, i % 2, len(sets[i]), 0, part[i], bitmap(sets[i]).tobytes()) for i in range(900)]
    names = ["key", "low", "high", "block", "n", "pos", "part", "bits"]
    run = ngram_join._between_blocks(75)
    more = pa.record_batch([pa.array(x) for x in zip(*halves)], names=names)
    pairs += [p for out in run(iter([more])) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert len(pairs) < 900
    groups = grouped(pairs, 900)
    for i, j in [(i, j) for i in range(0, 900, 2) for j in range(1, 900, 40)]:
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            assert any({i, j} <= g for g in groups)


def test_near_copies_dealt_out_in_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("PAIR_BLOCK", 16), ("ELEMENTS", 500), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = [" ".join(t) for t in variants(120)]
    texts += texts[:20]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    want = {i: min(g) for g in linked(sets) for i in g}
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.near_copies(docs).collect()}
    assert got == want and 1 < len(set(want.values())) < 120


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want


def base_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    found += [("ip", m) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        found += [("card", m)] if 16 <= len(digits) <= 19 and total % 10 == 0 else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [("phone", m)] if 8 <= sum(c.isdigit() for c in m[0]) <= 15 else []
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_personal_data(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "a@b.c+d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "+1 (234) 555-7713"]
    parts += ["+12", " ", "-", ".", "@", "é", "𝄞", "\n", "4111111111111111", "4111 1111 1111 1111", "411111111111111123"]
    parts += ["5", "12-34", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "123-45-6789", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "1.2.3.4 " * 300, "a" * 3000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for row in personal_data.span_digests(personal_data.find_personal_data(table)).collect():
        want = base_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert row.spans.startswith(want)
        assert row.n_email == want.count("email:") and row.n_card == want.count("card:")
    found = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789"), (2, "GB83 WEST 1234 5698 7654 32, 123-45-6789")], "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in personal_data.span_digests(personal_data.find_personal_data(found)).collect()}
    assert spans == {1: "iban:5:32,ssn:38:49", 2: ""}


def test_context_counts_on_both_sides(spark):
    texts = ["4111 1111 1111 1111 is my credit card", "credit card 4111 1111 1111 1111", "4111 1111 1111 1111 it is"]
    texts += ["10.0.0.1 server", "10.0.0.1 and 10.0.0.2", "x 123-45-6789 is my social security number", "123-45-6789 so"]
    texts += ["10.0.0.1" + " x" * 30 + " server", "10.0.0.1 10.0.0.2 server"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [s.score for k in ("card", "ip", "ssn") for s in r[k]] for r in personal_data.find_personal_data(docs).collect()}
    assert got == {0: [0.95], 1: [0.95], 2: [0.8], 3: [0.8], 4: [0.6, 0.6], 5: [0.8], 6: [], 7: [0.6], 8: [0.6, 0.8]}


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_edits(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for row, follower in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = row[1] or "", follower[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], want)
    want = []
    for row, follower in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = row[1] or "", follower[1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        mine, other, following = map(plain_sketch, (text, edited, after))
        near = [len(mine & x) / len(mine | x) if mine | x else 1.0 for x in (other, following)]
        low = {h for h in mine if h < LOW}
        inside = [len(low & x) / len(low) if low else None for x in (other, following)]
        texts = [",".join(f"{h & (1 << 64) - 1:x}" for h in sorted(x)) for x in (mine, other)]
        want.append((row[0], *texts, *near, *inside))
    names = ("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next")
    same([tuple(r[n] for n in names) for r in got], want)


LOW = -(1 << 63) + (1 << 64) // fingerprints.FRACTION


def plain_sketch(text):
    """Hashes of the shingles below the threshold, or the least one; a shingle's words are hashed one by one."""
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    hashes = set()
    for i in range(max(1, len(found) - 4) if found else 0):
        h = 42
        for word in found[i : i + 5]:
            h = xxhash.xxh64_intdigest(word.encode(), seed=h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    return {h for h in hashes if h < LOW} or set(sorted(hashes)[:1])


def test_stand_ins_take_no_part_in_containment_and_unions(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    long = " ".join(rng.choice("abcdefgh") for _ in range(3000))
    table = spark.createDataFrame([(t, f"{long} {t}") for t in texts], "x string, y string")
    x, y = (fingerprints.sketch(F.col(c)) for c in "xy")
    both = fingerprints.merged(x, y)
    got = table.select("x", "y", fingerprints.containment(x, y).alias("c"), both.alias("m"), fingerprints.merged(x, x).alias("s")).collect()
    standing = 0
    for r in got:
        mine, other = plain_sketch(r.x), plain_sketch(r.y)
        if min(mine) >= LOW:
            standing += 1
            assert r.c is None and set(r.m) == other and set(r.s) == mine
        else:
            assert r.c == len(mine & other) / len(mine) and set(r.m) == mine | other
    assert 0 < standing < len(got)
    assert all(r.c == 1 for r in got if r.c is not None and len(r.x.split()) >= 5)


def test_sketches_estimate_similarity(spark):
    a = [f"w{i}" for i in range(4000)]
    table = spark.createDataFrame([(" ".join(a), " ".join(a[2000:]), " ".join(a))], "x string, y string, z string")
    x, y, z = (fingerprints.sketch(F.col(c)) for c in "xyz")
    row = table.select(fingerprints.likeness(x, y), fingerprints.containment(y, x), fingerprints.likeness(x, z)).first()
    assert abs(row[0] - 0.5) < 0.08 and row[1] == 1 and row[2] == 1


def test_quality_learns(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well", "a", "of"] if i % 2 else ["###", "buy!!", "a", "of"]) for _ in range(60))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "good"), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (None, 1)], "doc_id bigint, quality int")
    machine = quality.train(table, labels)
    got = quality.score_documents(table, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(table, machine).count()
    assert kept == sum(r.predicted for r in got)
    assert quality.train(table, labels.limit(0)).score(np.arange(16), np.zeros(16)) == 0.5


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    size = len(quality.STATISTICS) + quality.BUCKETS
    m = quality.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(16), np.ones(16))
    p, x = np.arange(20), rng.normal(size=20)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(20) for j in range(i))
    z = 0.1 + m.weights[:20] @ x + pairs
    assert np.isclose(m.score(p, x), 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(s, k, t, rng.randint(50, 5000)) for s in "abcdef" for k in "xyz" for t in "pq"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    raked = source_mix.rake(cells).toPandas()
    for name in ("source", "lang", "topic"):
        sums = raked.groupby(name).agg(w=("weight", "sum"), t=(f"target_{name}", "first"))
        assert np.allclose(sums.w, sums.t, rtol=1e-5)


def test_mix_goes_on_until_all_margins_agree(spark):
    schema, flatten = "source string, lang string, topic string, tokens bigint", {"source": 0, "lang": 1, "topic": 1}
    slow = [("a", "x", "p", 60000), ("a", "y", "p", 1), ("b", "x", "p", 1), ("b", "y", "p", 40000)]
    raked = source_mix.rake(spark.createDataFrame(slow, schema), flatten).toPandas()
    for name, want in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"x": 60001 / 100002, "y": 40001 / 100002})):
        assert raked.groupby(name).weight.sum().to_dict() == pytest.approx(want, rel=2e-6)
    with pytest.warns(UserWarning, match="still differ"):
        source_mix.rake(spark.createDataFrame([slow[0], slow[3]], schema), flatten)


def test_mix_keeps_whole_rows(docs, rows):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    kept = source_mix.sample(docs).collect()
    assert len(kept) == sum(r.kept for r in got)
    assert {(r.doc_id, r.text) for r in kept} <= {r[:2] for r in rows}


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    machine = quality.train(nothing, labels)
    results = [
        count_tokens(nothing, WORD_FILE),
        read_ids(write_ids(nothing, WORD_FILE, 1)),
        ngram_join.near_copies(nothing),
        encode_digests(nothing, PIECE_FILE),
        personal_data.find_personal_data(nothing),
        mark_copies(nothing),
        remove_repeats(nothing),
        quality.score_documents(nothing, machine),
        fingerprints.fingerprint_edits(nothing),
        source_mix.mix(nothing),
        ngram_join.drop_near_copies(nothing),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_equal_polynomials_are_told_apart(spark):
    """Two words of 1,024 letters on which every polynomial hash modulo 2^64 agrees."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    assert words.words_of(one)[0] != words.words_of(two)[0]
    rows = [(i, " ".join([w] * 12 + [f"end{w}"])) for i, w in enumerate((one, two))]
    pair = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["component_id"] for r in ngram_join.near_copies(pair).collect()} == {0, 1}
    assert [r["n_removed"] for r in remove_repeats(pair).collect()] == [0, 0]


def test_word_hashes_depend_on_each_byte_and_on_the_length():
    rng = random.Random(11)
    made = {bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(20000)}
    made |= {b"\x00" * n for n in range(1, 60)}
    text = b" ".join(made).decode("latin1")
    column = words.text_groups(words.pa.array([text.encode("latin1")], words.pa.binary()))
    (_, _, found), = column
    assert len(found.h) == len(made) == len(set(found.h.tolist())) == len(set(found.g.tolist()))
    assert not set(found.h.tolist()) & set(found.g.tolist())


def test_workers_give_back_what_a_task_held():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", file.read())[1]) >> 10

    kept = []

    def run(batches):
        for size in batches:
            # small pieces, which an allocator keeps as the last one lies behind all others
            some = [bytes(1000) for _ in range(size)]
            kept.append(some[-1])
            yield len(some)

    assert list(words.giving_back(run)([100])) == [100]
    before = held()
    assert list(words.giving_back(run)([200_000, 200_000])) == [200_000] * 2
    assert held() < before + 60


def test_batches_are_cut_by_bytes_of_text():
    texts = ["a" * 10, None, "b" * 500, "", "c" * 40, "d" * 40, "e" * 40]
    batch = words.pa.record_batch({"text": words.pa.array(texts), "n": list(range(7))})
    cut = [p.column("n").to_pylist() for p in words.slices([batch, batch.slice(7)], most=100)]
    assert cut == [[0, 1], [2], [3, 4, 5], [6]]
