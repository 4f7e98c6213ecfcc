"""Fill-in-middle, conversation repair and URL filter against brute force, with the awkward cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidepanel.llm import fill_middle, turn_repair, url_filter
from tidepanel.llm.fill_middle import RankIndex, fill_digests, fill_in_middle
from tidepanel.llm.turn_repair import damaged, repair, search, tokens_of
from tidepanel.llm.url_filter import RULES, SEEDS, judge, segment


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- fill-in-middle ---------------------------------------------------------------------------


def test_rank_index_gives_every_boundary():
    rng = random.Random(1)
    texts = ["", "a", "é", "a" * 3000 + "😀" * 3000 + "é" * 2000 + "b", "".join(rng.choice("aé你😀") for _ in range(5000))]
    for text in texts:
        offsets = np.cumsum([0] + [len(c.encode()) for c in text])
        for error, block in ((1, 1 << 20), (60, 1 << 20), (7, 64), (60, 3)):
            index = RankIndex(text.encode(), error, block)
            assert index.n == len(text)
            assert [index.offset(r) for r in range(len(text) + 1)] == offsets.tolist()
            assert np.abs(index.residuals).max() <= error + 1
    assert len(RankIndex(("ab" * 5000).encode()).starts) == 1
    with pytest.raises(IndexError):
        RankIndex(b"ab").offset(3)


def filled_in_plain_python(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


DOCS = "doc_id bigint, text string, n bigint, form string, output string"


def test_fill_in_middle_equals_its_definition(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "a", "é", "x<P>y", "<M>", "<", "<<S", "a\x00b\n", "\u0301é\u0301", "long 你好 😀 " * 30000]
    texts += ["".join(rng.choice("<PSM>aé😀 ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t, 1, "f", "o") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "null id", 1, None, None), (7, "another text", 1, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = [filled_in_plain_python(*r[:2]) for r in rows]
    got = rows_of(fill_in_middle(docs).drop("segments"))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = [(*w[:5], digest(w[5]), digest(r[1])) for w, r in zip(want, rows)]
    assert rows_of(fill_digests(docs).drop("segments")) == sorted(digests, key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(fill_in_middle(empty)) == [] and rows_of(fill_digests(empty)) == []


# --- conversation repair ----------------------------------------------------------------------

GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest_by_enumeration(rows):
    """Every choice of edits with up to two turns put in at each place."""
    inserts = [("", 0, ""), ("I", 3, "u"), ("I", 3, "a"), ("II", 6, "ua"), ("II", 6, "au")]
    edits = []
    for fault, initial in rows:
        ways = [("D", 4, "")]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            ways += [("K", extra, initial), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
        edits.append(ways)
    best = (10**9, "")
    for chosen in itertools.product(*edits):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            steps = [put[0], *(x for pair in zip(chosen, put[1:]) for x in pair)]
            cost = sum(s[1] for s in steps)
            if cost <= best[0] and GOOD.match("".join(s[2] for s in steps)):
                best = min(best, (cost, "".join(s[0] for s in steps)))
    return best


def test_search_and_joined_segments_find_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(80):
        n = rng.randint(0, 4)
        rows = [(rng.choice(["", "", "", "truncated", "blank", "duplicate"]), rng.choice("suax")) for _ in range(n)]
        want = cheapest_by_enumeration(rows)
        assert search(list(tokens_of([(*r, 1) for r in rows]))) == want
        chain, at = turn_repair.Chain(), 0
        while at < n:
            step = rng.randint(1, n - at)
            part = list(tokens_of([(*r, 1) for r in rows[at : at + step]]))
            found = {(e, x): search(part, e, (x,)) for e in range(4) for x in range(4)}
            chain.take([dict(entry=e, exit=x, cost=f[0], audit=f[1]) for (e, x), f in found.items() if f])
            at += step
        assert chain.end() == want


def test_search_of_a_long_conversation_stays_linear():
    rng = random.Random(4)
    rows = [(rng.choice(["", "", "truncated", "blank"]), rng.choice("sua"), 1) for _ in range(20000)]
    cost, audit = search(list(tokens_of(rows)))
    assert len(audit.replace("I", "")) == len(rows) and cost > 0


SPACE = " \t\n\x0b\x0c\r"


def repaired_in_plain_python(rows):
    """Faults by the definition, the cheapest edits by a table of all (position, state) from the front."""
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        turns = by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        turns += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in by_conv.items():
        key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        turns.sort(key=key)
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [r[0] for r in turns if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        ways = {"": (0, "", ())}

        def put_in(ways):
            for _ in range(2):
                for state, (cost, audit, texts) in list(ways.items()):
                    role = "assistant" if state == "u" else "user"
                    new = (cost + 3, audit + "I", (*texts, f"{role}:"))
                    ways[role[0]] = min(ways.get(role[0], new), new)
            return ways

        put_in(ways)
        for fault, (_, role, text) in zip(faults, turns):
            new = {}

            def offer(state, way):
                new[state] = min(new.get(state, way), way)

            for state, (cost, audit, texts) in ways.items():
                offer(state, (cost + 4, audit + "D", texts))
                if fault not in ("blank", "duplicate"):
                    extra, then = 3 * (fault == "truncated"), "assistant" if state == "u" else "user"
                    offer(then[0], (cost + 3 + extra, audit + "R", (*texts, f"{then}:{text}")))
                    if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                        offer(role[:1], (cost + extra, audit + "K", (*texts, f"{role}:{text}")))
            ways = put_in(new)
        cost, audit, texts = min(ways[s] for s in ("", "a") if s in ways)
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string, times bigint, h string, segment bigint"


def conversations():
    rng = random.Random(8)
    words = ["Yes.", "No?", "cut off", "", " \t", "Same again.", "end!\n"]

    def row(conv, turn):
        role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
        text = rng.choice([None, *words, f"{turn} {rng.random()}.", f"{rng.random()} é"])
        return conv, turn, role, text, 1, "h", 2

    rows = [row(c, t) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [row(500, t if t % 7 else None) for t in range(700)]  # the long one
    rows += [row(None, rng.choice([None, t])) for t in range(40)]
    rows += [(700, 3, "user", "Twice.", 1, None, None)] * 30 + [(701, None, None, None, 1, None, None)]
    return rows


@pytest.mark.parametrize("segment_rows", [1 << 15, 50, 7])
def test_repair_equals_plain_python_however_it_is_cut(spark, segment_rows):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    got = rows_of(repair(damaged(turns), segment_rows))
    assert got == repaired_in_plain_python(rows)
    assert any(r[0] is None for r in got)


def test_repair_of_nothing(spark):
    assert rows_of(repair(damaged(spark.createDataFrame([], TURNS)))) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(9, gone, "user", "Hello.", 1, None, None)], TURNS)
    assert rows_of(repair(damaged(only))) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- URL filter -------------------------------------------------------------------------------


def test_viterbi_takes_the_likeliest_words():
    counts = {"cheap": 50, "pills": 40, "online": 60, "on": 500, "line": 90, "a": 900, "he": 80}
    total = sum(counts.values())
    assert segment("cheappillsonline", counts, total) == ["cheap", "pills", "online"]
    assert segment("qqqq", counts, total) == ["qqqq"]
    assert segment("", counts, total) == []

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(total) + len(w) * math.log(10) for w in words)

    for name in ("online", "heapona", "aline", "zzonlinez", "hehea"):
        ways = [
            [name[a:b] for a, b in zip((0, *cut), (*cut, len(name)))]
            for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)
        ]
        assert cost(segment(name, counts, total)) == pytest.approx(min(map(cost, ways)))


def judged_in_plain_python(pages):
    def parts(url):
        found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path

    def runs(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return ["#" if r[0].isdigit() else r for r in re.findall("[a-z]+|[0-9]+", text)]

    lexicon = dict.fromkeys(SEEDS, url_filter.SEED_COUNT)

    def count(word):
        if len(word) <= url_filter.LONGEST and word != "#":
            lexicon[word] = lexicon.get(word, 0) + 1

    for host in {parts(p[1])[0] for p in pages}:
        for label in host.split("."):
            if len(runs(label)) > 1:
                for r in runs(label):
                    count(r)
    for _, url, html, *_ in pages:
        host, path = parts(url)
        for r in runs(path):
            count(r)
        text = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&#?[0-9A-Za-z]+;", " ", html or "")
        for word in re.findall("[a-z]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            if word not in re.findall("[a-z]+", host):
                count(word)
    total = sum(lexicon.values())
    rows, good, bad = [], {}, {}
    for page, url, *_ in pages:
        host, path = parts(url)
        words = [w for r in runs(host) for w in (segment(r, lexicon, total) if len(r) > url_filter.SHORT else [r])]
        tokens = words + runs(path)
        unwanted = any(t in SEEDS for t in tokens)
        for t in tokens:
            side = bad if unwanted else good
            side[t] = side.get(t, 0) + 1
        rows.append((page, host, path, words, tokens, unwanted))
    n_good, n_bad, s = sum(good.values()), sum(bad.values()), url_filter.SMOOTHING
    n_unwanted = sum(r[5] for r in rows)
    out = []
    for page, host, path, words, tokens, _ in rows:
        score = math.log((n_unwanted + 1) / (len(rows) - n_unwanted + 1))
        for t in tokens:
            usual = (good.get(t, 0) + bad.get(t, 0)) / (n_good + n_bad)
            score += math.log((bad.get(t, 0) + s * usual) / (n_bad + s) / ((good.get(t, 0) + s * usual) / (n_good + s)))
        fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, "block" if score > 0 else "allow")
        out.append((page, host, path, rule, verdict, round(score, 9), words))
    return sorted(out, key=repr)


PAGES = "page_id bigint, url string, html string, host string, n bigint, word string, row bigint"


def pages():
    rng = random.Random(6)
    plain = ["river", "stone", "garden", "letter", "window", "market"]
    rows = []
    for i in range(150):
        a, b = rng.sample(plain, 2)
        name = rng.choice([a + b, f"{a}-{b}", a + b, a])
        rows.append((i, f"http://{rng.choice(['www.', '', 'm.'])}{name}.example.com/{b}/{i}", f"<p>{a} {b} {name} the</p>"))
    for i, name in enumerate(["cheap-pills", "cheappills", "casino-win", "casinowin", "win-cheap", "wincheap"] * 4):
        rows.append((200 + i, f"https://{name}.example.com/win/{i}", "<b>cheap</b> to win"))
    rows += [
        (300, None, None), (301, "", ""), (302, "no scheme", "x"), (303, "http://", "<p"), (304, "x://A.NET", "&amp;"),
        (305, "x://net/", ""), (306, "x://a.net/b?c://d/", ""), (307, "x://b.example.net/en/1#2", ""), (308, "x://example.net/en", ""),
        (309, "x://example.com/de/", ""), (310, "x://notexample.com/de/", ""), (311, "x://a.org/fr/x", ""), (312, "x://borg/fr/", ""),
        (313, "ftp://Üser@host:80/é/\n?q", "é"), (314, "a://b://c/d", ""), (None, "http://stone.org/1", ""), (1, "http://stone.org/1", ""),
        (315, "http://" + "rivergarden" * 200 + ".com/" + "stone/" * 500, "river " * 1000),
    ]
    rows += [rows[-1]] * 3
    return [(*r, "h", 1, "w", 5) for r in rows]


def test_judge_equals_plain_python(spark, monkeypatch):
    rows = pages()
    for share in (url_filter.SHARE, 0.02, 1.0):
        monkeypatch.setattr(url_filter, "SHARE", share)
        got = judge(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
        got = sorted([(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), r[6]) for r in got], key=repr)
        assert got == judged_in_plain_python(rows)
    verdicts = {r[1]: r[4] for r in got}
    assert [verdicts[f"{x}.example.com"] for x in ("cheappills", "casinowin", "wincheap")] == ["block"] * 3
    assert sum(v == "block" for h, v in verdicts.items() if h.endswith(".example.com") and "cheap" not in h and "casino" not in h) == 0


def test_judge_of_nothing(spark):
    assert judge(spark.createDataFrame([], PAGES)).collect() == []
