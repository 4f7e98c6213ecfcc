"""The pipeline stage by stage against plain Python; each stage is judged on what its predecessor kept."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import public_tokenizers

import corpus_pipeline
from tidepanel.llm import quality, source_mix
from tidepanel.llm.words import words_of
from tidepanel.session import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h string, p bigint"
LABELS = "doc_id bigint, quality int, toxic int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = random.Random(12)
    good = ["river", "stone", "garden", "letter", "window", "market", "paper", "music", "winter", "road"]
    bad = ["zzx", "qqv", "!!!", "###", "xxw", "$$$"]
    rows, labels = [], []
    sources, langs = ["a", "b", "c"], ["en", "de"]

    def add(text, label=None):
        i = len(rows)
        rows.append((i, text, langs[i % 2], sources[i % 3 if i % 5 else 0], len(text or ""), "r", "h", i))
        if label is not None:
            labels.append((i, label, 0))

    for i in range(90):
        text = " ".join(rng.choice(good) for _ in range(rng.randint(20, 60)))
        add(text + ("\n" * 8 if i % 4 == 0 else ""), 1 if i % 2 else None)
    for i in range(60):
        add(" ".join(rng.choice(bad) for _ in range(rng.randint(20, 60))), 0 if i % 2 else None)
    base = [rng.choice(good) for _ in range(80)]
    for _ in range(12):  # near copies
        edited = list(base)
        edited[rng.randrange(80)] = rng.choice(good)
        add(" ".join(edited))
    add(" ".join(base).upper())
    add(" ".join(base))
    for text in (None, "", " ", "one", "é你 x", "river " * 3000):
        add(text)
    rows.append(rows[3])
    rows.append((None, "null id river stone garden letter", None, None, 1, None, None, None))
    rows.append((None, None, None, "a", 0, None, None, None))
    return rows, labels


def ids(rows):
    return sorted((r[0] if r[0] is not None else -1) for r in rows)


def explicit_score(machine, text):
    """Linear part and all pairs one by one, as the definition has it."""
    ((places, values),) = quality.features(pa.array([text], pa.string()))
    x = machine.scaled(values)
    z = machine.bias + sum(machine.weights[p] * v for p, v in zip(places, x))
    for i, j in itertools.combinations(range(len(places)), 2):
        z += float(machine.factors[places[i]] @ machine.factors[places[j]]) * x[i] * x[j]
    return 1 / (1 + np.exp(-z))


def shingles(text):
    words = WORDS.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else ("empty", i), []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]


def topic(text):
    size = max(len(text), 1)
    share = lambda signs: sum(text.count(s) for s in signs) / size
    if share("|") > 0.02:
        return "table"
    if share("\n") > 0.03:
        return "listing"
    if share("%$#") > 0.02:
        return "figures"
    return "long prose" if len(text) > 4000 else "short prose"


def mixed(rows):
    """(row, its uniform number, the probability of its cell), raked by plain loops."""
    key = lambda r: (r[3] or source_mix.UNKNOWN, r[2] or source_mix.UNKNOWN, topic(r[1] or ""))
    tokens = {}
    for r in rows:
        tokens[key(r)] = tokens.get(key(r), 0) + len(WORDS.findall(r[1] or ""))
    cells = [c for c in tokens if tokens[c]]
    weight = {c: float(tokens[c]) for c in cells}
    targets = []
    for axis, power in enumerate(source_mix.FLATTEN.values()):
        margin = {}
        for c in cells:
            margin[c[axis]] = margin.get(c[axis], 0) + tokens[c]
        whole = sum(m**power for m in margin.values())
        targets.append({k: m**power / whole for k, m in margin.items()})
    for _ in range(400):
        for axis, target in enumerate(targets):
            sums = {}
            for c in cells:
                sums[c[axis]] = sums.get(c[axis], 0) + weight[c]
            for c in cells:
                weight[c] *= target[c[axis]] / sums[c[axis]]
    top = max(weight[c] / tokens[c] for c in cells)
    chance = {c: weight[c] / tokens[c] / top if tokens[c] else 1.0 for c in tokens}
    number = lambda r: int(hashlib.md5(f"{'null' if r[0] is None else r[0]}:mix".encode()).hexdigest()[:13], 16) / 2**52
    return [(r, number(r), chance[key(r)]) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact copies", "near copies", "mix", "encode"]
    rows = [tuple(r) for r in docs.collect()]

    machine = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = materialize(stages["quality"](spark, docs, folder))
    assert kept.columns == docs.columns
    want = [r for r in rows if explicit_score(machine, r[1]) >= quality.CUT]
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    labelled_bad = {i for i in range(90, 150)}
    assert not labelled_bad & set(ids(rows)) and set(range(90)) <= set(ids(rows))

    kept = materialize(stages["exact copies"](spark, kept, folder))
    texts = {}
    for r in rows:
        best = texts.setdefault(lower(r[1]), r)
        if (r[0] is not None, r[0] or 0) > (best[0] is not None, best[0] or 0):
            texts[lower(r[1])] = r
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert ids(rows) == ids(texts.values()) and {lower(r[1]) for r in rows} == set(texts)

    kept = materialize(stages["near copies"](spark, kept, folder))
    want = one_of_each_group(rows)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and ids(rows) == ids(want)

    kept = materialize(stages["mix"](spark, kept, folder))
    drawn = mixed(rows)
    rows = [tuple(r) for r in kept.collect()]
    got = set(ids(rows))
    sure = [(r, u < p) for r, u, p in drawn if abs(u - p) > 0.01]
    assert len(sure) > 0.9 * len(drawn) and 0 < len(rows) < len(drawn)
    assert all(((r[0] if r[0] is not None else -1) in got) == keep for r, keep in sure)
    assert kept.columns == docs.columns

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in rows:
        found = library.encode(r[1] or "")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, found)), library.decode(found))]
        want.append((r[0], len(found), *digests))
    out = [tuple(r) for r in stages["encode"](spark, kept, folder).collect()]
    assert sorted(out, key=repr) == sorted(want, key=repr)

    whole = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(whole, key=repr) == sorted(out, key=repr)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_scores_equal_the_sum_over_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and len(r["text"] or "") < 2000}
    for r in quality.score_documents(docs, machine).collect():
        if r["doc_id"] in texts:
            assert r["score"] == pytest.approx(explicit_score(machine, texts[r["doc_id"]]), abs=1e-9)
            assert r["predicted"] == int(r["score"] >= quality.CUT)
    assert len(words_of("a b")) == 2
