"""URL filter: rules first; where none fits, naive Bayes over the words of host and path.

Names like ``cheappillsonline`` are cut into words by a unigram model: of all ways to cut a run of
letters, Viterbi finds the likeliest under the counts of words in all pages, in paths, and in names that
punctuation already divides. What a page says of its own host is left out, or each name would be a word.
A multinomial naive Bayes scores the words. Its
classes come from a few ``SEEDS``: a url with one of these words is an example of an unwanted one, any
other of a wanted one. What else the unwanted ones have in common is learnt from all urls.

Word counts, the lexicon and the model are tables and grow with the input; a name meets only the words
that occur in it. Joins on words and hosts treat the keys with more than ``SHARE`` of the rows apart:
there are at most 1 / ``SHARE`` of them, so they are broadcast and no task gets one whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import ascii_lower
from tidepanel.session import materialize

# The rules of the query, (verdict, host, start of the path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Words that mark a url as an example of an unwanted one.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Letters of the longest word that the lexicon gives.
LONGEST = 24
#: Names of so few letters (www, com) are words as they are.
SHORT = 4
#: What a seed counts in the lexicon beside its occurrences.
SEED_COUNT = 100
#: Keys with a larger share of the rows are joined apart.
SHARE = 0.001
#: Weight of the words of all urls in the word shares of either class, in words.
SMOOTHING = 100.0
#: Distinct words that a task gathers before it hands them on.
WORDS_HELD = 200_000

_TAGS = re.compile(rb"<script.*?</script>|<style.*?</style>|<[^>]*>|&#?[0-9A-Za-z]+;", re.S | re.I)
_LETTERS = re.compile(rb"[A-Za-z]+")


# ---------------------------------------------------------------------------------------------
# Parts of a url, and rules
# ---------------------------------------------------------------------------------------------

_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def decided(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first in the alphabet."""
    rule = verdict = F.lit(None).cast("string")
    for way, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), *(-ord(c) for c in r[1] + r[2]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, way).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------------------------------------
# Words
# ---------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-case words of pages without their tags and without their own hosts' names, counted in the task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counts: Counter[bytes] = Counter()

    def packed() -> pa.RecordBatch:
        words = pa.array([w.decode() for w in counts], pa.string())
        return pa.record_batch([words, pa.array(list(counts.values()), pa.int64())], schema=schema)

    for batch in batches:
        for page, host in zip(batch.column("html"), batch.column("host")):
            if page.is_valid:
                text = _TAGS.sub(b" ", page.as_py().encode()).lower()
                own = set(_LETTERS.findall(host.as_py().encode()))
                counts.update(w for w in _LETTERS.findall(text) if len(w) <= LONGEST and w not in own)
                if len(counts) >= WORDS_HELD:
                    yield packed()
                    counts.clear()
    yield packed()


def unigrams(pages: DataFrame, *others: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``pages`` (html, host) and counts from elsewhere (word, n)."""
    found = pages.mapInArrow(_count_words, "word string, n bigint")
    for counts in others:
        found = found.unionByName(counts.filter(F.length("word") <= LONGEST))
    return found.groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters.

    A word that is not in ``counts`` has a probability that falls tenfold with each letter. Of equally
    likely cuts the one whose last word is longest is taken, and so on to the front.
    """
    unseen = math.log(max(total, 1))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        choice = None
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            cost = unseen - math.log(n) if n else unseen + math.log(10) * (end - start)
            cost += best[start][0]
            if choice is None or cost < choice[0] - 1e-9:
                choice = (cost, start)
        best.append(choice)
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def _segment(total: int):
    schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                counts = {known["word"]: known["n"] for known in row["known"]}
                out.append({"name": row["name"], "words": segment(row["name"], counts, total)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def segmented(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(name, words) of distinct runs of letters, each beside the lexicon's words that occur in it."""
    total = lexicon.agg(F.sum("n")).first()[0] or 0
    inside = names.select(
        "name",
        F.explode(
            F.expr(
                f"array_distinct(flatten(transform(sequence(1, length(name)), i -> transform("
                f"sequence(1, least({LONGEST}, length(name) - i + 1)), k -> substr(name, i, k)))))"
            )
        ).alias("word"),
    )
    known = (
        inside.join(lexicon, "word")
        .groupBy("name")
        .agg(F.collect_list(F.struct("word", "n")).alias("known"))
    )
    whole = names.select("name").join(known, "name", "left").withColumn("known", F.coalesce("known", F.array()))
    return whole.mapInArrow(_segment(total), "name string, words array<string>")


def letters_of(text: Column) -> Column:
    """Runs of letters and of digits; of the digits only that they are there (``#``)."""
    runs = F.regexp_extract_all(ascii_lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(runs, lambda run: F.when(run < "a", "#").otherwise(run))


# ---------------------------------------------------------------------------------------------
# Joins and the model
# ---------------------------------------------------------------------------------------------


def join_shares(rows: DataFrame, values: DataFrame, key: str, times: DataFrame) -> DataFrame:
    """``rows`` left joined with one row of ``values`` per key; ``times`` (key, n) counts the rows of a key.

    Keys with more than ``SHARE`` of all rows are fewer than 1 / ``SHARE`` and go to every task; the
    others are small, so that a shuffle spreads them.
    """
    total = times.agg(F.sum("n")).first()[0] or 0
    # named by the rows' own keys, so that a null key finds nothing
    heavy = times.filter(F.col("n") > F.lit(total * SHARE)).select(key)
    far = values.join(F.broadcast(heavy), key, "left_anti")
    near = values.join(F.broadcast(heavy), key, "left_semi")
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
    spread = marked.filter("__heavy is null").drop("__heavy").join(far, key, "left")
    at_hand = marked.filter("__heavy").drop("__heavy").join(F.broadcast(near), key, "left")
    return spread.unionByName(at_hand)


def model(tokens: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(token, n, weight): the log of how much likelier a token is in an unwanted url.

    ``tokens``: token, unwanted (boolean). Either class starts from the shares of all tokens, worth
    ``smoothing`` tokens, so a token that says nothing about the classes weighs next to nothing.
    """
    counts = materialize(
        tokens.groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("unwanted").cast("bigint").alias("bad")
        )
    )
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    usual = F.col("n") / F.lit(float(max(n, 1)))
    in_bad = (F.col("bad") + smoothing * usual) / F.lit(bad + smoothing)
    in_good = (F.col("n") - F.col("bad") + smoothing * usual) / F.lit(n - bad + smoothing)
    return counts.select("token", "n", F.log(in_bad / in_good).alias("weight"))


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    seeds: tuple[str, ...] = SEEDS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score, words.

    ``rules`` are a parameter, a list short enough to stand in a plan. The longest that fits decides;
    else the score does, the log of how much likelier the url is unwanted (block above 0). ``words`` are
    the words of the host. A null url, and one without ``://``, has an empty host and path, no words,
    and the prior as its score. Repeated rows are judged alike; page_id may be null or repeat. A table
    without unwanted urls allows all that no rule blocks; an empty table gives an empty result. Very
    long urls are whole rows like any other. Columns other than page_id, url and html are not read; a
    null html adds no words.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    # written, so that the row numbers stay as they are
    rows = materialize(
        parts.select("*", rule.alias("rule"), verdict.alias("ruled"), F.monotonically_increasing_id().alias("row"))
    )
    hosts = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    labels = F.transform(F.split("host", "[.]"), letters_of)
    parts_of = F.flatten(
        F.transform(labels, lambda runs: F.transform(runs, lambda run: F.struct(run.alias("name"), (F.size(runs) > 1).alias("divided"))))
    )
    runs = hosts.select("host", F.posexplode(parts_of).alias("at", "run")).select("host", "at", "run.*")
    divided = runs.filter("divided and name != '#'").groupBy(F.col("name").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    in_paths = rows.select(F.explode(letters_of(F.col("path"))).alias("word")).filter("word != '#'")
    in_paths = in_paths.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    given = pages.sparkSession.createDataFrame([(seed, SEED_COUNT) for seed in seeds], "word string, n bigint")
    lexicon = materialize(unigrams(pages.select("html", host.alias("host")), divided, in_paths, given))
    names = runs.select("name").filter(F.length("name") > SHORT).distinct()
    cut = materialize(segmented(materialize(names), lexicon))
    named = join_shares(runs, cut, "name", runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    words_of = named.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("words", F.array("name")).alias("words")))).alias("runs")
    )
    words_of = materialize(words_of.select("host", F.flatten(F.col("runs")["words"]).alias("words")))

    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), letters_of(F.col("path")))
    marked = join_shares(rows, words_of, "host", hosts).withColumn("tokens", tokens)
    marked = materialize(
        marked.withColumn("unwanted", F.arrays_overlap("tokens", F.array(*map(F.lit, seeds))))
    )
    weights = model(marked.select(F.explode("tokens").alias("token"), "unwanted"), smoothing)
    weights = materialize(weights)
    n, bad = marked.agg(F.count(F.lit(1)), F.coalesce(F.count_if("unwanted"), F.lit(0))).first()
    prior = math.log((bad + 1) / (n - bad + 1))
    single = marked.select("row", F.explode("tokens").alias("token"))
    weighed = join_shares(single, weights.select("token", "weight"), "token", weights.select("token", "n"))
    scores = weighed.groupBy("row").agg(F.sum("weight").alias("weight"))
    score = F.coalesce("weight", F.lit(0.0)) + prior
    return marked.join(scores, "row", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"),
    )
