"""Exact Jaccard self-join of documents on word shingles, up to connected components.

1. Each document becomes a set of shingle hashes; equal sets are one class from here on.
2. Sets exchange the shingles of their prefix: of two sets similar enough, the first quarter in any
   common order of shingles shares one. The order is by hash, with the shingles found frequent in some
   batch last, so that common passages do not bring documents together. Frequency only orders.
3. Groups of the same sets say the same about them, so only the one of the first shingle goes on. In a group,
   bitmaps and signature trees tell which sets could link. What is kept of them is a forest: a pair
   of sets that others connect already is not looked at, so rows do not grow with the square of a group.
   Groups larger than a block are gone through block after block, then for each two blocks whose sets are
   not all connected yet.
4. Each tree of the forest is a cluster of sets that could link. Its sets come together with all their
   shingles, once, and are compared exactly, by prefixes in the cluster's own order of rarity; again a
   forest of the links is kept. A cluster of very many shingles is dealt out as pairs of blocks.

Shingles have two independent 64-bit hashes. Candidates are found by the first, which can only bring
too many together; pairs are verified by 64 bits made of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.components import components
from tidepanel.llm.signature_trees import FANOUT, Tree, bitmap, candidate_pairs, could_link, required
from tidepanel.llm.tables import text_of
from tidepanel.llm.words import Words, giving_back, mix, rolling, slices, text_groups
from tidepanel.session import materialize

SHINGLE = 5
PERCENT = 75
#: The most shingles that are ordered last as frequent. They only order, so a bound loses nothing.
MOST_FREQUENT = 1 << 16
#: Members of a group that are compared at once, and those of a block where each two blocks are compared.
BLOCK = 256
PAIR_BLOCK = 1024
#: Members of earlier blocks that the next block is compared with, of different parts.
CARRIED = 32
#: Shingles of a block of a cluster.
ELEMENTS = 1 << 20
#: Sets that a task remembers as connected; beyond it, it begins anew, which only repeats some rows.
REMEMBERED = 1 << 19
#: Ids up to this number may be broadcast (about 20 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1 << 19
NO_ID = -(1 << 63)


def _hashes(words: Words, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second hash of the distinct shingles of text i, ascending by the first.

    A text shorter than k words has its whole sequence as one.
    """
    some = slice(words.first[i], words.first[i + 1])
    h, g = words.h[some], words.g[some]
    if len(h) == 0:
        return h, g
    if len(h) < k:
        return rolling(h, len(h), 100 + len(h)), rolling(g, len(g), 100 + len(g))
    distinct, first = np.unique(rolling(h, k, 3), return_index=True)
    return distinct, rolling(g, k, 4)[first]


def set_name(hashes: np.ndarray, second: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.add.reduce(mix(hashes ^ mix(second, 12), 11), dtype=np.uint64).astype(np.int64)) if len(hashes) else 0


def _sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j, words in text_groups(column, lower=True):
        for t in range(j - i):
            yield _hashes(words, t, k)


def _describe(k: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("bits", pa.binary())]
        + [("often", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    )

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, names, bits, seen = [], [], [], {}
            for s, second in _sets(batch.column("text"), k):
                name = set_name(s, second)
                n.append(len(s))
                names.append(name)
                bits.append(bitmap(s).tobytes() if len(s) else None)
                seen.setdefault(name, s)
            hashes, times = np.unique(np.concatenate([*seen.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = times >= max(8, len(n) // 500)
            lists = [[hashes[often].view(np.int64)] + [None] * (len(n) - 1), [times[often]] + [None] * (len(n) - 1)]
            made = (pa.array(x, f.type) for x, f in zip((n, names, bits, *lists), list(schema)[2:]))
            columns = [batch.column("doc_id"), batch.column("th"), *made]
            if len(n):
                yield pa.record_batch(columns, schema=schema)

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(k: int, percent: int, frequent: np.ndarray):
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("often", pa.bool_())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen, parts = set(), []
            for s, second in _sets(batch.column("text"), k):
                name = set_name(s, second)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                p = prefix_length(len(s), percent)
                late = np.isin(s, frequent, kind="sort") if len(frequent) else np.zeros(len(s), bool)
                order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[:p]
                parts.append((s[order], name, len(s), late[order]))
            if not parts:
                continue
            lengths = [len(x[0]) for x in parts]
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)),
                    pa.array(np.repeat(np.array([x[1] for x in parts], np.int64), lengths)),
                    pa.array(np.repeat(np.array([x[2] for x in parts], np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])),
                    pa.array(np.concatenate([x[3] for x in parts])),
                ],
                schema=schema,
            )

    return run


def _members(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """Prefix shingles that sets share, one row per set: key, a, n, pos, often, and per group its number m of sets.

    s1 and s2 tell groups of the same sets. A frequent key is spread over 64 salts, and m, s1 and s2 are those
    of a salt.
    """
    rows = docs.select("text").mapInArrow(
        _prefixes(k, percent, frequent), "key bigint, a bigint, n int, pos int, often boolean"
    )
    rows = rows.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("a"), F.lit(64))).otherwise(0))
    group = Window.partitionBy("key", "salt").orderBy("n", "a")
    rows = rows.withColumn("before", F.lag("a").over(group)).withColumn("behind", F.lead("a").over(group))
    rows = rows.filter("often or before is not null or behind is not null").filter("before is null or before != a")
    whole = Window.partitionBy("key", "salt")
    rows = rows.withColumn("m", F.count(F.lit(1)).over(whole)).filter("often or m > 1")
    for name, seed in (("s1", 1), ("s2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64("a", F.lit(seed))).over(whole))
    return rows.select("key", "salt", "a", "n", "pos", "often", "m", "s1", "s2")


def _different(members: DataFrame) -> DataFrame:
    """Of groups of the same sets the one with the first key in the order of prefixes.

    Two sets meet first at their first common key, and that is the first key of its group's sets: an
    earlier one with the same sets would be common as well.
    """
    place = F.col("key").bitwiseXOR(F.lit(NO_ID))  # unsigned order
    first = members.filter("not often").groupBy("s1", "s2", "m").agg(F.min(place).alias("place"))
    kept = members.filter("not often").join(first.select(F.col("place").bitwiseXOR(F.lit(NO_ID)).alias("key")), "key", "left_semi")
    return kept.unionByName(members.filter("often")).drop("s1", "s2")


def _full_sets(k: int):
    schema = pa.schema([("a", pa.int64()), ("root", pa.int64()), ("blocks", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            wanted = part.column("a").to_pylist()
            found = [
                (i, mix(s[0] ^ mix(s[1], 12), 13).view(np.int64))
                for i, s in enumerate(_sets(part.column("text"), k))
                if set_name(*s) == wanted[i]
            ]
            if found:
                some = part.select(["a", "root", "blocks"]).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.record_batch([*some.columns, pa.array([h for _, h in found], schema.field("hashes").type)], schema=schema)

    return run


class Forest:
    """Which nodes are connected, and a pair of nodes for each time that two parts became one."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def unite(self, x: int, y: int) -> None:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.pairs.append((x, y) if x < y else (y, x))


def connect(own: list[tuple], other: list[tuple] | None, percent: int, forest: Forest) -> None:
    """Connects the nodes of members that could link, of one block of a group or of two.

    Members are (n, pos, node, bits). Members that fit one node of the lowest level are compared directly,
    others by their trees, after a first look at neighbours by size.
    """
    right = own if other is None else other
    labels = {forest.find(m[2]) for x in (own, right) for m in x}
    if len(labels) == 1:
        return

    def joined(p: int, q: int) -> bool:
        return forest.find(own[p][2]) == forest.find(right[q][2])

    def compare(x: tuple, y: tuple) -> None:
        if forest.find(x[2]) == forest.find(y[2]) or min(x[0] - x[1], y[0] - y[1]) < required(x[0], y[0], percent):
            return
        if could_link(x[0], x[3], y[0], y[3], percent):
            forest.unite(x[2], y[2])

    if len(own) <= FANOUT and len(right) <= FANOUT:
        for p, x in enumerate(own):
            for y in right[p + 1 :] if other is None else right:
                compare(x, y)
        return
    if other is None:
        for x, y in zip(own, own[1:]):
            compare(x, y)
    trees = [
        Tree(
            np.array([m[0] for m in x], np.int64),
            np.array([m[1] for m in x], np.int64),
            [m[3] for m in x],
            np.array([forest.find(m[2]) for m in x], np.int64),
        )
        for x in ([own] if other is None else [own, other])
    ]
    for p, q in candidate_pairs(trees[0], trees[1] if other is not None else None, percent, joined=joined):
        forest.unite(own[p][2], right[q][2])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _written(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], schema=_PAIRS)


def _in_groups(percent: int):
    """Groups arrive as runs of consecutive rows by size; a block of the open one is held."""
    names = ("key", "salt", "n", "pos", "a", "bits")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, held, carried = Forest(), None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:2] != key:
                    if len(held) > max(carried, 1):
                        connect(held, None, percent, forest)
                    key, held, carried = row[:2], [], 0
                held.append(row[2:])
                if len(held) == BLOCK:
                    connect(held, None, percent, forest)
                    # the last of each part, as far as there is room
                    parts = {forest.find(m[2]): m for m in held}
                    held = list(parts.values())[-CARRIED:]
                    carried = len(held)
            yield _written(forest.pairs)
            forest.pairs = []
            if len(forest.up) > REMEMBERED:
                forest = Forest()
        if len(held) > max(carried, 1):
            connect(held, None, percent, forest)
        yield _written(forest.pairs)

    return run


def _between_blocks(percent: int):
    """Pairs of blocks arrive as runs of consecutive rows; only the open one is held."""
    names = ("key", "low", "high", "block", "n", "pos", "part", "bits")

    def compare(rows: list[tuple], forest: Forest) -> None:
        low, high = rows[0][1:3]
        own = [r[4:] for r in rows if r[3] == low]
        connect(own, None if low == high else [r[4:] for r in rows if r[3] == high], percent, forest)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and row[:3] != held[0][:3]:
                    compare(held, forest)
                    held = []
                held.append(row)
            yield _written(forest.pairs)
            forest.pairs = []
            if len(forest.up) > REMEMBERED:
                forest = Forest()
        if held:
            compare(held, forest)
        yield _written(forest.pairs)

    return run


def _across_blocks(members: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of parts that members of different blocks of a large group could link."""
    named = (
        members.join(parts.select(F.col("node").alias("a"), "root"), "a", "left")
        .withColumn("part", F.coalesce("root", "a"))
        .select("key", "a", "n", "pos", "part")
    )
    groups = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    rows = named.join(groups.filter("low < high").select("key", "members"), "key").join(sets.select("a", "bits"), "a")
    rows = _paired(rows, F.ceil(F.col("members") / PAIR_BLOCK).cast("int"))
    rows = rows.select("key", "low", "high", "block", "n", "pos", "part", "bits").repartition("key", "low", "high")
    return rows.sortWithinPartitions("key", "low", "high").mapInArrow(_between_blocks(percent), "a bigint, b bigint")


def _paired(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows dealt out by a in blocks, each for every pair of its block (low, high) with another or itself."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return rows.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with")


def exact_links(names: list[int], sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between sets of distinct values, or only of those between two sides.

    Sets with a link share a value of their prefixes, here with the rarest values first.
    """
    forest = Forest()
    if len(names) <= FANOUT:
        for i, x in enumerate(sets):
            for j in range(i):
                if (side is not None and side[i] == side[j]) or forest.find(names[i]) == forest.find(names[j]):
                    continue
                both = len(np.intersect1d(x, sets[j], assume_unique=True))
                if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                    forest.unite(names[i], names[j])
        return forest.pairs
    n = np.array([len(x) for x in sets], np.int64)
    edges = np.concatenate([[0], np.cumsum(n)])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    value = rank[value]
    owner = np.repeat(np.arange(len(n)), n)
    value = value[np.lexsort((value, owner))]
    in_prefix = np.arange(len(value)) - edges[owner] < (n - -(-percent * n // 100) + 1)[owner]
    holder, held = owner[in_prefix], value[in_prefix]
    turn = np.argsort(held, kind="stable")
    holder, first = holder[turn], np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(times)))])
    label, groups, marked = np.arange(len(n)), [[i] for i in range(len(n))], np.zeros(len(times), bool)
    for i in np.argsort(n, kind="stable"):
        own = value[edges[i] : edges[i + 1]]
        mine = own[: n[i] - -(-percent * int(n[i]) // 100) + 1]
        near = np.unique(np.concatenate([holder[first[v] : first[v + 1]] for v in mine]))
        # each pair once, at the larger set
        near = near[(100 * n[near] >= percent * n[i]) & ((n[near] < n[i]) | ((n[near] == n[i]) & (near < i)))]
        if side is not None:
            near = near[side[near] != side[i]]
        marked[own] = True
        while len(near := near[label[near] != label[i]]):
            some, near = near[:BLOCK], near[BLOCK:]
            starts = np.concatenate([[0], np.cumsum(n[some])])
            at = np.arange(starts[-1]) + np.repeat(edges[some] - starts[:-1], n[some])
            both = np.add.reduceat(marked[value[at]].astype(np.int64), starts[:-1])
            for j in some[100 * both >= percent * (n[some] + n[i] - both)]:
                small, large = sorted((int(label[i]), int(label[j])), key=lambda x: len(groups[x]))
                if small != large:
                    forest.unite(names[i], names[j])
                    label[groups[small]] = large
                    groups[large] += groups[small]
                    groups[small] = []
        marked[own] = False
    return forest.pairs


def _exactly(percent: int):
    """Clusters, or pairs of blocks of them, arrive as runs of consecutive rows; only the open one is held."""

    def compare(key: tuple, held: dict) -> list[tuple[int, int]]:
        names = list(held)
        side = None if key[1] == key[2] else np.array([held[x][0] for x in names])
        return exact_links(names, [held[x][1] for x in names], side, percent)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            found = []
            lists = batch.column("hashes")
            edges, values = lists.offsets.to_pylist(), lists.values.to_numpy()
            for t, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "block", "a")))):
                if row[:3] != key:
                    if len(held) > 1:
                        found += compare(key, held)
                    key, held = row[:3], {}
                # the batch is not kept
                held[row[4]] = (row[3], values[edges[t] : edges[t + 1]].copy())
            yield _written(found)
        if len(held) > 1:
            yield _written(compare(key, held))

    return run


def _compared(docs: DataFrame, sets: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """A forest of the links between the sets of each cluster (node, root)."""
    named = sets.select("a", "n", "id", "th").join(clusters.select(F.col("node").alias("a"), "root"), "a")
    total = named.groupBy("root").agg(F.ceil(F.sum("n") / ELEMENTS).cast("bigint").alias("blocks"))
    named = materialize(named.join(total, "root").select("id", "th", "a", "root", "blocks"))
    some = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    rows = docs.withColumn("th", F.xxhash64("text")).join(some, ["id", "th"]).select("text", "a", "root", "blocks")
    rows = rows.mapInArrow(_full_sets(k), "a bigint, root bigint, blocks bigint, hashes array<bigint>")
    rows = _paired(rows, F.col("blocks")).drop("blocks").repartition("root", "low", "high")
    return materialize(rows.sortWithinPartitions("root", "low", "high").mapInArrow(_exactly(percent), "a bigint, b bigint"))


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n, a (name of the set), bits, and on some rows the frequent shingles of a batch."""
    return materialize(
        docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
            _describe(k),
            "doc_id bigint, th bigint, n bigint, a bigint, bits binary, often array<bigint>, times array<bigint>",
        )
    )


def _frequent(described: DataFrame) -> np.ndarray:
    rows = described.select(F.explode(F.arrays_zip("often", "times")).alias("z")).groupBy("z.often")
    top = rows.agg(F.sum("z.times").alias("total")).orderBy(F.desc("total"), "often").limit(MOST_FREQUENT)
    return np.sort(np.array([r["often"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def links(docs: DataFrame, described: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets that, with all others inside the parts they form, are all links."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    owner = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")
    sets = described.filter("n > 0").groupBy("a", "n").agg(F.min(owner).alias("x"), F.first("bits").alias("bits"))
    sets = materialize(sets.select("a", "n", "x.id", "x.th", "bits"))
    members = materialize(_different(materialize(_members(docs, _frequent(described), k, percent))))
    rows = members.select("key", "salt", "a", "n", "pos").join(sets.select("a", "bits"), "a").repartition("key", "salt")
    rows = rows.sortWithinPartitions("key", "salt", "n", "a").mapInArrow(_in_groups(percent), "a bigint, b bigint")
    clusters = components(rows)
    large = members.filter(F.col("often") | (F.col("m") >= BLOCK))
    if not large.isEmpty():
        across = _across_blocks(large, sets, clusters, percent)
        clusters = components(clusters.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    return _compared(docs, sets, clusters, k, percent)


def near_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, root (one set of its component), th.

    Sets hold the distinct shingles of k words of the text with A-Z in lower case, or the whole
    sequence of a shorter text. Sets link when 100 * intersection >= percent * union. component_id is
    the least doc_id that links reach. A text without words, or null, links with nothing. A null id
    is left out of the least unless all ids of a component are null.
    """
    described = describe(docs.select("doc_id", text_of().alias("text")), k)
    found = components(links(docs, described, k, percent))
    least = described.filter("n > 0").groupBy("a").agg(F.min("doc_id").alias("least"))
    rooted = least.join(found.select(F.col("node").alias("a"), "root"), "a", "left").withColumn(
        "root", F.coalesce("root", "a")
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("a", "component_id", "root")
    rows = described.select("doc_id", F.col("n").alias("n_shingles"), "a", "th")
    return rows.join(named, "a", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "root",
        "th",
    )


def drop_near_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the one with the least id, then text hash.

    Rows without words all stay. Null ids sort first.
    """
    found = near_copies(docs, k, percent)
    first = F.min(F.struct("doc_id", "th")).alias("first")
    kept = found.filter("n_shingles > 0").groupBy("root").agg(first).select("first.doc_id", "first.th")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("h"))
    empty = ~text_of("row.text").rlike(r"[^\x20\x09-\x0D]")
    on = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    one = Window.partitionBy("id", "h").orderBy("id")
    rows = packed.filter(~empty).join(kept, on, "left_semi").withColumn("nth", F.row_number().over(one))
    return rows.filter("nth = 1").select("row.*").unionByName(packed.filter(empty).select("row.*"))
