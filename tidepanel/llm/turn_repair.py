"""Repair of conversations: the cheapest edits after which roles follow ``(s?(ua)+)?``.

Edits of a turn are K(eep), R(erole to user or assistant) and D(elete); I(nsert) puts an empty user or
assistant turn anywhere. A depth-first branch-and-bound with an explicit stack looks for the cheapest
edits and, among those, for the ASCII-least string of their initials (the audit).

A conversation may hold a large share of all rows. Rows are dealt out by ranges of (conversation,
turn), so it may lie in many tasks. A conversation that lies inside one task is searched there. One
that touches the border of a task, or outgrows ``SEGMENT``, is cut into segments; a segment is searched
for each state it can be entered in and left in, and the searches of its segments are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import materialize

#: Most rows of a conversation that are searched at once.
SEGMENT = 1 << 15
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: Where a repaired conversation may stand: before its first turn, or behind a turn of this role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an inserted or reroled one becomes, by where it stands.
NEXT = (USER, USER, ASSISTANT, USER)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAR = 1 << 60

#: One stretch of turns: must it go, initial of its role, cost of leaving it, number of turns.
Token = tuple[bool, str, int, int]


def suffix_bounds(tokens: list[Token], exits: Iterable[int]) -> list[list[int]]:
    """Least cost, from each position and state, of everything behind it."""
    here = [0 if state in exits else FAR for state in range(4)]
    bounds = []
    for token in [None, *reversed(tokens)]:
        if token is not None:
            must, initial, extra, times = token
            now = [DELETE * times + cost for cost in here]
            if not must:
                for state in range(4):
                    now[state] = min(now[state], REROLE + extra + here[NEXT[state]])
                    kept = KEEPS.get((state, initial))
                    if kept is not None:
                        now[state] = min(now[state], extra + here[kept])
            here = now
        for _ in range(2):  # two turns put in lead from any state as far as any number of them
            here = [min(cost, INSERT + here[NEXT[state]]) for state, cost in enumerate(here)]
        bounds.append(here)
    return bounds[::-1]


def _steps(token: Token | None, pos: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letters, next position, next state, cost) of the edits that may come next, in ASCII order."""
    steps = [("I", pos, NEXT[state], INSERT)]
    if token is None:
        return steps
    must, initial, extra, times = token
    steps.insert(0, ("D" * times, pos + 1, state, DELETE * times))
    if not must:
        kept = KEEPS.get((state, initial))
        if kept is not None:
            steps.append(("K", pos + 1, kept, extra))
        steps.append(("R", pos + 1, NEXT[state], REROLE + extra))
    return steps


def search(tokens: list[Token], entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least (cost, audit) of the edits that lead from ``entry`` through all tokens to an exit.

    Edits are tried in ASCII order, so audits come in ascending order: an audit that reaches a node
    (position, state) no cheaper than an earlier one is dominated, and a whole one that is no cheaper
    than the incumbent cannot be better. The first incumbent follows the bounds greedily; at its cost
    only a smaller audit may still replace it. The search ends when the stack is empty.
    """
    bounds = suffix_bounds(tokens, exits)
    if bounds[0][entry] >= FAR:
        return None
    incumbent, proved = _greedy(tokens, entry, exits, bounds), False
    dominance: list[dict[int, int]] = [{} for _ in range(len(tokens) + 1)]
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        pos, state, cost, depth, letters = stack.pop()
        least = cost + bounds[pos][state]
        if least > incumbent[0] or (proved and least == incumbent[0]):
            continue
        if dominance[pos].get(state, FAR) <= cost:
            continue
        dominance[pos][state] = cost
        del path[depth:]
        path.append(letters)
        if pos == len(tokens) and state in exits:
            incumbent, proved = (cost, "".join(path)), True
            continue
        token = tokens[pos] if pos < len(tokens) else None
        for letters, to, then, more in reversed(_steps(token, pos, state)):
            stack.append((to, then, cost + more, depth + 1, letters))
    return incumbent


def _greedy(tokens: list[Token], entry: int, exits: tuple[int, ...], bounds: list[list[int]]) -> tuple[int, str]:
    pos, state, cost, letters = 0, entry, 0, []
    while not (pos == len(tokens) and state in exits):
        token = tokens[pos] if pos < len(tokens) else None
        # every step but a turn put in moves on, so that one is taken last
        steps = sorted(_steps(token, pos, state), key=lambda s: (s[3] + bounds[s[1]][s[2]], s[0] == "I"))
        more, pos, state, price = steps[0]
        letters.append(more)
        cost += price
    return cost, "".join(letters)


def tokens_of(rows: list[tuple[str, str, int]]) -> Iterator[Token]:
    """Tokens of (fault, initial of the role, turns alike): of turns alike all but one are duplicates."""
    run = 0
    for fault, initial, times in rows:
        gone = times if fault in ("blank", "duplicate") else times - 1
        if gone < times:
            if run:
                yield True, "", 0, run
            yield False, initial, CUT_OFF if fault == "truncated" else 0, 1
            run = 0
        run += gone
    if run:
        yield True, "", 0, run


def repaired_turns(turns: Iterable[tuple[str, str, int]], audit: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its turns (role, text, turns alike) and its audit."""
    letters, state = iter(audit), START

    def put_in(letter):
        nonlocal state
        while letter == "I":
            state = NEXT[state]
            yield ROLES[state], ""
            letter = next(letters, None)
        return letter

    letter = next(letters, None)
    for role, text, times in turns:
        for _ in range(times):
            letter = yield from put_in(letter)
            if letter == "K":
                state = KEEPS[state, role[:1]]
                yield role, text
            elif letter == "R":
                state = NEXT[state]
                yield ROLES[state], text
            letter = next(letters, None)
    yield from put_in(letter)


class Tally:
    """Counts over consecutive rows of one conversation; tallies of its segments add up in order."""

    NAMES = ("low", "high", "distinct", "turn", "blank", "duplicate", "truncated", "illegal", "head", "last")

    def __init__(self, **values):
        for name in self.NAMES:
            setattr(self, name, values.get(name, 0 if name in ("distinct", "blank", "duplicate", "truncated", "illegal") else None))
        self.first_turn = values.get("first_turn")

    def add(self, turn: int | None, fault: str, initial: str, times: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = self.first_turn = turn
            self.distinct += turn != self.turn
            self.high = self.turn = turn
        if fault == "blank":
            self.blank += times
        else:
            self.duplicate += times if fault == "duplicate" else times - 1
            self.truncated += fault == "truncated"
        if self.last is not None:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.head = initial
        self.illegal += (times - 1) * ((initial, initial) not in LEGAL)
        self.last = initial

    def join(self, other: Tally) -> None:
        """Take in the tally of the rows that follow."""
        if other.low is not None:
            self.distinct += other.distinct - (self.turn is not None and self.turn == other.first_turn)
            self.low = other.low if self.low is None else self.low
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.high, self.turn = other.high, other.turn
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.head is not None:
            if self.last is not None:
                self.illegal += (self.last, other.head) not in LEGAL
            else:
                self.head = other.head
            self.last = other.last

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]

    def packed(self) -> dict:
        return {name: getattr(self, name) for name in (*self.NAMES, "first_turn")}


# ---------------------------------------------------------------------------------------------
# Rows as Spark sees them
# ---------------------------------------------------------------------------------------------

_ROW = "conv_id bigint, turn bigint, role string, text string, times bigint, h string, fault string"
_SUMMARY = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of rows damaged as CRC-32 of ``conv_id:turn`` says.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes
    it the user's. Nulls are one space. A dropped row stays as one with ``times`` 0, so that its
    conversation is not lost.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    gone = kind == 0
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.when(~gone, F.col("turn").cast("bigint")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(known("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns alike as one row with their number, dealt out and sorted by conversation and turn."""
    alike = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").cast("bigint").alias("times"))
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(seen == "", "blank").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = alike.withColumn(
        "h", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ).withColumn("fault", fault)
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "h"]
    return rows.repartitionByRange(spread, *keys).sortWithinPartitions(*keys)


def _digest(turns: Iterable[tuple[str, str, int]], audit: Iterable[str]) -> str:
    digest, between = hashlib.sha256(), b""
    for role, text in repaired_turns(turns, audit):
        digest.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return digest.hexdigest()


def _mark(rows: list[dict], seen: set[str]) -> None:
    """Make those rows duplicates whose role and text were seen before, and see the others."""
    for row in rows:
        if row["fault"] != "blank" and row["times"]:
            if row["h"] in seen:
                row["fault"] = "duplicate"
            seen.add(row["h"])


def _looked_at(rows: list[dict]) -> tuple[Tally, list[Token]]:
    tally, kept = Tally(), []
    for row in rows:
        if row["times"]:
            tally.add(row["turn"], row["fault"], row["role"][:1], row["times"])
            kept.append((row["fault"], row["role"][:1], row["times"]))
    return tally, list(tokens_of(kept))


_FIRST = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64())]
    + [("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("h", pa.string()), ("fault", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_FIRST_SQL = f"conv_id bigint, segment bigint, seq bigint, turn bigint, role string, text string, times bigint, h string, fault string, {_SUMMARY}"


def _solve_inside(limit: int):
    """Solves the conversations that lie inside the partition, hands on the others in segments."""

    def solved(rows: list[dict]) -> dict:
        _mark(rows, set())
        tally, tokens = _looked_at(rows)
        cost, audit = search(tokens)
        names = ("gaps", "blank", "duplicate", "truncated", "illegal")
        turns = ((row["role"], row["text"], row["times"]) for row in rows)
        return {
            "conv_id": rows[0]["conv_id"], **dict(zip(names, tally.counts())), "cost": cost, "audit": audit,
            "repaired_sha256": _digest(turns, audit),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 24
        conv, rows, is_open, out = None, [], True, []

        def opened() -> list[dict]:
            nonlocal segment
            segment += 1
            return [{**row, "segment": segment, "seq": i} for i, row in enumerate(rows)]

        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["conv_id"] != conv:
                    out.extend(opened() if is_open else [solved(rows)])
                    rows, is_open = [], False
                elif len(rows) >= limit:
                    is_open = True
                    out.extend(opened())
                    rows = []
                conv = row["conv_id"]
                rows.append(row)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, _FIRST)
                    out = []
        if rows:
            out.extend(opened())
        if out:
            yield pa.RecordBatch.from_pylist(out, _FIRST)

    return run


_TABLE = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64())]
    + [("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("turn", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [("head", pa.string()), ("last", pa.string()), ("first_turn", pa.int64())]
    + [("paths", pa.list_(pa.struct([(c, pa.int64()) for c in ("entry", "exit", "cost")] + [("audit", pa.string())])))]
)
_TABLE_SQL = (
    "conv_id bigint, segment bigint, low bigint, high bigint, distinct bigint, turn bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, head string, last string, first_turn bigint, "
    "paths array<struct<entry: bigint, exit: bigint, cost: bigint, audit: string>>"
)


def _search_segment(mine: pa.Table, seen: pa.Table) -> pa.Table:
    """The cheapest way through a segment from each state to each state."""
    rows = sorted(mine.to_pylist(), key=lambda row: row["seq"])
    if not rows:
        return _TABLE.empty_table()
    _mark(rows, set(seen.column("known").to_pylist() if seen.num_rows else ()))
    tally, tokens = _looked_at(rows)
    paths = []
    for entry in range(4):
        for exit_ in range(4):
            found = search(tokens, entry, (exit_,))
            if found:
                paths.append({"entry": entry, "exit": exit_, "cost": found[0], "audit": found[1]})
    row = {"conv_id": rows[0]["conv_id"], "segment": rows[0]["segment"], **tally.packed(), "paths": paths}
    return pa.Table.from_pylist([row], _TABLE)


class Chain:
    """Cheapest ways from the start of a conversation through the segments taken in so far.

    All live ways share their beginning as a rule, which is kept once.
    """

    def __init__(self):
        self.shared: list[str] = []
        self.live: dict[int, tuple[int, list[str]]] = {START: (0, [])}

    def take(self, paths: list[dict]) -> None:
        best: dict[int, tuple[int, list[str]]] = {}
        for path in paths:
            if path["entry"] in self.live:
                cost, pieces = self.live[path["entry"]]
                way = (cost + path["cost"], [*pieces, path["audit"]])
                old = best.get(path["exit"])
                if old is None or way[0] < old[0] or (way[0] == old[0] and "".join(way[1]) < "".join(old[1])):
                    best[path["exit"]] = way
        while all(p for _, p in best.values()) and len({p[0] for _, p in best.values()}) == 1:
            self.shared.append(next(iter(best.values()))[1][0])
            for _, pieces in best.values():
                pieces.pop(0)
        self.live = best

    def end(self) -> tuple[int, str]:
        cost, _, pieces = min((c, "".join(p), p) for state, (c, p) in self.live.items() if state in ENDS)
        return cost, "".join(self.shared + pieces)


_LAST = pa.schema(
    [("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by conversation, tables of segments before rows: join the tables, then digest the rows."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv, tally, chain = row["conv_id"], Tally(), Chain()
        while row is not None and row["conv_id"] == conv and row["paths"] is not None:
            tally.join(Tally(**{name: row[name] for name in (*Tally.NAMES, "first_turn")}))
            chain.take(row["paths"])
            row = next(stream, None)
        cost, audit = chain.end()

        def turns() -> Iterator[tuple[str, str, int]]:
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                yield row["role"], row["text"], row["times"]
                row = next(stream, None)

        digest = _digest(turns(), audit)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip([conv, *tally.counts(), cost, audit, digest], _LAST)], schema=_LAST
        )


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of ``turns`` (conv_id, turn, role, text, times): its faults and cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns come in
    order, null ones first, and those of one turn number in order of a hash of role and text; ``times``
    says how often a turn is there, 0 only names its conversation. A role that begins with none of s, u and
    a, an empty one too, cannot be kept. A conversation without turns has
    zeros, an empty audit and the hash of nothing. A null conv_id is a conversation of its own. Role and
    text are never null here (``damaged`` sees to it); rows that repeat are turns alike, of which all
    but the first are duplicates. At most ``segment`` rows of a
    conversation are held at a time, however long it is. Other columns are not read.
    """
    found = materialize(_ordered(turns).mapInArrow(_solve_inside(segment), _FIRST_SQL))
    summary = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    inside = found.filter("segment is null").select(*summary)
    rows = found.filter("segment is not null").select("conv_id", "segment", "seq", "turn", "role", "text", "times", "h", "fault")

    # role and text of a turn met in a segment before: the segments that hold them are few, their rows bounded
    told = rows.filter("times > 0 and fault != 'blank'").groupBy("conv_id", "h").agg(F.collect_set("segment").alias("where"))
    seen = told.filter("size(where) > 1").select("conv_id", "h", F.explode("where").alias("segment"), F.array_min("where").alias("least"))
    seen = seen.filter("segment > least").selectExpr("conv_id AS conv", "segment AS part", "h AS known")
    light = rows.select("conv_id", "segment", "seq", "turn", F.substring("role", 1, 1).alias("role"), "times", "h", "fault")
    tables = (
        light.groupBy("conv_id", "segment")
        .cogroup(seen.groupBy("conv", "part"))
        .applyInArrow(_search_segment, _TABLE_SQL)
    )
    both = tables.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(
        rows.select("conv_id", "segment", "seq", "role", "text", "times"), allowMissingColumns=True
    )
    order = ["conv_id", F.col("seq") >= 0, "segment", "seq"]
    joined = both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_join_segments, f"conv_id bigint, {_SUMMARY}")
    return inside.unionByName(joined)
