"""Trees of OR-combined bitmaps, and their dual traversal for the pairs that could be similar enough.

A member is a set: its size, a bitmap with one bit per hashed element, the place of the shared key in
its order, and the component it is already known to be in. A node holds the bits of all its members
and the range of their sizes. Of x at most n(x) - |bits of x that y lacks| elements are in y, so a pair
of nodes or members whose largest possible overlap is too small is left with all below it; so is a
pair of nodes whose members all belong to one component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WIDTH = 1024
FANOUT = 8


def required(nx, ny, percent: int):
    """Least overlap of sets of these sizes with Jaccard similarity of percent / 100 or more."""
    return -(-percent * (nx + ny) // (100 + percent))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits of a set, about two for each element; as bytes, a power of two of them."""
    bits = max(64, 1 << int(2 * max(len(hashes), 1) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap for a power of two of bytes: larger ones OR-ed together, smaller ones repeated.

    A repeated bitmap says yes at every place an element might have, which keeps bounds valid.
    """
    if len(bits) > size:
        return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)
    return np.tile(bits, size // len(bits))


def could_link(nx: int, bx: bytes, ny: int, by: bytes, percent: int) -> bool:
    """Whether two sets of these sizes and bitmaps could be similar enough."""
    need = required(nx, ny, percent)
    if min(nx, ny) < need:
        return False
    x, y = np.frombuffer(bx, np.uint8), np.frombuffer(by, np.uint8)
    size = min(len(x), len(y))
    x, y = fold(x, size), fold(y, size)
    missing_x = int(np.bitwise_count(x & ~y).sum())
    missing_y = int(np.bitwise_count(y & ~x).sum())
    return nx - missing_x >= need and ny - missing_y >= need


class Tree:
    """Levels of nodes over members in ascending order of size; level 0 are the members."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, bits: list[bytes], group: np.ndarray):
        order = np.argsort(n, kind="stable")
        self.order, self.n, self.pos = order, n[order], pos[order]
        self.bits = [bits[i] for i in order]
        self.group = group[order]
        folded = np.stack([fold(np.frombuffer(b, np.uint8), WIDTH // 8) for b in self.bits]).view(np.uint64)
        # elements of a member beyond one per bit: they add to its overlap unseen
        own = np.array([int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in self.bits], np.int64)
        extra = self.n - np.minimum(own, np.bitwise_count(folded).sum(axis=1).astype(np.int64))
        level = (folded, self.n, self.n, extra, self.group, np.ones(len(n), bool))
        self.levels = [level]
        while len(level[1]) > 1:
            cuts = np.arange(0, len(level[1]), FANOUT)
            same = np.minimum.reduceat(level[4], cuts) == np.maximum.reduceat(level[4], cuts)
            level = (
                np.bitwise_or.reduceat(level[0], cuts, axis=0),
                np.minimum.reduceat(level[1], cuts),
                np.maximum.reduceat(level[2], cuts),
                np.maximum.reduceat(level[3], cuts),
                np.minimum.reduceat(level[4], cuts),
                same & np.logical_and.reduceat(level[5], cuts),
            )
            self.levels.append(level)


def _survivors(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes i of a and j of b could hold a pair that is needed."""
    need = required(a[1][i], b[1][j], percent)
    sizes = (100 * np.minimum(a[2][i], b[2][j]) >= percent * np.maximum(a[1][i], b[1][j]))
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64)
    overlap = shared + np.minimum(a[3][i], b[3][j])
    one = a[5][i] & b[5][j] & (a[4][i] == b[4][j])
    return sizes & (overlap >= need) & ~one


def candidate_pairs(
    a: Tree, b: Tree | None, percent: int, most: int = 1 << 16, joined: Callable[[int, int], bool] | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs (place in a, place in b) that could link; within a, where b is None.

    Pairs of places that ``joined`` holds by the time they are reached are left out.
    """
    other = b or a
    depth = max(len(a.levels), len(other.levels)) - 1
    start = (np.zeros(1, np.int64), np.zeros(1, np.int64))
    todo = [(depth, *start)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > most:  # bounded memory: halves one after the other
            half = len(i) // 2
            todo += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        x, y = a.levels[min(level, len(a.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
        keep = _survivors(x, i, y, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            for p, q in zip(i.tolist(), j.tolist()):
                if (b is None and p >= q) or a.group[p] == other.group[q]:
                    continue
                x, y = int(a.order[p]), int(other.order[q])
                if (joined is None or not joined(x, y)) and _leaf(a, p, other, q, percent):
                    yield x, y
            continue
        i, j = _below(i, a, level), _below(j, other, level)
        rows = [(p, q) for p, q in zip(i, j)]
        left = np.concatenate([np.repeat(p, len(q)) for p, q in rows])
        right = np.concatenate([np.tile(q, len(p)) for p, q in rows])
        if b is None:
            ordered = left <= right
            left, right = left[ordered], right[ordered]
        todo.append((level - 1, left, right))


def _below(nodes: np.ndarray, tree: Tree, level: int) -> list[np.ndarray]:
    """Children of nodes; a tree that is less deep waits at its root."""
    if level >= len(tree.levels):
        return [np.array([k]) for k in nodes]
    n = len(tree.levels[level - 1][1])
    return [np.arange(k * FANOUT, min(n, (k + 1) * FANOUT)) for k in nodes]


def _leaf(a: Tree, p: int, b: Tree, q: int, percent: int) -> bool:
    nx, ny = int(a.n[p]), int(b.n[q])
    # at their first shared key all elements before it are unshared
    if min(nx - int(a.pos[p]), ny - int(b.pos[q])) < required(nx, ny, percent):
        return False
    return could_link(nx, a.bits[p], ny, b.bits[q], percent)
