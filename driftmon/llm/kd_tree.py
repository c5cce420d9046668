"""K-d trees over letter-count vectors.

A vector counts a word's letters in 32 dimensions, each count up to two, as a
64-bit code in unary: one bit for "at least one", one for "at least two".  The
L1 distance of two vectors is the number of bits that differ, and never more
than that of the full counts, so a word within one edit is within distance two
(one if a letter was added or lost).  A cut of the tree is a bit: a letter
count below or from a limit.  A node's box is the bits that all its points
have and the bits that any of them may have, which gives the distance of a
vector from the box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIMENSIONS = 32
_BITS = np.arange(64, dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def points_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words in a row, and each word's length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unary code of each word's letter counts, and each word's length."""
    flat, size = points_of(words)
    letter = flat.astype(np.int64)
    latin = (letter >= 97) & (letter < 123)
    dim = np.where(latin, letter - 97, 26 + letter % (DIMENSIONS - 26))
    count = np.bincount(np.repeat(np.arange(len(words)), size) * DIMENSIONS + dim, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)
    code = np.zeros(len(words), np.uint64)
    for k in range(DIMENSIONS):
        code |= (count[:, k] >= 1).astype(np.uint64) << np.uint64(2 * k) | (count[:, k] >= 2).astype(np.uint64) << np.uint64(2 * k + 1)
    return code, size


class KdTree:
    """A tree over ``codes``; ``tight`` boxes hold the points given, others all vectors that fall there.

    ``order`` lists the points by leaf, ``leaves`` the part of it that each leaf has.
    """

    def __init__(self, codes: np.ndarray, leaf_rows: int, tight: bool):
        self.order = np.arange(len(codes))
        self.nodes: list[tuple] = []  # must, may, left, right, leaf
        self.leaves: list[tuple[int, int]] = []
        self._grow(codes, 0, len(codes), leaf_rows, tight, np.uint64(0), _ALL)

    def _grow(self, codes, begin, end, leaf_rows, tight, must, may) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        own = codes[self.order[begin:end]]
        if tight and len(own):
            must, may = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        bit, n = -1, end - begin
        if n > leaf_rows:
            ones = np.zeros(64, np.int64)
            for k in range(0, n, 65_536):
                ones += ((own[k : k + 65_536, None] >> _BITS) & np.uint64(1)).sum(0).astype(np.int64)
            bit = int(np.argmin(np.abs(2 * ones - n)))
            if not 0 < ones[bit] < n:
                bit = -1
        if bit < 0:
            self.nodes[at] = (must, may, -1, -1, len(self.leaves), -1)
            self.leaves.append((begin, end))
            return at
        has = (own >> np.uint64(bit)) & np.uint64(1) == 1
        part = self.order[begin:end]
        self.order[begin:end] = np.concatenate([part[~has], part[has]])
        cut = begin + int((~has).sum())
        # "at least two" implies "at least one"
        lost = np.uint64(3 << bit if bit % 2 == 0 else 1 << bit)
        won = np.uint64(1 << bit if bit % 2 == 0 else 3 << (bit - 1))
        left = self._grow(codes, begin, cut, leaf_rows, tight, must, may & ~lost)
        right = self._grow(codes, cut, end, leaf_rows, tight, must | won, may)
        self.nodes[at] = (must, may, left, right, -1, bit)
        return at

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls in."""
        out = np.zeros(len(codes), np.int64)
        todo = [(0, np.arange(len(codes)))]
        while todo:
            at, some = todo.pop()
            _, _, left, right, leaf, bit = self.nodes[at]
            if leaf >= 0:
                out[some] = leaf
                continue
            has = (codes[some] >> np.uint64(bit)) & np.uint64(1) == 1
            todo += [(left, some[~has]), (right, some[has])]
        return out

    def near(self, codes: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the vectors (by place) whose distance from the leaf's box is at most ``reach``."""
        todo = [(0, np.arange(len(codes)))]
        while todo:
            at, some = todo.pop()
            must, may, left, right, leaf, _ = self.nodes[at]
            own = codes[some]
            some = some[np.bitwise_count((must & ~own) | (own & ~may)) <= reach]
            if not len(some):
                continue
            if leaf >= 0:
                yield leaf, some
            else:
                todo += [(left, some), (right, some)]

    def pairs(self, codes: np.ndarray, points: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of vectors and of the tree's ``points`` that are at most ``reach`` apart."""
        for leaf, some in self.near(codes, reach):
            begin, end = self.leaves[leaf]
            own = self.order[begin:end]
            for k in range(0, len(some), max(1, 1_000_000 // max(1, end - begin))):
                part = some[k : k + max(1, 1_000_000 // max(1, end - begin))]
                q, p = np.nonzero(np.bitwise_count(codes[part][:, None] ^ points[own][None, :]) <= reach)
                if len(q):
                    yield part[q], own[p]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (code points, one word a row) differ by exactly one edit.

    The words of ``b`` are as long as those of ``a`` or one longer.
    """
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    lead = np.hstack([a == b[:, :length], np.zeros((len(a), 1), bool)])
    tail = np.hstack([(a == b[:, 1:])[:, ::-1], np.zeros((len(a), 1), bool)])
    return lead.argmin(1) + tail.argmin(1) >= length


def edit_pairs(tree: KdTree, points: np.ndarray, own: np.ndarray, codes: np.ndarray, other: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, point) of words one edit apart; ``own`` and ``other`` hold the code points of points and queries.

    Queries are as long as the points (``reach`` 2) or one shorter (``reach`` 1).
    """
    each = max(1, 2_000_000 // max(1, own.shape[1]))
    for q, p in tree.pairs(codes, points, reach):
        for k in range(0, len(q), each):
            some = one_edit(other[q[k : k + each]], own[p[k : k + each]])
            yield q[k : k + each][some], p[k : k + each][some]
