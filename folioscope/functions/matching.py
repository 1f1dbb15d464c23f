"""Matching blocks of two sequences: the longest common stretch, then again to its left and right.

Equal elements of two sequences are points; stretches are runs of points along diagonals. All runs are found at once, by one
sort of the points. A step then only clips the runs to its part of both sequences, as vectors, and takes the longest, the
first at ties; so nothing is compared twice, however deep the parts go.

With ``popular`` an element that makes up more than a hundredth of a second sequence of 200 or more starts no stretch,
but a stretch goes on over it. Results depend on the order of the arguments.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the popularity rule: the least length, and the share of it (plus one) that makes an element popular.
POPULAR_FROM, POPULAR_SHARE = 200, 100


def coded(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences of hashable elements as numbers."""
    number: dict = {}
    return tuple(np.fromiter((number.setdefault(x, len(number)) for x in s), np.int64, len(s)) for s in (a, b))


def _points(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of equal elements."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, diagonal (j - i) and length of the runs of points."""
    at = np.lexsort((i, j - i))
    i, d = i[at], (j - i)[at]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])) if len(i) else np.zeros(0, np.int64)
    return i[first], d[first], np.diff(np.append(first, len(i)))


class Blocks:
    """The matching blocks of two sequences of numbers: (i, j, length), by place."""

    def __init__(self, a: np.ndarray, b: np.ndarray, popular: bool = False):
        self.a, self.b = a, b
        i, j = _points(a, b)
        self.whole = not (popular and len(b) >= POPULAR_FROM)
        if not self.whole:
            rare = (np.bincount(b)[b] <= len(b) // POPULAR_SHARE + 1)[j]
            i, j = i[rare], j[rare]
        self.start, self.diagonal, n = _runs(i, j)
        self.end = self.start + n
        self.found: list[tuple[int, int, int]] = []
        parts = [((0, len(a), 0, len(b)), np.arange(len(self.start)))]
        while parts:
            (left, right, low, high), runs = parts.pop()
            if left == right or low == high:
                continue
            i, j, n, runs = self._longest(left, right, low, high, runs)
            if n:
                self.found.append((i, j, n))
                parts += [((left, i, low, j), runs), ((i + n, right, j + n, high), runs)]
        self.found.sort()

    def _longest(self, left: int, right: int, low: int, high: int, runs: np.ndarray) -> tuple[int, int, int, np.ndarray]:
        """The longest stretch inside a[left:right] and b[low:high], the first in a, then in b; and the runs that reach in."""
        diagonal = self.diagonal[runs]
        s = np.maximum(np.maximum(self.start[runs], left), low - diagonal)
        n = np.minimum(np.minimum(self.end[runs], right), high - diagonal) - s
        inside = n > 0
        runs, diagonal, s, n = runs[inside], diagonal[inside], s[inside], n[inside]
        if len(n):
            same = np.flatnonzero(n == n.max())
            k = same[np.lexsort((diagonal[same], s[same]))[0]]
            i, j, n = int(s[k]), int(s[k] + diagonal[k]), int(n[k])
        else:
            i, j, n = left, low, 0
        if not self.whole:  # on over popular elements, which can also open the part
            while i > left and j > low and self.a[i - 1] == self.b[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < right and j + n < high and self.a[i + n] == self.b[j + n]:
                n += 1
        return i, j, n, runs

    @property
    def matched(self) -> int:
        return sum(n for *_, n in self.found)

    def pairs(self) -> list[tuple[int, int]]:
        return [(i + x, j + x) for i, j, n in self.found for x in range(n)]


def spans_in_lockstep(n: int, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n pairs of sequences, each with a point or more: elements in matching blocks, and the first and the last place of these
    in the second sequence. Points (i, j) are the places of equal elements. It gives what ``Blocks`` gives without ``popular``:
    a step takes the longest stretch of every part of every pair and clips the other runs to its left and right."""
    far = np.iinfo(np.int64).max
    matched, first, last = np.zeros(n, np.int64), np.full(n, far), np.full(n, -1)
    d = j - i
    order = np.lexsort((i, d, pair))
    pair, s, d = pair[order], i[order], d[order]
    head = np.ones(len(s), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
    head = np.flatnonzero(head)
    e = s[np.append(head[1:], len(s)) - 1] + 1 if len(head) else s
    pair, s, d = pair[head], s[head], d[head]
    part = pair
    while len(s):
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(s))))
        long = e - s
        size = np.maximum.reduceat(long, heads)
        same = long == size[of]
        start = np.minimum.reduceat(np.where(same, s, far), heads)
        same &= s == start[of]
        at = start + np.minimum.reduceat(np.where(same, d, far), heads)
        own = pair[heads]
        np.add.at(matched, own, size)
        np.minimum.at(first, own, at)
        np.maximum.at(last, own, at + size - 1)
        before = np.minimum(e, np.minimum(start[of], at[of] - d))
        after = np.maximum(s, np.maximum((start + size)[of], (at + size)[of] - d))
        left, right = s < before, after < e
        part = np.concatenate([of[left], of[right] + len(heads)])
        pair, d = np.concatenate([pair[left], pair[right]]), np.concatenate([d[left], d[right]])
        s, e = np.concatenate([s[left], after[right]]), np.concatenate([before[left], e[right]])
    return matched, first, last


def characters(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def ratio(a: str, b: str, popular: bool) -> float:
    """Twice the characters in matching blocks over all characters; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = characters(a), characters(b)
    if popular and len(y) >= POPULAR_FROM:
        x, y = coded(x.tolist(), y.tolist())  # small numbers to count by
    return 2.0 * Blocks(x, y, popular).matched / (len(x) + len(y))


def common_bound(a: str, b: str) -> float:
    """A bound on the ratio: the characters that both have, wherever they stand."""
    x, y = characters(a), characters(b)
    values, counts = np.unique(np.concatenate([x, y]), return_counts=True)
    mine = np.zeros(len(values), np.int64)
    np.add.at(mine, np.searchsorted(values, x), 1)
    return 2.0 * np.minimum(mine, counts - mine).sum() / max(len(x) + len(y), 1)
