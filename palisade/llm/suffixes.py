"""Suffixes of the contexts of a block, sorted by comparing hashes.

Contexts that share an anchor lie one below the other, anchors in one column. Prefix polynomial hashes of each row give
the hash of any of its stretches; equal stretches in the same columns have equal differences. Two suffixes are compared by
binary search for their longest common extension, in about log2(length) probes, and then by the symbol after it. A
mergesort with such comparisons sorts the suffixes that begin in one column of one block; all columns and blocks go on
at once, a merge being a binary search of each suffix in its sibling run. Extensions that reach the length asked for
are verified symbol by symbol; where hashes were wrong, the bucket is sorted by its symbols.
"""

from __future__ import annotations

import numpy as np

from palisade.llm.repeats import powers

#: Pairs that are verified at once.
VERIFY = 1 << 16


class Block:
    """symbols: a matrix, rows from column ``begin`` to ``end`` (exclusive)."""

    def __init__(self, symbols: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.symbols, self.begin, self.end = symbols, begin, end
        self.width = symbols.shape[1] + 1
        prefix = np.zeros((len(symbols), self.width), np.uint64)
        np.cumsum(hashes * powers(1 << 21)[0][: symbols.shape[1]], axis=1, out=prefix[:, 1:])
        self.prefix = prefix.ravel()

    def extension(self, a: np.ndarray, b: np.ndarray, col: np.ndarray, most: int) -> np.ndarray:
        """How many symbols rows a and b share from a column on, ``most`` at most."""
        p, at_a, at_b = self.prefix, a * self.width + col, b * self.width + col
        diff = p[at_a] - p[at_b]
        hi = np.minimum(np.minimum(self.end[a], self.end[b]) - col, most)
        lo = np.where(p[at_a + hi] - p[at_b + hi] == diff, hi, 0)
        hi = np.where(lo == hi, hi, hi - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_] + 1) >> 1
            same = p[at_a[open_] + mid] - p[at_b[open_] + mid] == diff[open_]
            lo[open_[same]] = mid[same]
            hi[open_[~same]] = mid[~same] - 1
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def order(self, a: np.ndarray, b: np.ndarray, col: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1 as the suffix of row a is less than, equal to or greater than that of b."""
        n = self.extension(a, b, col, most)
        left_a, left_b = np.minimum(self.end[a] - col, most) - n, np.minimum(self.end[b] - col, most) - n
        last = self.symbols.shape[1] - 1
        x, y = self.symbols[a, np.minimum(col + n, last)], self.symbols[b, np.minimum(col + n, last)]
        both = (left_a > 0) & (left_b > 0)
        return np.where(both, np.where(x < y, -1, np.where(x > y, 1, 0)), np.sign(left_a - left_b))

    def sort(self, row: np.ndarray, col: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
        """The order of suffixes (row, col), by bucket and then by symbols; a bucket's suffixes begin in one column."""
        order = np.argsort(bucket, kind="stable")
        if not len(order):
            return order
        key = bucket[order]
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(start, append=len(key))
        first, size = np.repeat(start, sizes), np.repeat(sizes, sizes)
        at = np.arange(len(key)) - first
        length = 1
        while length < sizes.max():
            run = at // length
            sibling = (run ^ 1) * length
            n = np.clip(size - sibling, 0, length)
            active = np.flatnonzero(n > 0)
            r, c = row[order], col[order]
            begin = (first + sibling)[active]
            lo, hi = np.zeros(len(active), np.int64), n[active]
            later = (run[active] & 1).astype(bool)  # equal suffixes keep their order
            open_ = np.arange(len(active))
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                e, f = active[open_], begin[open_] + mid
                sign = self.order(r[f], r[e], c[e], most)
                less = np.where(later[open_], sign <= 0, sign < 0)
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
                open_ = open_[lo[open_] < hi[open_]]
            new = at.copy()
            new[active] = (run[active] >> 1) * 2 * length + at[active] - run[active] * length + lo
            merged = np.empty_like(order)
            merged[first + new] = order
            order = merged
            length *= 2
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Whether rows a and b share n symbols from a column on, by the symbols."""
        out = np.empty(len(a), bool)
        step = np.arange(n)
        for i in range(0, len(a), VERIFY):
            at = col[i : i + VERIFY, None] + step
            out[i : i + VERIFY] = (self.symbols[a[i : i + VERIFY, None], at] == self.symbols[b[i : i + VERIFY, None], at]).all(1)
        return out

    def suffixes(self, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, col, bucket of every suffix that a window begins, where its bucket has others."""
        n = self.end - self.begin - window + 1
        row = np.repeat(np.arange(len(n)), n)
        col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[row]
        bucket = group[row] * self.width + col
        shared = np.bincount(bucket)[bucket] > 1
        return row[shared], col[shared], bucket[shared]

    def neighbours(self, row: np.ndarray, col: np.ndarray, bucket: np.ndarray, window: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order of suffixes, and for each place how much its suffix shares with the one before (0: another bucket).

        Extensions of a window or more are verified."""
        order = self.sort(row, col, bucket, most)
        r, c, k = row[order], col[order], bucket[order]
        shared = np.zeros(len(order), np.int64)
        pair = np.flatnonzero(k[1:] == k[:-1]) + 1
        shared[pair] = self.extension(r[pair - 1], r[pair], c[pair], most)
        long = np.flatnonzero(shared >= window)
        wrong = long[~self.verified(r[long - 1], r[long], c[long], window)]
        for bad in np.unique(k[wrong]):  # hashes collided: this bucket is sorted by its symbols
            places = np.flatnonzero(k == bad)
            whole = [self.symbols[row[i], col[i] : min(self.end[row[i]], col[i] + most)].tolist() for i in order[places]]
            own = sorted(range(len(places)), key=whole.__getitem__)
            order[places] = order[places][own]
            for p, i, j in zip(places[1:], own, own[1:], strict=False):
                shared[p] = next((n for n, (x, y) in enumerate(zip(whole[i], whole[j], strict=False)) if x != y), min(len(whole[i]), len(whole[j])))
        return order, shared


def reaches(row: np.ndarray, col: np.ndarray, end: np.ndarray, rows: int, anchor: int) -> list[list[dict]]:
    """For each row, runs of window starts that follow each other and match up to the same column, relative to the anchor's."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    if len(row):
        order = np.lexsort((col, row))
        row, col, end = row[order], col[order], end[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (end[1:] != end[:-1])]))
        last = np.append(new[1:], len(row)) - 1
        for r, a, b, e in zip(row[new].tolist(), (col[new] - anchor).tolist(), (col[last] - anchor).tolist(), (end[new] - anchor).tolist(), strict=True):
            out[r].append({"first": a, "last": b, "end": e})
    return out


def runs(row: np.ndarray, col: np.ndarray, rows: int, anchor: int, window: int) -> list[list[dict]]:
    """For each row, runs of window starts that follow each other, and where the last of their windows ends."""
    out = reaches(row, col, np.zeros(len(col), np.int64), rows, anchor)
    for found in out:
        for x in found:
            x["end"] = x["last"] + window
    return out
