"""An FM-index over a shard of words, all in numpy.

The text is a sequence of symbols from 1 to ``sigma - 1``; a 0 stands for
everything no phrase holds (other words, ends of texts) and every one of them
counts as different from all others, so no match runs over it. Suffixes are
sorted by prefix doubling. The Burrows-Wheeler transform is kept as a wavelet
matrix whose bit vectors have prefix counts, so a rank is two look-ups a
level. Phrases are searched backward, all at once; occurrences are located by
walking to a sampled suffix position.
"""

from __future__ import annotations

import numpy as np

#: Every how many positions a suffix position is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; zeros order by position and end a suffix."""
    n = len(text)
    gap = text == 0
    rank = np.where(gap, np.cumsum(gap) - 1, text.astype(np.int64) + n)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        held = rank[order]
        new = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])]) if n else held
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: n - width] = rank[width:] + 1
        nxt[gap] = 0  # already told apart by position
        key = rank * (n + 2) + nxt
        # only suffixes that are still tied have to be sorted again
        size = np.bincount(new, minlength=n)
        tied = size[rank[order]] > 1
        at = np.flatnonzero(tied)
        sub = order[at]
        order[at] = sub[np.argsort(key[sub], kind="stable")]
        rank = key
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        if not len(text) or text[-1]:
            text = np.append(text, 0).astype(np.int32)  # the transform needs an end that differs from all symbols
        n = len(text)
        sa = suffix_array(text)
        before = np.where(sa > 0, sa - 1, n - 1)
        bwt = text[before].astype(np.int64)
        self.n, self.sigma = n, sigma
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:sigma]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        here = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (here >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            here = np.concatenate([here[bit == 0], here[bit == 1]])
        self.bwt = bwt.astype(np.int32)
        # kept positions: every SAMPLE-th, and all that follow a gap, so no walk crosses one
        keep = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(keep)])
        self.positions = sa[keep]
        self.is_kept = keep

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start, end = np.zeros_like(at), at.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level]
            bit = ((symbol >> b) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, self.zeros[level] + s1, start - s1)
            end = np.where(bit, self.zeros[level] + e1, end - e1)
        return end - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [from, to) of the suffixes that begin with each phrase (one a line of ``phrases``, no zeros)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            l, h = self.first[c] + self.rank(c, lo[alive]), self.first[c] + self.rank(c, hi[alive])
            lo[alive], hi[alive] = l, h
            alive = alive[h > l]
            if not len(alive):
                break
        hi = np.maximum(hi, lo)
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes at ``rows``."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_kept[rows])
        while len(walking):
            r = rows[walking]
            c = self.bwt[r].astype(np.int64)
            rows[walking] = self.first[c] + self.rank(c, r.astype(np.int64))
            steps[walking] += 1
            walking = walking[~self.is_kept[rows[walking]]]
        return self.positions[self.kept[rows]] + steps
