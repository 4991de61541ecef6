"""A compressed full-text index over sequences of 64-bit symbols, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class WaveletMatrix:
    """Rank of any symbol in a sequence, from one packed bit vector for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.bitwise_count(packed).astype(np.int32)
            self.bits.append(packed)
            self.counts.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(sigma)
        self.base = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below)
            at = np.where(c >> (self.levels - 1 - k) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c[i] stands before place at[i]."""
        return self._down(c, at) - self.base[c]


class FMIndex:
    """FM-index of several sequences; each has a number (a document's id), of which the smallest is kept.

    Suffixes are sorted by their first symbols only, as many as a power of two beyond the threshold; intervals
    of patterns up to that length are the same as in a full suffix array. The burrows-wheeler transform is held
    in a wavelet matrix. min_owner(): for a pattern of threshold symbols the smallest number of all sequences
    that hold it.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, owners: np.ndarray, threshold: int):
        assert 1 <= threshold < 256
        self.threshold = threshold
        self.alphabet, code = np.unique(symbols, return_inverse=True)
        sizes = np.diff(offsets)
        n = len(symbols) + len(sizes)
        text = np.zeros(n, np.int64)  # each sequence is followed by the separator 0
        place = np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)
        text[place] = code + 1
        owner = np.repeat(owners, sizes + 1)
        self.n, sigma = n, len(self.alphabet) + 1
        ranks, rank, h = [text.astype(np.int32)], text.astype(np.int64), 1
        while h <= threshold:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - h)] = rank[h:] + 1
            key = rank * (n + sigma + 2) + ahead
            order = np.argsort(key, kind="stable")
            in_order = key[order]
            step = np.zeros(n, np.int64)
            step[1:] = in_order[1:] != in_order[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            ranks.append(rank.astype(np.int32))
            h *= 2
        suffix = order
        self.lcp = self._lcp(suffix, ranks[:-1])
        del ranks
        before = text[suffix - 1]
        self.tree = WaveletMatrix(before, sigma)
        count = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(count) - count
        cut = self.lcp < threshold
        self.group = np.cumsum(cut) - 1
        self.least = np.minimum.reduceat(owner[suffix], np.flatnonzero(cut))
        self._parent = self._edges(threshold - 1)
        self.table = [self.lcp]
        while 2 << (len(self.table) - 1) <= n:
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _lcp(self, suffix: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Symbols that each suffix shares with the one before it, as far as the ranks tell."""
        a, b, n = suffix[:-1], suffix[1:], self.n
        got = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + got, b + got
            inside = (x < n) & (y < n)
            same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
            got += same.astype(np.int64) << k
        return np.concatenate([[0], np.minimum(got, 255)]).astype(np.uint8)

    def _edges(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the start and end of the suffixes that share their first length symbols with it."""
        starts = np.flatnonzero(self.lcp < length) if length else np.zeros(1, np.int64)
        which = np.searchsorted(starts, np.arange(self.n), "right") - 1
        return starts[which].astype(np.int32), np.append(starts[1:], self.n)[which].astype(np.int32)

    def _widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first length symbols of what [lo, hi) stands for."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.table) - 1, -1, -1):
            t, span = self.table[k], 1 << k
            # lcp[lo] >= length: the suffix before belongs to it as well
            at = lo - span + 1
            ok = (at > 0) & (t[np.clip(at, 0, len(t) - 1)] >= length)
            lo = np.where(ok, lo - span, lo)
            ok = (hi + span <= self.n) & (t[np.clip(hi, 0, len(t) - 1)] >= length)
            hi = np.where(ok, hi + span, hi)
        return lo, hi

    def encode(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols; 0 for those the index doesn't have."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0)

    def matching_statistics(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed sequences the length of the longest match that starts there, at most
        the threshold, and where it is the threshold the smallest owner of such a match (else the largest long).

        All sequences are read backward at once: each step searches one symbol further to the left; a match of
        full length, or one that can't be extended, first gives up symbols at its right end (its parent interval).
        """
        codes = self.encode(symbols)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = offsets[1:][order], sizes[order]
        length = np.zeros(len(symbols), np.int64)
        owner = np.full(len(symbols), np.iinfo(np.int64).max)
        lo, hi, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            n = int(np.searchsorted(-sizes, -back, "right"))
            at = ends[:n] - back
            c = codes[at]
            l, h, s = lo[:n], hi[:n], size[:n]
            full = s == self.threshold
            l, h, s = np.where(full, self._parent[0][l], l), np.where(full, self._parent[1][h - 1], h), s - full
            todo = np.flatnonzero(c > 0)
            out = c == 0
            l[out], h[out], s[out] = 0, self.n, 0
            while len(todo):
                cc = c[todo]
                both = self.tree.rank(np.concatenate([cc, cc]), np.concatenate([l[todo], h[todo]]))
                nl, nh = self.first[cc] + both[: len(cc)], self.first[cc] + both[len(cc) :]
                ok = nh > nl
                done, todo = todo[ok], todo[~ok]
                l[done], h[done] = nl[ok], nh[ok]
                s[done] += 1
                if len(todo):
                    a, b = l[todo], h[todo]
                    shorter = np.maximum(self.lcp[a], np.where(b < self.n, self.lcp[np.minimum(b, self.n - 1)], 0)).astype(np.int64)
                    shorter = np.minimum(shorter, s[todo] - 1)
                    l[todo], h[todo] = self._widen(a, b, shorter)
                    s[todo] = shorter
                    gone = shorter <= 0
                    l[todo[gone]], h[todo[gone]], s[todo[gone]] = 0, self.n, 0
            lo[:n], hi[:n], size[:n] = l, h, s
            length[at] = s
            whole = s == self.threshold
            owner[at[whole]] = self.least[self.group[l[whole]]]
        return length, owner
