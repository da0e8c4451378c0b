"""A bidirectional FM-index over a delimited vocabulary, and the search for words at one edit.

The text is 0 w1 0 w2 0 ... wn 0 and an end that is larger than all symbols, with the words in ascending
order, so the suffixes that begin with a delimiter and a word stand in the order of the words: the rank
of such a suffix is its word's place. A string is a pair of intervals of equal size, one of suffix ranks of the text and one of its reverse,
and is extended to either side by one symbol. All queries are extended together, symbol by symbol.
"""

from __future__ import annotations

import numpy as np

from .backward_search import suffix_order


class Ranks:
    """How many of the first i symbols of a transform are smaller than c, for all c: one bit vector for
    each symbol, with counts at every 64 bits."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        n = len(bwt)
        self.bits = np.zeros((sigma + 1, n // 64 + 1), np.uint64)
        self.before = np.zeros((sigma + 1, n // 64 + 1), np.int32)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        for c in range(1, sigma + 1):
            padded[:n] = bwt < c
            self.bits[c] = np.packbits(padded, bitorder="little").view("<u8")
            np.cumsum(np.bitwise_count(self.bits[c][:-1]), out=self.before[c, 1:])
        self.starts = np.array([np.count_nonzero(bwt < c) for c in range(sigma + 1)], np.int64)

    def smaller(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        inside = self.bits[c, at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[c, at] + np.bitwise_count(inside).astype(np.int64)


class BidirectionalIndex:
    """Intervals are arrays low (ranks of the text's suffixes), back (of the reverse text's) and size."""

    def __init__(self, words: list[str]):
        """words: distinct, ascending."""
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), "<u4")
        self.symbols, text = np.unique(points, return_inverse=True)
        self.sigma, self.words = len(self.symbols), len(words)
        if self.sigma > 255:
            raise ValueError("the alphabet has more than 254 characters")
        self.size = len(text) + 1
        self.ranks = [Ranks(self._transform(t.astype(np.uint8)), self.sigma + 1) for t in (text, text[::-1])]

    def _transform(self, text: np.ndarray) -> np.ndarray:
        """The symbol before each suffix in their order; before the whole text stands its end."""
        ended = np.append(text, np.uint8(self.sigma))
        return ended[suffix_order(ended) - 1]

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a string; -1 where no word has the character."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.symbols, points), self.sigma - 1)
        return np.where(self.symbols[at] == points, at, -1).astype(np.int16)

    def everything(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    def extend(self, to_right: bool, low, back, size, c):
        """The intervals of the strings extended by one symbol each (c: array). Size may be 0."""
        ranks = self.ranks[int(to_right)]
        near, far = (back, low) if to_right else (low, back)
        c = np.maximum(c, 0) if (known := c >= 0).all() else np.where(known, c, 0)
        a0, a1 = ranks.smaller(c, near), ranks.smaller(c + 1, near)
        b0, b1 = ranks.smaller(c, near + size), ranks.smaller(c + 1, near + size)
        new_near = ranks.starts[c] + a1 - a0
        new_far = far + b0 - a0
        new_size = np.where(known, (b1 - b0) - (a1 - a0), 0)
        return (new_far, new_near, new_size) if to_right else (new_near, new_far, new_size)

    def branch(self, to_right: bool, low, back, size):
        """All extensions by a character that occur: which string, symbol, and its intervals."""
        n = len(low)
        which = np.repeat(np.arange(n), self.sigma - 1)
        c = np.tile(np.arange(1, self.sigma), n)
        low, back, size = self.extend(to_right, low[which], back[which], size[which], c)
        some = size > 0
        return which[some], c[some], low[some], back[some], size[some]

    def near(self, queries: list[str], prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query and word places of all words that lie one edit from a query, the edit being behind its
        first `prefix` and before its last `suffix` code points. The longer of the two is matched first,
        exactly, with its delimiter; the search then goes on to the other side and allows one error there."""
        found = [self._search(right, queries, prefix, suffix, np.flatnonzero((prefix >= suffix) == right)) for right in (True, False)]
        pairs = np.unique(np.concatenate([q * self.words + w for q, w in found])) if self.words else np.zeros(0, np.int64)
        return (pairs // self.words, pairs % self.words) if self.words else (pairs, pairs)

    def _search(self, right: bool, queries, prefix, suffix, chosen) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(chosen):
            return none
        # the query as it is read: first the exact end, then towards the other one, which a delimiter closes
        read = [self.codes(queries[q] if right else queries[q][::-1]) for q in chosen]
        length = np.array([len(x) for x in read])
        exact = (prefix if right else suffix)[chosen]
        last = length - (suffix if right else prefix)[chosen]  # from here on, no error begins
        symbols = np.full((len(read), length.max() + 1), 0, np.int16)
        for i, x in enumerate(read):
            symbols[i, : len(x)] = x
        # the exact end is matched from inside outwards, its delimiter last; then the direction turns
        q = np.arange(len(read))
        low, back, size = self.everything(len(read))
        for step in range(int(exact.max()) + 1):
            on = np.flatnonzero((size > 0) & (step <= exact[q]))
            c = np.where(step < exact[q[on]], symbols[q[on], np.maximum(exact[q[on]] - 1 - step, 0)], 0)
            low[on], back[on], size[on] = self.extend(not right, low[on], back[on], size[on], c)
        on = size > 0
        q, at, errors = q[on], exact[q[on]].copy(), np.zeros(on.sum(), np.int64)
        low, back, size = low[on], back[on], size[on]
        hits = []
        while len(q):
            closed = (at == length[q]) & (errors == 1)
            if closed.any():
                l, b, s = self.extend(right, low[closed], back[closed], size[closed], np.zeros(closed.sum(), np.int64))
                hits.append((q[closed][s > 0], l[s > 0]))
            open_ = np.flatnonzero((at < length[q]))
            fresh = np.flatnonzero((errors == 0) & (at <= last[q]))
            # exact steps
            l, b, s = self.extend(right, low[open_], back[open_], size[open_], symbols[q[open_], at[open_]].astype(np.int64))
            some = s > 0
            nexts = [(q[open_][some], at[open_][some] + 1, errors[open_][some], l[some], b[some], s[some])]
            # one error: another symbol, a symbol more, a symbol less
            which, c, l, b, s = self.branch(right, low[fresh], back[fresh], size[fresh])
            which = fresh[which]
            nexts.append((q[which], at[which], np.ones(len(which), np.int64), l, b, s))
            other = (at[which] < last[q[which]]) & (c != symbols[q[which], at[which]])
            w = which[other]
            nexts.append((q[w], at[w] + 1, np.ones(len(w), np.int64), l[other], b[other], s[other]))
            w = fresh[at[fresh] < last[q[fresh]]]
            nexts.append((q[w], at[w] + 1, np.ones(len(w), np.int64), low[w], back[w], size[w]))
            q, at, errors, low, back, size = (np.concatenate(x) for x in zip(*nexts))
        if not hits:
            return none
        q, l = (np.concatenate(x) for x in zip(*hits))
        return chosen[q], l  # a whole word between delimiters is one suffix
