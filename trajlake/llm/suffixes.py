"""A suffix-rank index over a delimited vocabulary, searched for many patterns at once.

The index is one half of a bidirectional pair: built over words as they are, it extends matches to the left; built
over the words' mirror images, it extends them to the right.  All patterns of a batch advance together, so every
step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np

BATCH = 20_000


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by ranks of prefixes that double in length."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - reach)] = rank[reach:] + 1
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        reach *= 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Suffixes:
    """Suffix ranks of ``words``, each between delimiters (symbol 0)."""

    def __init__(self, words: list[str]):
        joined = _codes("\0" + "\0".join(words) + "\0")
        self.alphabet, text = np.unique(joined, return_inverse=True)
        self.order = suffix_order(text)
        before = text[self.order - 1]
        self.seen = np.zeros((len(text) + 1, len(self.alphabet)), np.int32)
        self.seen[np.arange(1, len(text) + 1), before] = 1
        np.cumsum(self.seen, axis=0, out=self.seen)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet)))[:-1]))
        self.word_at = np.cumsum(joined == 0) - 1  # at a delimiter: the word that follows it

    def _extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes that put ``symbol`` before those of [lo, hi)."""
        return self.first[symbol] + self.seen[lo, symbol], self.first[symbol] + self.seen[hi, symbol]

    def one_error(self, patterns: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) positions of words exactly one inserted, deleted or replaced code point away from a pattern
        whose last ``exact`` code points they end in; each pair once."""
        found = [self._batch(patterns[i : i + BATCH], exact[i : i + BATCH], i) for i in range(0, len(patterns), BATCH)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _batch(self, patterns: list[str], exact: list[int], offset: int) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(p) for p in patterns], np.int64)
        exact = np.array(exact, np.int64)
        raw = _codes("".join(patterns))
        symbols = np.searchsorted(self.alphabet, raw).clip(max=len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[symbols] == raw, symbols, -1)
        last = np.cumsum(length) - 1
        pairs = []
        # A state is (pattern, lo, hi); clean states have spent no error, spent states exactly one.
        clean = (np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.seen[-1, 0], np.int64))
        spent = tuple(np.zeros(0, np.int64) for _ in range(3))
        for done in range(int(length.max()) + 1):
            q, lo, hi = clean
            free = exact[q] <= done
            after = []
            if free.any():
                p, a, b = q[free], lo[free], hi[free]
                row, sym = np.nonzero(self.seen[b, 1:] > self.seen[a, 1:])
                sym += 1
                x, y = self._extend(a[row], b[row], sym)
                spent = tuple(np.concatenate(z) for z in zip(spent, (p[row], x, y), strict=True))  # a symbol more than the pattern
                more = length[p] > done
                here = np.where(more, symbols[np.where(more, last[p] - done, 0)], 0)
                other = more[row] & (sym != here[row])
                after = [(p[row][other], x[other], y[other]), (p[more], a[more], b[more])]  # another symbol, a symbol less
            whole = length[spent[0]] == done
            if whole.any():
                p, a, b = (z[whole] for z in spent)
                a, b = self._extend(a, b, np.zeros(len(a), np.int64))
                hit = b > a
                pairs.append(np.stack([p[hit], self.word_at[self.order[a[hit]]]]))
            clean, spent = (self._advance(s, done, length, last, symbols) for s in (clean, spent))
            spent = tuple(np.concatenate(z) for z in zip(spent, *after, strict=True))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unique = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return unique[0] + offset, unique[1]

    def _advance(self, states, done, length, last, symbols):
        q, lo, hi = states
        go = length[q] > done
        q, lo, hi = q[go], lo[go], hi[go]
        here = symbols[last[q] - done]
        known = here >= 0
        q, (lo, hi) = q[known], self._extend(lo[known], hi[known], here[known])
        alive = hi > lo
        return q[alive], lo[alive], hi[alive]
