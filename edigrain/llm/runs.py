"""Runs of windows, the candidates of both substring-dedup operators.

Every window of `width` symbols picks the least hash among its grams of `gram`
symbols (the leftmost on ties). Equal windows pick the same place, so windows
can only be equal if the hashes they picked, their anchors, are. Consecutive
windows that pick the same place form a run, and a run is known by its anchor
and a fingerprint of all its symbols: two equal runs hold equal windows
throughout, and only runs whose anchor occurs in different runs need their
single windows compared. One run stands for about half of width - gram windows.
"""

from __future__ import annotations

import numpy as np

from .common import RollingHash, mix64, window_argmin

BASE = 0xD1342543DE82EF95


class Prints:
    """Fingerprints of windows of several documents, whose symbols follow each
    other in one array."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, width: int):
        self.width = width
        self.offset = np.cumsum(sizes) - sizes
        self.rolling = RollingHash(symbols, BASE)

    def windows(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, fingerprints) of all windows of the given runs."""
        at = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return at, self.rolling.at(at, self.width)


class Runs:
    """Runs: start (in the array), count (of windows), doc, anchor and print, in
    text order. Symbols are hashed in slices of about `most`, documents whole;
    `letters` maps small symbols to their 64-bit hashes."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, width: int, gram: int, letters: np.ndarray | None = None, most: int = 1 << 16):
        self.symbols, self.width, self.letters = symbols, width, letters
        self.offset = np.cumsum(sizes) - sizes
        new = np.ones(len(sizes), dtype=bool)
        new[1:] = np.diff(self.offset // most) > 0
        lead = np.flatnonzero(new).tolist()
        self.edges = np.append(self.offset[lead], len(symbols)).astype(np.int64)
        none = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
        own = [self._slice(a, sizes[a:b], gram) for a, b in zip(lead, [*lead[1:], len(sizes)])]
        self.start, self.count, self.doc, self.anchor, self.print = (np.concatenate(x) for x in zip(none, *own))

    def _rolling(self, first: int, end: int) -> RollingHash:
        own = self.symbols[first:end]
        return RollingHash(own if self.letters is None else self.letters[own], BASE)

    def _slice(self, first: int, sizes: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
        base, width = int(self.offset[first]), self.width
        rolling = self._rolling(base, base + int(sizes.sum()))
        each = np.maximum(sizes - width + 1, 0)  # windows of each document
        if not each.any():
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
        grams = rolling.windows(gram)
        least = window_argmin(grams, width - gram + 1)
        doc = np.repeat(np.arange(len(sizes)), each)
        at = np.arange(len(doc)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(each) - each), each)
        place = least[at]
        lead = np.ones(len(at), dtype=bool)
        lead[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        at_first = np.flatnonzero(lead)
        start, count = at[at_first], np.diff(np.append(at_first, len(at)))
        return start + base, count, doc[at_first] + first, grams[place[at_first]], mix64(rolling.at(start, count + width - 1) + count.astype(np.uint64))

    def windows(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, fingerprints) of all windows of the given runs, in text order."""
        at = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        cuts = np.searchsorted(at, self.edges)
        out = [np.zeros(0, dtype=np.uint64)]
        for first, end, a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                out.append(self._rolling(first, end).at(at[a:b] - first, self.width))
        return at, np.concatenate(out)


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of one row of each distinct key, in input order within a key
    the first; how many rows have it)."""
    order = np.lexsort(keys[::-1])
    lead = np.ones(len(order), dtype=bool)
    if len(order):
        lead[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    at = np.flatnonzero(lead)
    return order[at], np.diff(np.append(at, len(order)))
