"""Comparing many 64-bit fingerprints at once, with their bits stored vertically.

Lane i of a block is one comparison.  Plane b holds bit b of all lanes, 64 lanes to a word, so one
word operation serves 64 distances.  Distances grow in carry-save counters, which are planes too:
adding a plane of differing bits is a ripple of XOR and AND over all lanes.  Words all of whose
lanes have passed the radius are abandoned; mostly a quarter of the planes settles a block.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64
#: Planes between two looks at which words may be abandoned.
STRIDE = 8


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64, words): bit planes of uint64 values; lanes past the end are 0."""
    lanes = -(-len(values) // WIDTH) * WIDTH
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes_of(words: np.ndarray, lanes: int) -> np.ndarray:
    """Which of the lanes are set, as a boolean array."""
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:lanes].astype(bool)


class Counters:
    """Vertical counters up to ``radius``, of any shape of words, with a sticky plane of those beyond."""

    def __init__(self, beyond: np.ndarray, radius: int):
        self.radius = radius
        self.beyond = beyond
        self.planes = [np.zeros_like(beyond) for _ in range(max(1, radius.bit_length()))]

    def add(self, differing: np.ndarray) -> None:
        carry = differing
        for k, plane in enumerate(self.planes):
            self.planes[k], carry = plane ^ carry, plane & carry
        self.beyond = self.beyond | carry

    def passed(self) -> np.ndarray:
        """Lanes whose count is over the radius, compared from the highest counter plane down."""
        over, equal = np.zeros_like(self.beyond), ~np.zeros_like(self.beyond)
        for k in reversed(range(len(self.planes))):
            if self.radius >> k & 1:
                equal = equal & self.planes[k]
            else:
                over |= equal & self.planes[k]
                equal = equal & ~self.planes[k]
        return over | self.beyond

    def narrow(self, keep) -> None:
        self.beyond = self.beyond[keep]
        self.planes = [p[keep] for p in self.planes]


def near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """For each i, whether left[i] and right[i] differ in at most ``radius`` bits."""
    planes = planes_of(left ^ right)
    alive = np.arange(planes.shape[1])
    counters = Counters(np.zeros(planes.shape[1], np.uint64), radius)
    for b in range(WIDTH):
        counters.add(planes[b, alive])
        if b % STRIDE == STRIDE - 1:
            keep = np.flatnonzero(~counters.passed())
            if len(keep) < len(alive):
                counters.narrow(keep)
                alive = alive[keep]
            if not len(alive):
                break
    found = np.zeros(planes.shape[1], np.uint64)
    found[alive] = ~counters.passed()
    return lanes_of(found, len(left))


def near_pairs(values: np.ndarray, radius: int, queries: int = 256):
    """Yields (i, j) index arrays, i < j, of all pairs of ``values`` within the radius.

    One plane set serves all; ``queries`` values at a time meet every lane after them."""
    planes, n = planes_of(values), len(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    masks = (np.uint64(0) - bits.astype(np.uint64)).reshape(n, WIDTH)
    for start in range(0, n, queries):
        rows = np.arange(start, min(n, start + queries))
        first = start // WIDTH
        block, columns = planes[:, first:], np.arange(planes.shape[1] - first)
        lane = np.arange(first * WIDTH, planes.shape[1] * WIDTH)
        outside = (lane[None, :] <= rows[:, None]) | (lane[None, :] >= n)
        counters = Counters(np.ascontiguousarray(np.packbits(outside, axis=1, bitorder="little")).view(np.uint64), radius)
        for b in range(WIDTH):
            counters.add(block[b, columns][None, :] ^ masks[rows, b][:, None])
            if b % STRIDE == STRIDE - 1:
                alive = ~counters.passed()
                keep, words = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                if len(keep) < len(rows) or len(words) < len(columns):
                    counters.narrow(np.ix_(keep, words))
                    rows, columns = rows[keep], columns[words]
                if not len(rows):
                    break
        if len(rows):
            alive = ~counters.passed()
            at, word = np.nonzero(alive)
            set_bits = np.unpackbits(alive[at, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(set_bits)
            yield rows[at[which]], (first + columns[word[which]]) * WIDTH + bit


def lowest_labels(n: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links left[i]-right[i]."""
    labels = np.arange(n) if labels is None else labels
    while len(left):
        low = np.minimum(labels[left], labels[right])
        new = labels.copy()
        np.minimum.at(new, labels[left], low)
        np.minimum.at(new, labels[right], low)
        new = new[new]
        if np.array_equal(new, labels):
            break
        labels = new
    return labels
