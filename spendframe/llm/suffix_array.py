"""Suffix arrays in NumPy: Larsson-Sadakane refinement, Kasai's common prefixes, search in another array.

Texts are byte arrays in which SEPARATOR, a byte no UTF-8 text holds, ends every piece; ``DEPTH``
bytes of it must follow the last piece.  The order is complete; common prefixes count to DEPTH bytes.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF
DEPTH = 256


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, the first one highest."""
    word = text.astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    return word


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of the texts that start there.

    The first eight bytes give the first ranks.  Then only positions whose rank is shared are sorted
    again, by the rank of the position ``done`` bytes on, which doubles the bytes their ranks tell apart."""
    n = len(text) - DEPTH
    word = _words(text)[:n]
    order = np.argsort(word, kind="stable")
    rank = np.arange(len(text))  # in the padding, a later place counts as higher; so does whatever lies beyond

    def grade(places: np.ndarray, fresh: np.ndarray, low: np.ndarray) -> None:
        """Each place's rank becomes that of the first of its equals."""
        rank[places] = low[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]

    sorted_word = word[order]
    fresh = np.concatenate([[True], sorted_word[1:] != sorted_word[:-1]]) if n else np.zeros(0, bool)
    grade(order, fresh, np.arange(n))
    done, at = 8, np.arange(n)
    while n:
        shared = ~(fresh & np.concatenate([fresh[1:], [True]]))
        at = at[shared]
        if not len(at):
            break
        places = order[at]
        ahead = places + done
        first = rank[places]
        second = np.where(ahead < len(text), rank[np.minimum(ahead, len(text) - 1)], ahead)
        sort = np.argsort(first * (2 * len(text) + 1) + second, kind="stable")
        places, first, second = places[sort], first[sort], second[sort]
        order[at] = places
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        grade(places, fresh, at)
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """common[k]: bytes that suffixes order[k - 1] and order[k] share, DEPTH at most; common[0] is 0.

    Kasai's rule (the next position shares one byte less at least) runs down ``lanes`` stretches of
    the text at once; prefixes grow by eight bytes while they can, then by one."""
    n, word = len(order), _words(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    stretch = -(-n // lanes)
    length, found = np.zeros(lanes, np.int64), np.zeros(n, np.int64)
    starts = np.arange(lanes) * stretch
    for step in range(stretch):
        own = starts + step
        live = np.flatnonzero(own < n)
        place, other = own[live], before[own[live]]
        size = np.where(other >= 0, np.maximum(length[live] - 1, 0), 0)
        present = np.flatnonzero(other >= 0)
        for step_size, data in ((8, word), (1, text)):
            going = present[size[present] <= DEPTH - step_size]
            while len(going):
                done = size[going]
                going = going[data[place[going] + done] == data[other[going] + done]]
                size[going] += step_size
                going = going[size[going] <= DEPTH - step_size]
        length[live] = size
        found[place] = size
    common = found[order]
    if n:
        common[0] = 0
    return common


def locate(text: np.ndarray, order: np.ndarray, other: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """For each window other[p : p + width], the index in ``order`` of an equal window of ``text``, or -1; binary search."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(order))
    span = np.arange(width)
    wanted = other[places[:, None] + span]
    padded = np.concatenate([text, np.full(width, SEPARATOR, np.uint8)])
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        windows = padded[order[middle][:, None] + span]
        differ = windows != wanted[open_]
        first = differ.argmax(axis=1)
        row = np.arange(len(open_))
        less = differ[row, first] & (windows[row, first] < wanted[open_][row, first])
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    at = np.minimum(low, len(order) - 1)
    equal = (low < len(order)) & (padded[order[at][:, None] + span] == wanted).all(axis=1) if len(order) else np.zeros(len(places), bool)
    return np.where(equal, low, -1)
