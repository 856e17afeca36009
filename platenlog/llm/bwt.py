"""Repeated strings of one length in a few megabytes of text, by a Burrows-Wheeler transform.

Suffixes are sorted deep enough to tell strings of that length apart. Then common
prefix lengths come out in increasing order: an interval of suffixes that start
with some string is extended backwards by every symbol before it, all intervals of a length
at once, and an extension whose right border is new has found the length of the
common prefix there. The search starts from all strings of ``PACK`` symbols and stops at the
length wanted; borders not found until then lie between suffixes that share as much.
"""

from __future__ import annotations

import numpy as np

# Symbols of 9 bits that fit a sort key.
PACK = 7
SEPARATOR = 0


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers in order of their first ``depth`` symbols, and whether each differs within PACK from the one before."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(PACK, dtype=np.int64)))
    for k in range(PACK):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.empty(n, dtype=bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = new.copy()
    rank = np.empty(n, dtype=np.int64)
    have = PACK
    while have < depth and not new.all():
        # The rank of a suffix is where its group starts; groups of one are final.
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts, sizes)
        places = np.nonzero(np.repeat(sizes > 1, sizes))[0]
        own = order[places]
        behind = own + have
        after = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = rank[own] * np.int64(n + 1) + after
        inner = np.argsort(by, kind="stable")
        order[places] = own[inner]
        by = by[inner]
        new[places[1:]] |= by[1:] != by[:-1]
        have *= 2
    return order, first


def shared_prefix_groups(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and a mark on each suffix that does not share ``length`` symbols with the one before.

    Marks next to suffixes with a separator among their first ``length`` symbols may be missing
    between two such suffixes, never next to one without.
    """
    n = len(symbols)
    order, known = sorted_suffixes(symbols, length)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    known = np.append(known, True)
    left = np.nonzero(known[:-1])[0]
    right = np.append(left[1:], n) - 1
    for _ in range(PACK, length):
        if not len(left):
            break
        sizes = right - left + 1
        owner = np.repeat(np.arange(len(left)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[owner]
        symbol = before[inside]
        wanted = symbol != SEPARATOR
        place, owner, symbol = step[inside[wanted]], owner[wanted], symbol[wanted]
        sort = np.argsort(place)
        place, owner, symbol = place[sort], owner[sort], symbol[sort]
        if not len(place):
            break
        cut = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        left = place[np.concatenate(([True], cut))]
        right = place[np.concatenate((cut, [True]))]
        found = ~known[right + 1]
        left, right = left[found], right[found]
        known[right + 1] = True
    return order, known[:-1]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its ``length``-byte strings that start elsewhere too, in any text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # A separator before each text and one at the end; bytes are 1 to 256.
    at = np.cumsum(sizes + 1) - sizes
    symbols = np.full(int(sizes.sum()) + len(texts) + 1, SEPARATOR, dtype=np.uint16)
    inside = np.ones(len(symbols), dtype=bool)
    inside[np.append(at - 1, len(symbols) - 1)] = False
    symbols[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint16) + 1
    order, marks = shared_prefix_groups(symbols, length)
    last = np.append(marks[1:], True)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[order] = ~(marks & last)
    out = []
    for start, size in zip(at, sizes, strict=True):
        out.append(np.nonzero(repeated[start : start + max(0, size - length + 1)])[0])
    return out
