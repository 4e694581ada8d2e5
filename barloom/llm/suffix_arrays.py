"""Suffix arrays in numpy, for buffers of a few megabytes.

Order: positions are first sorted by their leading eight bytes; then, as Larsson and Sadakane do,
only groups that are still tied are sorted again by the rank of the position as many bytes further,
which doubles the compared length each time; a group's rank is the place of its first member.
Common prefixes: Kasai's method, which carries a length less one from each position to the next,
run over many stretches of the text at once.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros past the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: len(text)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, compared over `depth` bytes at least."""
    n = len(text)
    word = eight_bytes(text)
    order = np.argsort(word).astype(np.int32)
    sorted_words = word[order]
    places = np.arange(n, dtype=np.int32)
    first = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    del word, sorted_words
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0)) + 1
    rank[n] = 0
    h = 8
    while h < depth:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        own = order[tied]
        key = rank[own].astype(np.int64) * (n + 2) + rank[np.minimum(own + h, n)]
        again = np.argsort(key)
        own, key = own[again], key[again]
        order[tied] = own
        first[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(first[tied], tied, 0)) + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, stretch: int = 64) -> np.ndarray:
    """For each place in the order, the bytes shared with the place before, up to `most`.

    A length that reached `most` says nothing about the next position, as the order is only known to
    hold that far; such a position is compared from its start, by eight bytes at a time.
    """
    n = len(text)
    padded, word = np.concatenate([text, np.zeros(most + 9, np.uint8)]), np.concatenate([eight_bytes(text), np.zeros(most + 9, np.uint64)])
    before = np.empty(n, np.int32)
    before[order[1:]], before[order[0]] = order[:-1], -1
    out = np.zeros(n, np.int16)
    lanes = np.arange(0, n, stretch)
    h = np.zeros(len(lanes), np.int64)
    for t in range(min(stretch, n)):
        at = lanes + t
        if at[-1] >= n:
            lanes, at, h = lanes[:-1], at[:-1], h[:-1]
        j = before[at]
        h = np.where((j >= 0) & (h < most), np.maximum(h - 1, 0), 0)
        for step, equal in ((8, word), (1, padded)):
            going = np.flatnonzero(j >= 0)
            while len(going):
                a, b, g = at[going], j[going], h[going]
                going = going[(g + step <= most) & (np.maximum(a, b) + g + step <= n) & (equal[a + g] == equal[b + g])]
                h[going] += step
        out[at] = h
    return out[order]
