"""Suffix sorting with the difference cover {1, 2} modulo 3, on numpy arrays inside a task."""

from __future__ import annotations

import numpy as np


def _names(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Names 1..k of the triples, in their sorted order."""
    top = int(max(first.max(initial=0), second.max(initial=0), third.max(initial=0))) + 1
    if top**3 < 1 << 62:
        return np.unique((first * top + second) * top + third, return_inverse=True)[1] + 1
    pair = np.unique(first * top + second, return_inverse=True)[1]
    return np.unique(pair * top + third, return_inverse=True)[1] + 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``symbols`` (int64, all above 0), sorted; the end counts as the least symbol."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols, np.zeros(3, np.int64)])
    # 1. sort and name the sampled triples; a dummy sample ends the first half when n % 3 == 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _names(s[sample], s[sample + 1], s[sample + 2])
    # 2. recurse on the names unless they are all different
    if names.max() < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sampled = sample[np.argsort(names)]
    sampled = sampled[sampled < n]
    # 3. the remaining suffixes by first symbol and the rank of the next
    width = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] * width + rank[rest + 1], kind="stable")]
    # 4. merge by counting: against class 1 by (symbol, rank), against class 2 by (symbol, symbol, rank)
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    top = int(s.max()) + 1
    pairs = np.unique(np.concatenate([s[rest] * top + s[rest + 1], s[twos] * top + s[twos + 1]]), return_inverse=True)[1]
    before = np.searchsorted(s[ones] * width + rank[ones + 1], s[rest] * width + rank[rest + 1])
    before += np.searchsorted(pairs[len(rest) :] * width + rank[twos + 2], pairs[: len(rest)] * width + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def least_owner(texts: np.ndarray, offsets: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, window start, least owner) of every window of ``length`` bytes of the texts.

    The windows are compared along the suffix array: neighbours with equal prefixes form a run."""
    sizes = np.diff(offsets)
    number = np.repeat(np.arange(len(sizes)), sizes)
    # one end symbol after every text
    symbols = np.ones(len(texts) + len(sizes), np.int64)
    place = np.arange(len(texts)) + number
    symbols[place] = texts.astype(np.int64) + 2
    of = np.full(len(symbols), -1)
    of[place] = number
    left = np.zeros(len(symbols), np.int64)  # bytes up to the end of the text
    left[place] = offsets[1:][number] - np.arange(len(texts))
    order = suffix_array(symbols)
    order = order[left[order] >= length]
    if not len(order):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    new = np.ones(len(order), bool)
    step = max(1, (4 << 20) // length)
    reach = np.arange(length)
    for i in range(1, len(order), step):
        j = min(len(order), i + step)
        new[i:j] = (symbols[order[i - 1 : j - 1, None] + reach] != symbols[order[i:j, None] + reach]).any(1)
    run = np.cumsum(new) - 1
    text = of[order]
    least = np.minimum.reduceat(owners[text], np.flatnonzero(new))[run]
    return text, order - (offsets[:-1][text] + text), least
