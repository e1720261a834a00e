"""Suffix arrays by induced sorting, with arrays for queues."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (values 1 to 255) by induced sorting.

    Suffixes that are smaller than both neighbours (the sampled ones) are sorted by their pieces, named, and
    the string of names is sorted in turn; all other suffixes follow by induction: one bucket queue a letter
    yields the suffixes in order, and each entry puts the suffix one place before it into the queue of its letter.
    """
    t = np.append(text, np.uint8(0)).astype(np.uint8)
    n = t.size
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    smaller = _smaller_than_next(t)
    sampled = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = _induced(t, smaller, sampled)
    chosen = np.zeros(n, dtype=bool)
    chosen[sampled] = True
    order = rough[chosen[rough]]
    names = _named(t, sampled, order)
    if names.max() + 1 < names.size:
        order = sampled[_sorted_by_doubling(names)]
    return _induced(t, smaller, order)[1:]


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it."""
    turn = np.flatnonzero(t[1:] != t[:-1])  # the last of each run of one letter
    out = np.ones(t.size, dtype=bool)
    out[:-1] = np.repeat(t[turn] < t[turn + 1], np.diff(turn, prepend=-1))
    return out


def _induced(t: np.ndarray, smaller: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the sampled ones in order."""
    letters = np.unique(t).tolist()
    by_letter = {c: x for c, x in _split(t, sampled)}
    queue: dict[int, list[np.ndarray]] = {c: [] for c in letters}
    larger: dict[int, np.ndarray] = {}
    for c in letters:  # suffixes larger than their next, ascending
        waves = []
        wave = np.concatenate(queue[c]) if queue[c] else np.zeros(0, dtype=np.int64)
        while wave.size:
            waves.append(wave)
            wave = _push(t, ~smaller, wave, c, queue)
        larger[c] = np.concatenate(waves) if waves else wave
        if c in by_letter:
            _push(t, ~smaller, by_letter[c], c, queue)
    queue = {c: [] for c in letters}
    parts: list[np.ndarray] = []
    for c in reversed(letters):  # suffixes smaller than their next, descending
        waves = []
        wave = np.concatenate(queue[c]) if queue[c] else np.zeros(0, dtype=np.int64)
        while wave.size:
            waves.append(wave)
            wave = _push(t, smaller, wave, c, queue)
        if c == 0:
            waves = [np.array([t.size - 1])]
        own = larger[c][::-1]
        _push(t, smaller, own, c, queue)
        parts += [*waves, own]
    return np.concatenate(parts)[::-1]


def _push(t: np.ndarray, wanted: np.ndarray, wave: np.ndarray, c: int, queue: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Put the suffixes before those of ``wave`` into their queues; those of the same letter are returned."""
    before = wave[wave > 0] - 1
    before = before[wanted[before]]
    same = before[:0]
    for letter, x in _split(t, before):
        if letter == c:
            same = x
        else:
            queue[letter].append(x)
    return same


def _split(t: np.ndarray, places: np.ndarray):
    """Places by their letter, each in the given order."""
    if not places.size:
        return
    letter = t[places]
    order = np.argsort(letter, kind="stable")
    places, letter = places[order], letter[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(letter)) + 1, [letter.size]))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(letter[start]), places[start:end]


def _named(t: np.ndarray, sampled: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the sampled suffixes' pieces in text order; equal pieces (up to the next sampled place) share one."""
    ends = np.append(sampled[1:], t.size - 1)
    place = np.searchsorted(sampled, order)
    length = ends[place] - order + 1
    changed = np.ones(order.size, dtype=bool)
    changed[1:] = length[1:] != length[:-1]
    open_ = np.flatnonzero(~changed)
    step = 0
    while open_.size:  # pieces of equal length, compared letter by letter until they differ or end
        a, b = order[open_ - 1] + step, order[open_] + step
        differ = t[a] != t[b]
        changed[open_[differ]] = True
        step += 1
        open_ = open_[~differ & (length[open_] > step)]
    out = np.empty(order.size, dtype=np.int64)
    out[place] = np.cumsum(changed) - 1
    return out


def _sorted_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    rank, width = names + 1, 1
    while True:
        second = np.zeros_like(rank)
        second[:-width] = rank[width:]
        key = rank * (rank.size + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty_like(rank)
        fresh[order] = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))))
        rank = fresh
        if rank[order[-1]] == rank.size or width >= rank.size:
            return order
        width *= 2
