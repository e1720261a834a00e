"""Minimal acyclic transducers over sorted terms: every term leads to its lexicographic ordinal.

The automaton is built from the sorted terms one by one; states whose futures agree are merged as soon as they are
complete, so that it is minimal at every moment. Each transition puts out the number of terms that
sort before all those behind it; along a term the outputs add up to its ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 1 << 22  # bytes of text run through the automata at a time

# Terms are runs of ASCII letters and of bytes beyond ASCII, the latter as they are. Other bytes fold to 0.
FOLD = np.zeros(256, np.uint8)
FOLD[ord("a"):ord("z") + 1] = FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def minimal(terms: Iterable[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States ``(final, ((byte, state), ..))`` of the minimal automaton of strictly ascending ``terms``; the last is its root."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    path: list[list] = [[False, []]]  # states along the last term, still open
    last = b""

    def complete(depth: int) -> None:
        while len(path) > depth:
            final, edges = path.pop()
            state = (final, tuple(edges))
            number = register.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            if path:
                path[-1][1].append((last[len(path) - 1], number))

    for term in terms:
        shared = 0
        for a, b in zip(last, term):
            if a != b:
                break
            shared += 1
        if term <= last:
            raise ValueError("terms must be ascending and not empty")
        complete(shared + 1)
        path.extend([False, []] for _ in range(len(term) - shared))
        path[-1][0] = True
        last = term
    complete(1)
    states.append((path[0][0], tuple(path[0][1])))  # the root is kept apart, also where it equals another state
    return states


@dataclass
class Transducer:
    """Transitions in one table: state ``s`` under byte ``b`` owns place ``s + b`` if ``check`` says so."""

    root: int
    check: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.check.nbytes + self.target.nbytes + self.output.nbytes + self.final.nbytes


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of ascending ``terms``, its transitions laid into the gaps of one table."""
    states = minimal(terms)
    words = [0] * len(states)
    for i, (final, edges) in enumerate(states):  # targets come before their sources
        words[i] = final + sum(words[t] for _, t in edges)
    place = _places(states)
    size = max(place) + 257
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    output, ends = np.zeros(size, np.int32), np.zeros(size, np.uint8)
    for at, (final, edges) in zip(place, states):
        ends[at] = final
        before = int(final)
        for byte, t in edges:
            check[at + byte], target[at + byte], output[at + byte] = at, place[t], before
            before += words[t]
    return Transducer(place[-1], check, target, output, ends)


def _places(states: list[tuple]) -> list[int]:
    """A place of its own for each state so that no two transitions meet: the first that fits, states with most transitions first."""
    place, homes = [0] * len(states), set()
    used = bytearray(1024)
    low = 0
    for i in sorted(range(len(states)), key=lambda i: -len(states[i][1])):
        edges = states[i][1]
        if not edges:
            at = 0
            while at in homes:
                at += 1
        else:
            first, at, slot, tries = edges[0][0], None, low, 0
            while at is None:
                slot = used.find(0, slot)
                if slot < 0 or slot + 256 >= len(used):
                    used.extend(bytes(len(used)))
                    slot = max(slot, 0)
                    slot = used.find(0, slot)
                start = slot - first
                if start >= 0 and start not in homes and not any(used[start + b] for b, _ in edges[1:]):
                    at = start
                else:
                    slot += 1
                    tries += 1
                    if tries == 256:  # a full stretch: later states begin beyond it
                        low = max(low, slot - 128)
            for b, _ in edges:
                used[at + b] = 1
        homes.add(at)
        place[i] = at
    return place


class Vocabulary:
    """Transducers of several sets (languages), each cut into shards by first term, side by side in one table.

    ``shards`` gives ``(set, first term, ordinal of the first term, transducer)`` in ascending order within each set.
    """

    def __init__(self, shards: Iterable[tuple[str, bytes, int, Transducer]]):
        shards, self.sets, offset = list(shards), {}, 0
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for name, first, start, t in shards:
            firsts, roots, starts = self.sets.setdefault(name, ([], [], []))
            firsts.append(int.from_bytes(first[:8].ljust(8, b"\0"), "big"))
            roots.append(t.root + offset)
            starts.append(start)
            for part, array in zip(parts, (
                    np.where(t.check < 0, -1, t.check.astype(np.int64) + offset), t.target.astype(np.int64) + offset, t.output, t.final)):
                part.append(array)
            offset += len(t.check)
        self.check, self.target, self.output, self.final = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        self.sets = {n: (np.array(f, np.uint64), np.array(r, np.int64), np.array(s, np.int64)) for n, (f, r, s) in self.sets.items()}

    def ordinals(self, data: np.ndarray, offsets: np.ndarray, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Run texts through the automata of their sets: ``(text, ordinal)`` for each occurrence of a known term.

        Text ``i`` is ``data[offsets[i]:offsets[i + 1]]``, in UTF-8. Texts are run window by window, and all
        terms of a window byte by byte together. Windows end between terms.
        """
        numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
        of_text = np.array([numbers[n] for n in names], np.int64)
        lo = int(offsets[0])
        while lo < offsets[-1]:
            hi = _window_end(data, lo, int(offsets[-1]))
            yield self._window(data, lo, hi, offsets, of_text, list(numbers))
            lo = hi

    def _window(self, data, lo, hi, offsets, of_text, names):
        folded = FOLD[data[lo:hi]]
        inside = folded != 0
        cut = np.zeros(hi - lo + 1, bool)  # texts do not run on into each other
        cut[offsets[(offsets >= lo) & (offsets <= hi)] - lo] = True
        cut[0] = cut[-1] = True
        starts = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
        ends = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
        text = np.searchsorted(offsets, starts + lo, "right") - 1
        term, root, base = self._routed(folded, starts, ends, of_text[text], names)
        at, end = starts[term], ends[term]
        found = np.zeros(len(term), bool)
        ordinal, state = base, root
        alive = np.arange(len(term))
        while len(alive):
            over = at == end
            if over.any():
                done = alive[over]
                found[done] = self.final[state[over]] == 1
                keep = ~over
                alive, at, end, state = alive[keep], at[keep], end[keep], state[keep]
            slot = state + folded[at]
            known = self.check[slot] == state
            alive, at, end, slot = alive[known], at[known] + 1, end[known], slot[known]
            ordinal[alive] += self.output[slot]
            state = self.target[slot]
        return text[term[found]], ordinal[found]

    def _routed(self, folded, starts, ends, sets, names):
        """For each term the shards that can hold it, by its first eight bytes: ``(term, root, first ordinal)``.

        There is one, but where several shards begin with the same eight bytes: then the term goes through each.
        """
        head = np.zeros(len(starts), np.uint64)
        last = max(len(folded) - 1, 0)
        for i in range(8):
            byte = np.where(starts + i < ends, folded[np.minimum(starts + i, last)], 0) if len(starts) else np.zeros(0)
            head = (head << np.uint64(8)) | byte.astype(np.uint64)
        terms, roots, bases = [], [], []
        for number, name in enumerate(names):
            if name not in self.sets:
                continue
            firsts, root, start = self.sets[name]
            mine = np.flatnonzero(sets == number)
            low = np.maximum(np.searchsorted(firsts, head[mine], "left") - 1, 0)
            high = np.searchsorted(firsts, head[mine], "right") - 1
            times = np.maximum(high - low + 1, 0)
            shard = np.repeat(low, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            terms.append(np.repeat(mine, times))
            roots.append(root[shard])
            bases.append(start[shard])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (terms, roots, bases))


def _window_end(data: np.ndarray, lo: int, stop: int) -> int:
    """End of a window from ``lo``: about ``WINDOW`` bytes, or as many more as the term there still takes."""
    hi = lo + WINDOW
    while hi < stop:
        gaps = np.flatnonzero(FOLD[data[hi:hi + 65_536]] == 0)
        if len(gaps):
            return min(hi + int(gaps[0]), stop)
        hi += 65_536
    return stop
