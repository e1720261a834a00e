"""Word-shingle sets of whole texts as sorted 64-bit hashes, and their minwise sketches."""

from __future__ import annotations

import numpy as np

WORDS = 5
# An odd multiplier and its inverse modulo 2^64, and the constants of the splitmix64 finaliser.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's number of words.

    Only A-Z are lower-cased; words are runs of anything but the bytes 9 to 13 and 32.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(white)
    begins = np.concatenate(([0], edge + 1))[:edge.size]
    words = edge > begins
    begins, ends = begins[words], edge[words]
    steps = np.full(data.size, INVERSE, dtype=np.uint64)
    steps[:1] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(steps))))
    steps[:] = MULTIPLIER
    steps[:1] = 1
    hashes = mixed((sums[ends] - sums[begins]) * np.cumprod(steps)[begins] + (ends - begins).astype(np.uint64))
    limits = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(begins, limits))))


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; with fewer words the whole sequence is one, without words the set is empty."""
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, hashes.size - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(MULTIPLIER) + hashes[k:k + rolled.size]
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at:at + n - size + 1]))
        elif n:
            short = n
            for h in hashes[at:at + n]:
                short = (short * MULTIPLIER + int(h)) & (1 << 64) - 1
            out.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray], width: int, seed: int = 1) -> np.ndarray:
    """``width`` minwise values a set (32 bits each, as int32); all -1 for an empty set."""
    out = np.full((len(sets), width), -1, dtype=np.int32)
    full = [i for i, s in enumerate(sets) if s.size]
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [sets[i].size for i in full])[:-1]
    odd = np.random.default_rng(seed).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(width):
        least = np.minimum.reduceat((values * odd[k]) >> np.uint64(32), starts)
        out[full, k] = least.astype(np.uint32).view(np.int32)
    return out
