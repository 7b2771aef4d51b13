"""Hashed word-shingle sets of texts, computed with numpy over blocks of texts."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once, in whatever text or word they lie.
PIECE = 1 << 18
_random = np.random.default_rng(11)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(PIECE, _STEP, dtype=np.uint64))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fragments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of letters of a piece begin, and their sums of letters by powers of a step."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    lead = starts[0]
    place = np.arange(lead, len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    value = _BYTE[_LOWER[data[lead:]]] * _POWERS[place]
    value[space[lead:]] = 0
    return starts, np.add.reduceat(value, starts - lead)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z as a-z, and the first word of each text (with the end). Pieces of PIECE bytes are
    hashed one by one; a word that goes on in the next piece adds its next sum, moved by its length so far."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    starts, sums, begun, within = [], [], 0, False
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        found, value = _fragments(piece)
        if within and len(found) and not found[0]:
            moved = np.uint64(pow(int(_STEP), at - begun, 1 << 64))
            sums[-1][-1:] += value[:1] * moved
            found, value = found[1:], value[1:]
        if len(found):
            starts.append(found + at)
            sums.append(value)
            begun = int(found[-1]) + at
        within = not _SPACE[piece[-1]]
    if not starts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    return mixed(np.concatenate(sums)), np.searchsorted(np.concatenate(starts), firsts)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer than n words are one shingle, no words are none."""
    words, firsts = word_hashes(texts)
    rows = words * np.uint64(0)
    if len(words) >= n:
        rows = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            rows = mixed(rows * _STEP + words[k : len(words) - n + 1 + k] + np.uint64(k))
    out = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(rows[lo : hi - n + 1].view(np.int64)))
        elif hi > lo:
            short = np.uint64(hi - lo)
            for w in words[lo:hi]:
                short = mixed(np.array([short], dtype=np.uint64) * _STEP + w)[0]
            out.append(np.array([short], dtype=np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out
