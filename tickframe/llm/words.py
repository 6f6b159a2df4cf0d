"""Vectorised words and word hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: The white space of the word rule `[^\\x20\\x09-\\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text hashed in one vectorised step; bounds the memory of the temporary arrays.
STEP_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62, dtype=np.uint64)) * 8 + 5
_powers: dict[str, np.ndarray] = {}


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _step(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    blank = SPACE[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(start, begins))


def word_hashes(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step of about STEP_BYTES: (hash of every word, number of words of each text), in order."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= STEP_BYTES:
            yield _step(held)
            held, size = [], 0
    if held:
        yield _step(held)


def all_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, offsets of the texts in it)."""
    parts = list(word_hashes(texts))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    counts = np.concatenate([n for _, n in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def rolling(h: np.ndarray, width: int, coef: np.ndarray) -> np.ndarray:
    """Hash of each window of width consecutive entries of h (one shorter array, no text boundaries)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * coef[k]
    return mix(out)
