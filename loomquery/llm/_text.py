"""Vectorised text features on batches of whole texts."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, n.bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of each white-space word of the texts, A-Z lower-cased, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(buf))[: len(buf)], dtype=np.uint64)
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    h = (sums[ends - 1] - before) * powers(_INVERSE, len(buf))[starts]
    lengths = np.array([len(x) + 1 for x in raw])
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(np.cumsum(lengths), starts, side="right")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
