"""Hashes of words and word shingles for whole blocks of texts, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        with np.errstate(over="ignore"):
            for b in (_BASE, inverse):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word `[^\\x20\\x09-\\x0D]+` of `raw`; equal words have equal hashes."""
    data = np.frombuffer(raw, np.uint8)
    word = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(max(len(data) + 1, BLOCK_BYTES))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
        return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def shingles_of(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; without words, none.
    """
    block, size = [], 0
    for t in texts:
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_LOWER)
        if block and size + len(raw) > BLOCK_BYTES:
            yield from _block(block, k)
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    yield from _block(block, k)


def _block(raws: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not raws:
        return
    starts, _, h = word_hashes(b"\n".join(raws) + b"\n")
    bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
    cut = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        full = h
        for j in range(1, k):
            full = mix(full[: len(h) - j]) * np.uint64(3) + h[j:]
        full = mix(full)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(full[lo : hi - k + 1])
            elif hi > lo:
                own = h[lo : lo + 1]
                for j in range(lo + 1, hi):
                    own = mix(own) * np.uint64(3) + h[j : j + 1]
                yield mix(own + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


class MinHash:
    """Signatures of `n` 32-bit minima."""

    def __init__(self, n: int, seed: int = 11):
        r = np.random.RandomState(seed)
        self.n = n
        self.a = r.randint(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.randint(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(self.n, 0xFFFFFFFF, np.uint32)
        low = (shingles >> np.uint64(32)).astype(np.uint32) ^ (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in range(0, len(low), 4096):
            x = low[i : i + 4096, None]
            y = x * self.a + self.b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            best = np.minimum(best, y.min(axis=0))
        return best


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
