"""Word shingles of a text as 64-bit hashes, and their MinHash signature."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
HASHES = 128
_CHUNK_WORDS = 32_768
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            tables.append(np.multiply.accumulate(out))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(squeezed: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of every run of ``words`` words of a text whose only white space is single blanks.

    A text with fewer words, but at least one, has one shingle: all its words. A text without words has none.
    """
    data = np.frombuffer(squeezed.strip(" ").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.append(blanks, len(data))
    width = min(words, len(starts))
    found = []
    for at in range(0, len(starts) - width + 1, _CHUNK_WORDS):
        last = min(at + _CHUNK_WORDS, len(starts) - width + 1)
        first_byte, last_byte = starts[at], ends[last + width - 2]
        power, inverse = _power_tables(int(last_byte - first_byte) + 1)
        part = data[first_byte:last_byte]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=sums[1:])
        a, b = starts[at:last] - first_byte, ends[at + width - 1 : last + width - 1] - first_byte
        found.append(_mixed((sums[b] - sums[a]) * inverse[a]))
    return np.unique(np.concatenate(found))


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of each hash function's smallest value, as little-endian integers."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (x[k : k + 2048, None] * _MUL + _ADD).min(axis=0), out=low)
    return (low & np.uint32(0xFFFF)).astype("<u2").tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
