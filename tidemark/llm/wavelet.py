"""Token ids as wavelet matrices, one compressed file a shard.

A file holds one shard's documents in identifier order. Layout (little-endian):

    magic "WVM1" | header length u32 | header JSON | document ids i64[docs] | token starts u64[docs + 1] | planes

A plane is one bit of every id, most significant first, ids stably sorted by the bits above: ``words`` u64
with the bits, then ``ranks`` u64 with the ones before every 512th bit. Each section is one zstd frame whose place
and size the header names, so a reader fetches the planes it needs from anywhere in the file.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK_WORDS = 8


def _narrow(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def build(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, nulls: int = 0, part: int = 0, shard: int = 0, level: int = 1) -> bytes:
    """The bytes of one shard. ``starts`` has one entry more than there are documents, of which the last ``nulls`` have no identifier."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=level).compress
    frames = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(starts.astype("<u8").tobytes())]
    zeros, now = [], ids.astype(_narrow(bits))
    for k in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << k)).astype(bool)
        words = np.zeros(-(-len(now) // 512) * BLOCK_WORDS, "<u8")
        packed = np.packbits(ones, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        per_block = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u8")
        frames.append(squeeze(words.tobytes() + ranks.tobytes()))
        zeros.append(int(len(now) - ranks[-1]))
        now = np.concatenate((np.compress(~ones, now), np.compress(ones, now)))
    places = np.cumsum([0, *map(len, frames)]).tolist()
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "places": places, "nulls": nulls, "part": part, "shard": shard}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(frames)


class Shard:
    """A shard's file: token access, counting and occurrence lookup."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._data = data
        n = struct.unpack_from("<I", data, 4)[0]
        self._header = json.loads(data[8 : 8 + n])
        self._base = 8 + n
        self.n, self.bits, self.zeros = self._header["n"], self._header["bits"], self._header["zeros"]
        self.doc_ids = np.frombuffer(self._frame(0), "<i8")
        self.starts = np.frombuffer(self._frame(1), "<u8").astype(np.int64)
        self.null_docs = np.arange(len(self.doc_ids)) >= len(self.doc_ids) - self._header["nulls"]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _frame(self, k: int) -> bytes:
        a, b = self._header["places"][k : k + 2]
        return zstandard.ZstdDecompressor().decompress(self._data[self._base + a : self._base + b])

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            raw = np.frombuffer(self._frame(2 + level), "<u8")
            words = -(-self.n // 512) * BLOCK_WORDS
            self._planes[level] = raw[:words], raw[words:].astype(np.int64)
        return self._planes[level]

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        words, ranks = self._plane(level)
        block = at >> 9
        out = ranks[block]
        for k in range(BLOCK_WORDS):
            word = block * BLOCK_WORDS + k
            left = np.clip(at - (word << 6), 0, 64)
            some = left > 0
            value = words[word[some]]
            keep = left[some].astype(np.uint64)
            mask = np.where(keep == 64, ~np.uint64(0), (np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1))
            out[some] += np.bitwise_count(value & mask).astype(np.int64)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.array(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            words, _ = self._plane(level)
            bit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._rank1(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the last plane's order holds the token's occurrences between two positions."""
        if token < 0 or token >> self.bits:
            return 0, 0
        edge = np.array([start, end], np.int64)
        for level in range(self.bits):
            ones = self._rank1(level, edge)
            edge = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        words, ranks = self._plane(level)
        before = ranks if bit else np.arange(len(ranks), dtype=np.int64) * 512 - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(words[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS].view(np.uint8), bitorder="little")
        return block * 512 + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> list[int]:
        """The positions that hold a token, in ascending order."""
        a, b = self._range(token, start, self.n if end is None else end)
        found = []
        for at in range(a, b):
            for level in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - level) & 1
                at = self._select(level, bit, at - self.zeros[level] if bit else at)
            found.append(at)
        return sorted(found)

    def all_ids(self) -> np.ndarray:
        """Every id in order: the planes undone from the last to the first."""
        narrow = _narrow(self.bits)
        now = np.zeros(self.n, narrow)
        for level in range(self.bits - 1, -1, -1):
            words, _ = self._plane(level)
            bit = np.unpackbits(words.view(np.uint8), bitorder="little")[: self.n].view(bool)
            back = np.empty(self.n, narrow)
            back[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            back[np.flatnonzero(bit)] = now[self.zeros[level] :] | narrow(1 << (self.bits - 1 - level))
            now = back
        return now.astype(np.uint32)
