"""One shard of token ids: raw payload, sorted keys, and a minimal perfect hash from key to record.

Layout (little-endian): magic, then lengths of the sections, then the sections:
payload ids | record offsets (int64, records + 1) | keys (int64) | hash levels | slot table | head.
Rows without a key come first; they are reached by position only.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow.fs as pafs

MAGIC = b"IDSHARD1"
_HEAD = struct.Struct("<8s10q")
GAMMA = 1.6
MAX_LEVELS = 40
_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: distinct keys give distinct values for any one seed."""
    with np.errstate(over="ignore"):
        x = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key shares its position.

    Slot = number of set bits before it. Keys that MAX_LEVELS leave over are kept sorted.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, levels = keys.view(_U), [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            m = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(sizes)) % _U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key outside the set, any slot or -1."""
        k, out, todo = keys.view(_U), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                return out
            at = self.starts[level] + (mix(k[todo], level) % _U(m)).astype(np.int64)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, k[todo]), len(self.rest) - 1)
            hit = self.rest[at] == k[todo]
            out[todo[hit]] = self.rank[-1] + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(_U), 1 << 20) >> _U(32)).astype(np.uint32)


def footer(keys: np.ndarray, n_null: int, lengths: np.ndarray) -> bytes:
    """All sections after the payload. keys: sorted, of the rows that have one; lengths: ids per row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    table = np.zeros(len(distinct), dtype=[("fingerprint", "<u4"), ("count", "<u4"), ("record", "<i8")])
    table["fingerprint"][slot], table["count"][slot], table["record"][slot] = fingerprints(distinct), count, first + n_null
    packed = np.packbits(mph.bits)
    parts = [offsets.tobytes(), keys.astype("<i8").tobytes(), np.array(mph.sizes, "<i8").tobytes(), packed.tobytes(), mph.rest.astype("<u8").tobytes(), table.tobytes()]
    return b"".join(parts), [len(offsets) - 1, n_null, len(mph.sizes), len(mph.rest), len(distinct)]


def head(width: int, payload_bytes: int, counts: list[int]) -> bytes:
    return _HEAD.pack(MAGIC, width, payload_bytes, *counts, 0, 0, 0)


HEAD_BYTES = _HEAD.size


class _Index:
    """What the sections after the keys say: from a key to its records, checked by the stored fingerprint."""

    def _sections(self, head: bytes):
        # the head stands at the end, so that the payload can be streamed out first
        magic, width, self.payload, self.n, self.n_null, self.n_levels, self.n_rest, self.n_distinct, *_ = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.dtype, self.width = f"<u{width}", width
        self.keys_at = self.payload + 8 * (self.n + 1)
        self.index_at = self.keys_at + 8 * (self.n - self.n_null)

    def _index(self, raw: bytes, at: int):
        def take(dtype, count):
            nonlocal at
            a = np.frombuffer(raw, dtype, count, at)
            at += a.nbytes
            return a

        sizes = take("<i8", self.n_levels).tolist()
        bits = np.unpackbits(take(np.uint8, (sum(sizes) + 7) // 8), count=sum(sizes)).astype(bool)
        self.mph = PerfectHash(sizes, bits, take("<u8", self.n_rest))
        self.table = take([("fingerprint", "<u4"), ("count", "<u4"), ("record", "<i8")], self.n_distinct)

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key (-1, 0: the key isn't here)."""
        if not len(self.table):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        entry = self.table[np.maximum(slot, 0)]
        here = (slot >= 0) & (entry["fingerprint"] == fingerprints(keys))
        return np.where(here, entry["record"], -1), np.where(here, entry["count"], 0)

    def get(self, key: int) -> list[np.ndarray]:
        first, count = self.records(np.array([key], np.int64))
        return [self.record(int(first[0]) + i) for i in range(int(count[0]))]


class Shard(_Index):
    """A shard read back as a whole."""

    def __init__(self, raw: bytes):
        self._sections(raw[-HEAD_BYTES:])
        self.ids = np.frombuffer(raw, self.dtype, self.payload // self.width)
        self.offsets = np.frombuffer(raw, "<i8", self.n + 1, self.payload)
        self.keys = np.frombuffer(raw, "<i8", self.n - self.n_null, self.keys_at)
        self._index(raw, self.index_at)

    def record(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


class Remote(_Index):
    """A shard in its place: the index is read once; then a key costs its slot and two ranged reads per record.

    A fingerprint of 32 bits takes one in 2 ** 32 foreign keys for one of the shard's, so the stored key is compared as well.
    """

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self._sections(self._read(size - HEAD_BYTES, HEAD_BYTES))
        self._index(self._read(self.index_at, size - HEAD_BYTES - self.index_at), 0)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def get(self, key: int) -> list[np.ndarray]:
        first, count = self.records(np.array([key], np.int64))
        if count[0] and np.frombuffer(self._read(self.keys_at + 8 * (int(first[0]) - self.n_null), 8), "<i8")[0] != key:
            return []
        return super().get(key)

    def record(self, i: int) -> np.ndarray:
        lo, hi = np.frombuffer(self._read(self.payload + 8 * i, 16), "<i8").tolist()
        return np.frombuffer(self._read(lo * self.width, (hi - lo) * self.width), self.dtype)
