"""Sorted numpy arrays as compressed bytes, counts of keys, and look-ups in sorted keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import mix64

_CODEC = "zstd"


def pack(a: np.ndarray) -> bytes:
    """A numpy array of numbers as bytes: planes of bytes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.itemsize).T)
    return b"%c%d|" % (a.dtype.char.encode(), a.size) + pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    head, body = raw.split(b"|", 1)
    kind, n = np.dtype(chr(head[0])), int(head[1:])
    if not n:
        return np.empty(0, kind)
    data = np.frombuffer(pa.decompress(body, n * kind.itemsize, codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as their gaps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.empty(0, np.int64)


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of alternating key and count arrays."""
    keys, counts = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = starts(keys)
    return keys[at], (np.add.reduceat(counts, at) if at.size else counts)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    keys = np.sort(keys)
    at = starts(keys)
    return keys[at], np.diff(np.append(at, keys.size)).astype(np.int64)


class Index:
    """Positions of keys in a sorted array, by a hash table with the array behind it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, keys.size)))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[self.slot(keys)[::-1]] = np.arange(keys.size, dtype=np.int32)[::-1]

    def slot(self, keys):
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        if not self.keys.size:
            return np.full(keys.size, -1, np.int64)
        at = self.slots[self.slot(keys)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if other.size:
            where = np.minimum(np.searchsorted(self.keys, keys[other]), self.keys.size - 1)
            at[other] = np.where(self.keys[where] == keys[other], where, -1)
        return at
