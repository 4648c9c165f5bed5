"""Hashes of words and word shingles of whole Arrow columns, in numpy.

Words are runs of bytes other than ASCII white space, ASCII letters lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LETTER = random_table(256, 11)[_FOLD]
_LETTER[_SPACE] = 0
_POWER = random_table(4096, 23) | np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and the end); null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each (one text may be longer)."""
    _, at = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # its first byte
    ends: np.ndarray  # the byte after it
    first: np.ndarray  # index of the first word of each text, and the number of words
    data: np.ndarray
    at: np.ndarray


def words(texts: pa.Array) -> Words:
    data, at = text_bytes(texts)
    n = data.size
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), data, at)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if not starts.size:
        return Words(np.empty(0, np.uint64), starts, ends, np.zeros(len(texts) + 1, np.int64), data, at)
    run = np.diff(np.append(starts, n))
    within = np.arange(starts[0], n) - np.repeat(starts, run)
    value = _LETTER[data[starts[0]:]] * _POWER[within & 4095]
    hashes = mix64(np.add.reduceat(value, starts - starts[0]))
    return Words(hashes, starts, ends, np.searchsorted(starts, at), data, at)


class Shingles(NamedTuple):
    keys: np.ndarray  # distinct shingles, text by text
    counts: np.ndarray  # how often the text has them
    first: np.ndarray  # index of each text's first shingle, and their number


def shingles(w: Words, k: int = 5) -> Shingles:
    """The distinct runs of k words of each text; a shorter text has one run, of all its words."""
    n = w.first[1:] - w.first[:-1]
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    total = int(count.sum())
    first = np.append(0, np.cumsum(count))
    doc = np.repeat(np.arange(n.size), count)
    begin = np.arange(total) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    padded = np.append(w.hashes, np.zeros(k, np.uint64))
    keys = np.zeros(total, np.uint64)
    for j in range(k):
        keys += np.where(j < size, padded[begin + j] * _POWER[j], np.uint64(0))
    keys = mix64(keys + size.astype(np.uint64))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(total, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return Shingles(keys[at], np.diff(np.append(at, total)), np.searchsorted(doc[at], np.arange(n.size + 1)))
