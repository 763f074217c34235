"""Static binary fuse filter over 64-bit keys: three overlapping segments, 16-bit fingerprints.

Built once per immutable key set; answers "maybe" for every member and for about one in
65,536 others. Construction peels slots of degree one, a layer at a time, in numpy.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from tablewright.llm.common import mix64

_HEAD = struct.Struct("<QIIi")     # seed, segment length, segments that start a key, keys


def _slots(keys: np.ndarray, seed: int, seg_len: int, starts: int):
    h = mix64(keys + np.uint64(seed))
    span = np.uint64(starts * seg_len)
    first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
    low = np.uint64(seg_len - 1)
    second = (first + np.uint64(seg_len)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * seg_len)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint16)


def _peel(slots: np.ndarray, size: int):
    """Layers of (key, owned slot), or None when a core remains."""
    n = slots.shape[1]
    degree = sum(np.bincount(s, minlength=size) for s in slots)
    index = np.arange(n, dtype=np.int64)
    held = sum(np.bincount(s, weights=index, minlength=size) for s in slots).astype(np.int64)
    layers, left = [], n
    while left:
        single = np.flatnonzero(degree == 1)
        if not len(single):
            return None
        keys, at = np.unique(held[single], return_index=True)
        layers.append((keys, single[at]))
        left -= len(keys)
        for s in slots:
            degree -= np.bincount(s[keys], minlength=size)
            held -= np.bincount(s[keys], weights=keys, minlength=size).astype(np.int64)
    return layers


def build(keys: np.ndarray) -> bytes:
    """The filter of the distinct values of ``keys`` (uint64), as bytes."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    seg_len = min(1 << 18, 1 << int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    starts = max(1, math.ceil(n * factor / seg_len) - 2) if n > 1 else 1
    for seed in range(1, 10_000):
        slots, prints = _slots(keys, seed, seg_len, starts)
        size = (starts + 2) * seg_len
        layers = _peel(slots, size)
        if layers is not None:
            break
        if seed % 10 == 0:      # tiny sets may need more room
            starts += 1
    else:
        raise RuntimeError("no seed found for the filter")
    table = np.zeros(size, np.uint16)
    for own, at in reversed(layers):
        a, b, c = slots[:, own]
        table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c] ^ table[at]
    return _HEAD.pack(seed, seg_len, starts, n) + table.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key: False if it is surely not a member."""
    seed, seg_len, starts, n = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint16, offset=_HEAD.size)
    (a, b, c), prints = _slots(keys.astype(np.uint64), seed, seg_len, starts)
    return (table[a] ^ table[b] ^ table[c]) == prints
