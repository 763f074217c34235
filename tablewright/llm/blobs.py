"""Columns of numbers as compressed blobs, so that a shuffle moves a few large rows."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    head = struct.pack("<I", len(columns))
    body = []
    for c in columns:
        c = np.ascontiguousarray(c)
        head += struct.pack("<4sIQ", c.dtype.str.encode(), c.shape[1] if c.ndim == 2 else 0, len(c))
        body.append(c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 16 * n, []
    for i in range(n):
        kind, width, rows = struct.unpack_from("<4sIQ", raw, 4 + 16 * i)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        count = rows * max(width, 1)
        c = np.frombuffer(raw, kind, count, at)
        out.append(c.reshape(rows, width) if width else c)
        at += count * kind.itemsize
    return out


def stacked(blobs) -> list[np.ndarray]:
    """The columns of many blobs, one after another."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts)]


def small(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of 64-bit values, as rows of bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def wide(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :rows.shape[1]] = rows
    return out.view("<u8").ravel()


def by_part(part: np.ndarray):
    """(part, indices) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(part[at[0]]), at


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the leftmost smallest one.

    The low 28 bits of the values give way to the place, so ties in the others go left;
    what decides depends on the content of the window alone.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    if len(values) > int(low):
        raise ValueError("a text of over 256 million units")
    cur = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    least = np.minimum(cur[:n], cur[width - span:width - span + n])
    return (least & low).astype(np.int64)


def rolling_hash(units: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hashes of all runs of ``width`` units (uint64)."""
    out, length, base, span, power = None, 0, units, 1, np.array([0x9E3779B97F4A7C15], np.uint64)
    left = width
    while left:
        if left & 1:
            if out is None:
                out, length = base, span
            else:
                n = max(0, len(units) - (length + span) + 1)
                out = out[:n] * power + base[length:length + n]
                length += span
        left >>= 1
        if left:
            n = max(0, len(units) - 2 * span + 1)
            base = base[:n] * power + base[span:span + n]
            span, power = span * 2, power * power
    return out


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its leftmost smallest one, whole
    values compared: what decides depends on the content of the window alone."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    cur, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = cur[:len(cur) - step], cur[step:]
        cur = np.where(values[right] < values[left], right, left)
        span += step
    return cur
