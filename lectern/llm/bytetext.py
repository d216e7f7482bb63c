"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, hashes, sliding minima.

A batch is cut into slices of whole texts of about ``SLICE`` bytes, so the working memory does not grow
with the batch; one text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * size).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts; offsets start at 0."""
    data, offsets = texts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each word) of the maximal runs of True that do not cross texts."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: equal bytes, equal hash."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _P4)


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hashes[:n].copy()
    for j in range(1, k):
        h *= _P1
        h += word_hashes[j : j + n]
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n])


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each span, all spans of one length at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    half = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    by = lengths[order]
    cuts = np.concatenate([[0], np.flatnonzero(by[1:] != by[:-1]) + 1, [len(by)]])
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows, n = order[lo:hi], int(by[lo])
            at, done = starts[rows], 0
            if n >= 32:
                lanes = [np.full(len(rows), x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
                while done + 32 <= n:
                    for i in range(4):
                        lanes[i] = _rotl(lanes[i] + wide[at + (done + 8 * i)] * _P2, 31) * _P1
                    done += 32
                h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
                for v in lanes:
                    h = (h ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed64 + _P5, np.uint64)
            h = h + np.uint64(n)
            while done + 8 <= n:
                h = _rotl(h ^ (_rotl(wide[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if done + 4 <= n:
                h = _rotl(h ^ (half[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _rotl(h ^ (padded[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            out[rows] = mix(h)
    return out


def bit_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(groups, 64) counts of set bits, for consecutive groups of ``counts`` hashes; empty groups are 0."""
    out = np.zeros((len(counts), 64), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
    parts = (n + 254) // 255
    part_group = np.repeat(np.arange(len(full)), parts)
    part_first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cuts = firsts[part_group] + 255 * (np.arange(len(part_group)) - part_first[part_group])
    sums = np.empty((len(cuts), 64), np.int64)
    for j in range(8):  # a byte holds the count of up to 255 bits
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), cuts)
        sums[:, j::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[full] = np.add.reduceat(sums, part_first, axis=0)
    return out
