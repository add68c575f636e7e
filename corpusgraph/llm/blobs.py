"""Sorted 64-bit keys with counts, as compressed blobs that Spark shuffles by key range.

A task reduces its rows to sorted unique keys, cuts them by their top bits and sends one blob to each shard. Keys
of a shard lie close together, so their differences take 5 or 6 bytes instead of 8. A shard is a range of keys, so
no key and no document decides its size.
"""

from __future__ import annotations

import numpy as np
import zstandard


def shard_bits(n_keys: int, per_shard: int) -> int:
    """Bits of a key that name its shard, for shards of at most about ``per_shard`` keys."""
    return max(0, int(np.ceil(np.log2(max(n_keys, 1) / per_shard)))) if n_keys > per_shard else 0


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in sorted ``keys`` where each shard begins, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the empty ones vanish."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted ``keys`` and columns of as many 64-bit numbers."""
    steps = np.diff(keys, prepend=np.uint64(0))
    raw = b"".join([_planes(steps), *[_planes(c.astype(np.uint64, copy=False)) for c in columns]])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n_columns: int = 0) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = len(raw) // (1 + n_columns)
    keys, *columns = [_unplanes(raw[k * size : (k + 1) * size]) for k in range(1 + n_columns)]
    return (np.cumsum(keys, dtype=np.uint64), *columns)


def _same_so_far(column: np.ndarray, same: np.ndarray) -> np.ndarray:
    return same & np.concatenate([[False], column[1:] == column[:-1]])


def pack_rows(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Rows in the order of their ``columns``, with ``counts`` behind them. Of a column only the step from the row
    before is written where the columns in front of it are the same."""
    raw, same = [], np.arange(len(columns[0])) > 0
    for c in columns:
        steps = c.astype(np.uint64)
        steps[1:] -= np.where(same[1:], c[:-1], np.uint64(0))
        raw.append(_planes(steps))
        same = _same_so_far(c, same)
    raw += [_planes(c.astype(np.uint64, copy=False)) for c in counts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unpack_rows(blob: bytes, n_columns: int, n_counts: int) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = len(raw) // (n_columns + n_counts)
    steps = [_unplanes(raw[k * size : (k + 1) * size]) for k in range(n_columns + n_counts)]
    columns, same = [], np.arange(size // 8) > 0
    for step in steps[:n_columns]:
        sums = np.cumsum(step, dtype=np.uint64)
        starts = np.flatnonzero(~same)
        columns.append(sums - np.repeat(sums[starts] - step[starts], np.diff(np.append(starts, len(step)))))
        same = _same_so_far(columns[-1], same)
    return (*columns, *steps[n_columns:])


def reduced(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows in the order of ``columns``, and the sums of ``counts`` over equal rows."""
    if not len(columns[0]):
        return columns, [c.astype(np.int64) for c in counts]
    order = np.lexsort(columns[::-1])
    columns, same = [c[order] for c in columns], np.arange(len(order)) > 0
    for c in columns:
        same = _same_so_far(c, same)
    first = np.flatnonzero(~same)
    return [c[first] for c in columns], [np.add.reduceat(c[order].astype(np.int64), first) for c in counts]


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted unique keys, and the sums of the columns over equal keys."""
    if not len(keys):
        return (keys, *[c.astype(np.int64) for c in columns])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *[np.add.reduceat(c[order].astype(np.int64), first) for c in columns])
