"""Sorted hash arrays as files below ``spark.checkpoint.dir``, cut into shards by key range and memory-mapped.

A shard's keys and each of its columns are ``.npy`` files. Most counts are small, so a column takes one byte for each
value, and the few values of 255 and more lie in a second file with their places. Keys can also be
kept short (``write_short``): an index of buckets of 8 to 16 keys by their first bits, and the next 32 bits of each. A
shard then takes a key that it does not hold for one of its own with odds below 2^-28 at any size. Files are written by the task that made them, under a temporary name and
then renamed, so a task that runs twice leaves one file. Workers map a file where the shared folder
is mounted; from another kind of store they fetch a shard when they first need it, into their own temporary folder.
Pages that look-ups have read are given back shard by shard (``_give_back``), so a worker holds a bounded part of the
arrays, however large they are; the system's cache keeps them for the next look.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

#: Value of a one-byte column whose true value lies apart.
APART = 255
#: Bytes of mapped files that a worker holds in memory between two shards.
HELD_BYTES = 192 << 20
_mapped: dict[str, np.ndarray | None] = {}
#: Mapped files that were read since pages were last given back.
_read: dict[str, np.ndarray] = {}


def _store(folder: str) -> tuple[fs.FileSystem, str, bool]:
    """File system, path in it, and whether it is mounted here."""
    scheme = urlparse(folder).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(folder).path if scheme else folder, True
    for spark_name in ("s3a:", "s3n:"):
        folder = folder.replace(spark_name, "s3:", 1) if folder.startswith(spark_name) else folder
    system, path = fs.FileSystem.from_uri(folder)
    return system, path, False


def _save(system: fs.FileSystem, path: str, name: str, values: np.ndarray) -> None:
    passing = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        np.save(out, values)
    system.move(passing, f"{path}/{name}.npy")


def write(folder: str, table: str, shard: int, **columns: np.ndarray) -> None:
    """Columns in one byte for each value with the larger ones apart, or in the narrowest type that holds them all if
    that is less; ``keys`` stay 64 bits wide."""
    system, path, _ = _store(folder)
    system.create_dir(path, recursive=True)
    for name, values in columns.items():
        stem = f"{table}-{shard:06d}-{name}"
        if name != "keys":
            narrow = np.dtype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)
            large = np.flatnonzero(values >= APART)
            if 16 * len(large) < (narrow.itemsize - 1) * len(values):
                _save(system, path, f"{stem}-apart", np.stack([large, values[large].astype(np.int64)]))
                values, narrow = np.minimum(values, APART), np.dtype(np.uint8)
            values = values.astype(narrow)
        _save(system, path, stem, values)


def _open(folder: str, name: str) -> np.ndarray | None:
    """The mapped file; None if no task wrote this shard."""
    key = f"{folder}/{name}"
    if key not in _mapped:
        system, path, mounted = _store(folder)
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            _mapped[key] = None  # the job that writes shards ends before the first look
            return None
        local = f"{path}/{name}"
        if not mounted:
            local = os.path.join(tempfile.mkdtemp(prefix="arrays-"), name)
            fs.copy_files(f"{path}/{name}", local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        _mapped[key] = _map(local)
    if _mapped[key] is not None:
        _read[key] = _mapped[key]
    return _mapped[key]


def _map(path: str) -> np.ndarray:
    """As ``np.load`` maps it, without a file handle that stays open: there are thousands of files."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = read(f)
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        return np.frombuffer(held, dtype, offset=f.tell()).reshape(shape)


def _give_back() -> None:
    """Lets go of the pages of mapped files if their files together, as read since the last time, pass ``HELD_BYTES``."""
    if sum(a.nbytes for a in _read.values()) <= HELD_BYTES:
        return
    for a in _read.values():
        held = a
        while not isinstance(held, mmap.mmap):
            held = held.base if isinstance(held, np.ndarray) else held.obj
        held.madvise(mmap.MADV_DONTNEED)
    _read.clear()


def _values(folder: str, stem: str, places: np.ndarray) -> np.ndarray:
    values = _open(folder, f"{stem}.npy")[places].astype(np.int64)
    apart = _open(folder, f"{stem}-apart.npy")
    if apart is not None:
        large = np.flatnonzero(values == APART)
        values[large] = apart[1][np.searchsorted(apart[0], places[large])]
    return values


def _tails(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def write_short(folder: str, table: str, shard: int, keys: np.ndarray, **columns: np.ndarray) -> None:
    """Sorted ``keys`` without the bits that their buckets imply and those behind the next 32, and their columns."""
    bits = max(0, len(keys).bit_length() - 4)
    sizes = np.bincount(_buckets(keys, bits), minlength=1 << bits)
    system, path, _ = _store(folder)
    system.create_dir(path, recursive=True)
    _save(system, path, f"{table}-{shard:06d}-index", np.append(0, np.cumsum(sizes)).astype(np.uint32))
    _save(system, path, f"{table}-{shard:06d}-tails", _tails(keys, bits))
    write(folder, table, shard, **columns)


def _places(folder: str, stem: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a shard, and which of them are there."""
    known = _open(folder, f"{stem}-keys.npy")
    if known is not None and len(known):
        places = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return places, known[places] == keys
    index = _open(folder, f"{stem}-index.npy")
    if index is None or not index[-1]:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    bits = (len(index) - 1).bit_length() - 1
    tails, wanted, bucket = _open(folder, f"{stem}-tails.npy"), _tails(keys, bits), _buckets(keys, bits)
    low, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    high, last = end, len(tails) - 1
    for _ in range(int((end - low).max()).bit_length()):  # halve every bucket at once
        middle = (low + high) >> 1
        less = (low < high) & (tails[np.minimum(middle, last)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return low, (low < end) & (tails[np.minimum(low, last)] == wanted)


def _hits(folder: str, table: str, shards: np.ndarray, keys: np.ndarray):
    """(shard's stem, places in it, numbers of the keys found there). Keys are looked up in order, one shard after
    another, so a mapped file is read from front to back."""
    order = np.argsort(keys)
    narrow = shards.astype(np.min_scalar_type(int(shards.max()) if len(shards) else 0))  # a few bytes sort by radix
    order = order[np.argsort(narrow[order], kind="stable")]
    sorted_keys, sorted_shards = keys[order], shards[order]
    at = np.append(np.flatnonzero(np.diff(sorted_shards, prepend=-1)), len(keys))
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        stem = f"{table}-{int(sorted_shards[lo]):06d}"
        places, hit = _places(folder, stem, sorted_keys[lo:hi])
        if hit.any():
            yield stem, places[hit], order[lo:hi][hit]
        _give_back()


def look_up(
    folder: str, table: str, shards: np.ndarray, keys: np.ndarray, columns: tuple[str, ...]
) -> list[np.ndarray]:
    """The columns for each key in its shard, 0 where the key is not there."""
    out = [np.zeros(len(keys), np.int64) for _ in columns]
    for stem, places, back in _hits(folder, table, shards, keys):
        for values, name in zip(out, columns, strict=True):
            values[back] = _values(folder, f"{stem}-{name}", places)
    return out


def holds(folder: str, table: str, shards: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in its shard."""
    out = np.zeros(len(keys), bool)
    for _, _, back in _hits(folder, table, shards, keys):
        out[back] = True
    return out


def at_places(folder: str, table: str, shards: np.ndarray, places: np.ndarray, column: str) -> np.ndarray:
    """Values of a column without keys."""
    out = np.zeros(len(places), np.int64)
    for shard in np.unique(shards).tolist():
        here = np.flatnonzero(shards == shard)
        out[here] = _values(folder, f"{table}-{shard:06d}-{column}", places[here])
        _give_back()
    return out
