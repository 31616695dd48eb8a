"""Arrays in files of the shared checkpoint folder, which workers map into memory.

Every file is written under a name of its task's own and moved into place, so a lost or repeated task leaves a whole file. Workers
map local (or mounted) files directly; from another store they first copy a file to a folder of their own, which goes with the
process: a cache that nobody else reads.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write(folder: str, name: str, *arrays: np.ndarray) -> None:
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for a in arrays:
            if len(a):
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
    fs.move(own, f"{at}/{name}")


_maps: dict[str, np.memmap] = {}
_copies: dict[str, str] = {}


def mapped(folder: str, name: str) -> np.ndarray:
    key = f"{folder}/{name}"
    if key not in _maps:
        fs, at = _store(folder)
        path = f"{at}/{name}"
        if not isinstance(fs, pafs.LocalFileSystem):
            if folder not in _copies:
                _copies[folder] = tempfile.mkdtemp()
                atexit.register(shutil.rmtree, _copies[folder], True)
            path = f"{_copies[folder]}/{name}"
            with fs.open_input_stream(f"{at}/{name}") as src, open(path, "wb") as out:
                shutil.copyfileobj(src, out)
        if len(_maps) > 4096:
            _maps.clear()
        _maps[key] = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    return _maps[key]


def forget(folder: str) -> None:
    for name in list(_maps):
        if name.startswith(folder):
            del _maps[name]


def columns(raw: np.ndarray, *parts: tuple[int, type]) -> list[np.ndarray]:
    """The arrays that a file holds one behind the other, by length and type."""
    out, at = [], 0
    for n, t in parts:
        size = n * np.dtype(t).itemsize
        out.append(raw[at : at + size].view(t))
        at += size
    return out


class Places(dict):
    """Words by the place at which they were first seen."""

    def __missing__(self, word) -> int:
        self[word] = at = len(self)
        return at


def find_sorted(hashes: np.ndarray, shards: int, keys_of) -> np.ndarray:
    """For each hash its shard and place in it as one number (shard << 40 | place), -1 if there is none.

    Shards are equal ranges of hashes, so sorted hashes pass each once, in order; keys_of gives a shard's sorted keys.
    """
    order = np.argsort(hashes)
    wanted, found = hashes[order], np.full(len(hashes), -1, np.int64)
    edges = np.searchsorted(wanted, np.array([k * ((1 << 64) // shards) for k in range(shards)], np.uint64)).tolist()
    for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(wanted)], strict=True)):
        if b > a and len(keys := keys_of(k)):
            at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
            found[a:b] = np.where(keys[at] == wanted[a:b], at + (k << 40), -1)
    out = np.empty_like(found)
    out[order] = found
    return out


@dataclass
class Counts:
    """Counts by key and column: sorted hashes of keys in shards, and behind each key its columns and counts."""

    folder: str
    name: str
    sizes: list[tuple[int, int]]  # by shard: keys, entries

    def shard(self, k: int) -> list[np.ndarray]:
        n, m = self.sizes[k]
        return columns(mapped(self.folder, f"{self.name}-{k}"), (n, np.uint64), (n, np.int64), (m, np.int64), (m, np.int32)) if n else [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count): the entries of the hashes that have any, by their row among the hashes."""
        place = find_sorted(hashes, len(self.sizes), lambda k: self.shard(k)[0]) if len(hashes) else np.zeros(0, np.int64)
        rows, cols, counts = [], [], []
        shard = place >> 40
        for k in np.unique(shard[place >= 0]).tolist():
            own = np.flatnonzero(shard == k)
            at = place[own] & ((1 << 40) - 1)
            _, ends, n, c = self.shard(k)
            stop = ends[at]
            size = stop - np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            pick = np.repeat(stop - np.cumsum(size), size) + np.arange(size.sum())
            rows.append(np.repeat(own, size))
            cols.append(c[pick])
            counts.append(n[pick])
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows or empty), np.concatenate(cols or empty), np.concatenate(counts or empty)


def write_counts(folder: str, name: str, hashes: np.ndarray, column: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Writes one shard from its entries, a row for each key and column (rows of equal ones add up); returns its sizes."""
    order = np.lexsort((column, hashes))
    hashes, column, n = hashes[order], column[order], n[order]
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (column[1:] != column[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    hashes, column, n = hashes[new], column[new], np.add.reduceat(n, new) if len(new) else n
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    write(folder, name, hashes[first], np.r_[first[1:], len(hashes)].astype(np.int64), n.astype(np.int64), column.astype(np.int32))
    return len(first), len(hashes)
