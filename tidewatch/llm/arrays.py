"""Sorted arrays in the shared folder that tasks write and later tasks memory-map.

A table is split into shards by the high bits of its 64-bit keys. Each shard is written once, by the task that holds its
rows, as one plain file per column under a temporary name that is then moved into place, so a task that is run again
leaves the same files. Readers map local files; from other stores a worker copies a shard to its own disk first.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import fresh_path

_open: dict[str, np.ndarray] = {}


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else os.path.abspath(uri))


def write_file(uri: str, data: np.ndarray) -> None:
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    held = f"{path}.{os.getpid()}.{os.urandom(6).hex()}"
    with store.open_output_stream(held) as out:
        out.write(np.ascontiguousarray(data).view(np.uint8).data if len(data) else b"")
    store.move(held, path)


def read_file(uri: str, kind: str) -> np.ndarray:
    """The file as a read-only memory map, opened once per worker; a shard that got no rows has no file and is empty."""
    if uri not in _open:
        store, path = _store(uri)
        if not store.get_file_info(path).size:
            return np.empty(0, kind)
        if not isinstance(store, pa.fs.LocalFileSystem):
            copy = tempfile.NamedTemporaryFile(prefix="shard-")  # goes with the worker
            with store.open_input_stream(path) as source:
                while part := source.read(1 << 22):
                    copy.write(part)
            copy.flush()
            path = copy.name
            _open[f"{uri}#copy"] = copy
        _open[uri] = np.memmap(path, kind, "r")
    return _open[uri]


def read_whole(uri: str) -> bytes:
    """All bytes of a file of the shared folder; nothing is kept on the worker's disk."""
    store, path = _store(uri)
    with store.open_input_stream(path) as source:
        return source.read()


def lookup(root: str, name: str, kind: str, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Value of each key in arrays whose shards do not follow from the keys; 0 where it is not there."""
    out = np.zeros(len(keys), kind)
    order = np.lexsort((keys, shard))
    begins = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if len(keys) else []
    for a, b in zip(begins, [*begins[1:], len(keys)]):
        mine, s = order[a:b], int(shard[order[a]])
        own = read_file(f"{root}/{s:06d}.key", "<u8")
        if len(own):
            at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
            out[mine] = np.where(own[at] == keys[mine], read_file(f"{root}/{s:06d}.{name}", kind)[at], 0)
    return out


class Arrays(NamedTuple):
    """Where a table of sorted arrays is; small enough to travel with a task."""

    root: str
    kinds: dict[str, str]
    offsets: np.ndarray    # rows before each shard, and all rows

    @property
    def shards(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str, shard: int) -> np.ndarray:
        return read_file(f"{self.root}/{shard:06d}.{name}", self.kinds[name])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not there; keys in order."""
        out = np.full(len(keys), -1, np.int64)
        edges = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = int(edges[s]), int(edges[s + 1])
            own = self.column("key", s)
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == keys[a:b], at + self.offsets[s], -1)
        return out

    def take(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Values of rows as ``find`` gives them, in their order; 0 for rows that are not there."""
        out = np.zeros(len(rows), self.kinds[name])
        order = np.argsort(rows, kind="stable")
        edges = np.searchsorted(rows[order], self.offsets)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            mine = order[edges[s]:edges[s + 1]]
            out[mine] = self.column(name, s)[rows[mine] - self.offsets[s]]
        return out


def gather(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The rows of one task as arrays."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] + [b.schema.names] for b in batches]
    if not parts:
        return {}
    return {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(parts[0][-1])}


def publish(rows: DataFrame, label: str, kinds: dict[str, str], shards: int, build: Callable[[int, dict[str, np.ndarray]], dict[str, np.ndarray]],
            sums: tuple[str, ...] = ()) -> tuple[Arrays, dict[str, int]]:
    """Write ``rows`` (with their ``shard``) as sorted arrays, and add up the columns ``sums`` of what is written.

    ``build`` gets a shard and its rows and returns the columns to write in ``kinds``, and other one-value arrays that
    are only added up.
    """
    root = fresh_path(rows.sparkSession, label)
    extra = tuple(sums)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches)
        if not got:
            return
        order = np.argsort(got["shard"], kind="stable")
        shard = got["shard"][order]
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, b in zip(begins, [*begins[1:], len(shard)]):
            s = int(shard[a])
            built = build(s, {k: v[order[a:b]] for k, v in got.items()})
            for name, kind in kinds.items():
                write_file(f"{root}/{s:06d}.{name}", built[name].astype(kind, copy=False))
            n = len(built[next(iter(kinds))])
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([n]), *(pa.array([int(built[k].sum())]) for k in extra)], ["shard", "rows", *extra])

    schema = ", ".join(f"{c} long" for c in ("shard", "rows", *extra))
    done = rows.repartition(shards, "shard").mapInArrow(write, schema).collect()  # one row per shard
    sizes = np.zeros(shards, np.int64)
    for r in done:
        sizes[r["shard"]] = r["rows"]
    return Arrays(root, kinds, np.concatenate(([0], np.cumsum(sizes)))), {k: sum(r[k] for r in done) for k in extra}


def batches_of(columns: dict[str, np.ndarray], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + size]) for c in columns.values()], list(columns))


class Tally:
    """Counts of keys over a task, merged now and then and handed out when there are many."""

    MERGE, MOST = 1_500_000, 3_000_000

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """True if it is time for ``flush``."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.MERGE and len(self.parts) > 1:
            self.parts = [self._merged()]
            self.size = len(self.parts[0][0])
        return self.size > self.MOST

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return add_up(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._merged() if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return out


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(counts[order], begins)


def unsigned(signed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(signed).view(np.uint64)
