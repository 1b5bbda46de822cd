"""Vectorised words and hashes over Arrow batches of text.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; upper case A-Z is lowered. Texts are
handled in blocks of a few megabytes, so the arrays of a block stay small whatever a batch holds; one text longer
than a block is a block of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import configure

BLOCK_BYTES = 4 << 20
_SPACES = b" \t\n\r\x0b\x0c"
_LOWER = bytes(c | 0x20 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = bytes(int(c in _SPACES) for c in range(256))
#: Separators that also cut at ASCII punctuation and controls.
IS_MARK = bytes(int(not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128)) for c in range(256))
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2, _S32, _S29 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 32, 29))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: small Arrow batches, as texts may be long; workers find the library."""
    configure(spark)
    paths = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[2])
    if home not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(x for x in (paths.get("PYTHONPATH"), home) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _S32)
    x = x * _C1
    x = x ^ (x >> _S29)
    x = x * _C2
    return x ^ (x >> _S32)


def long_view(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


class Block(NamedTuple):
    """Words of some consecutive texts of a batch."""

    first: int                # row of the batch that the block begins with
    rows: int
    data: bytes               # lowered bytes, with 8 zero bytes after the end
    starts: np.ndarray        # byte where each word begins
    ends: np.ndarray
    row: np.ndarray           # row of each word, counted from ``first``


def plain(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """One string array without nulls (null text: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, memoryview]]:
    """First row, offsets from zero (one more than rows) and bytes of runs of texts of about ``limit`` bytes."""
    column = plain(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]]
        first = last


def word_blocks(column: pa.Array, limit: int = BLOCK_BYTES, separators: bytes = IS_SPACE) -> Iterator[Block]:
    for first, offsets, raw in byte_blocks(column, limit):
        data = bytes(raw).translate(_LOWER)
        space = np.frombuffer(data.translate(separators), dtype=bool)
        n = len(space)
        begin, end = np.ones(n, bool), np.ones(n, bool)
        if n:
            begin[1:] = space[:-1]
            end[:-1] = space[1:]
            begin[offsets[:-1][offsets[:-1] < n]] = True
            end[offsets[1:][offsets[1:] > 0] - 1] = True
        begin &= ~space
        end &= ~space
        starts = np.flatnonzero(begin)
        yield Block(first, len(offsets) - 1, data + bytes(8), starts, np.flatnonzero(end) + 1,
                    np.searchsorted(offsets, starts, "right") - 1)


def hash_ranges(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time; ``data`` has 8 bytes to spare."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64))
    if not len(h):
        return h
    h = mix(h ^ (eight[starts] & _LOW_BYTES[np.minimum(length, 8)]))
    more, done = np.flatnonzero(length > 8), 8
    while len(more):
        left = length[more] - done
        h[more] = mix(h[more] ^ (eight[starts[more] + done] & _LOW_BYTES[np.minimum(left, 8)]))
        more, done = more[left > 8], done + 8
    return h


def word_hashes(block: Block) -> np.ndarray:
    return hash_ranges(block.data, block.starts, block.ends)
