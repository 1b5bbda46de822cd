"""Embeddings as rows of whole numbers, packed for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import prepare
from tidewatch.session import materialise

#: Components beyond this are refused, as sums of products would no longer be exact.
LARGEST = 1 << 23


def integers(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``row, id, label, size, norm, vector``: components as floor(scale * x), four bytes each; ``norm`` is their sum of squares.

    Rows whose vector is null or holds null or non-finite components are left out. ``row`` numbers the rows, as ids may
    be null or repeat. Components of ``LARGEST`` and more raise ValueError.
    """
    prepare(rows.sparkSession)
    kind = rows.schema[label_col].dataType.simpleString()
    given = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                        F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("vector").is_valid())
            lists = batch.column("vector")
            sizes = np.asarray(lists.value_lengths(), np.int64)
            flat = np.asarray(lists.flatten().fill_null(np.nan), np.float64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = wrong[ends[1:]] == wrong[ends[:-1]]
            flat = np.floor(flat[np.repeat(good, sizes)] * scale)
            if len(flat) and np.abs(flat).max() >= LARGEST:
                raise ValueError(f"a component of {np.abs(flat).max() / scale:g} is too large for exact sums")
            sizes = sizes[good]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            squares = np.concatenate(([0], np.cumsum(flat.astype(np.int64) ** 2)))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * 4), pa.py_buffer(np.ascontiguousarray(flat.astype("<i4")))])
            batch = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label")), pa.array(sizes), pa.array(squares[ends[1:]] - squares[ends[:-1]]),
                                              packed.cast(pa.binary())], ["row", "id", "label", "size", "norm", "vector"])

    return materialise(given.mapInArrow(run, f"row long, id long, label {kind}, size long, norm long, vector binary"), "vectors")


def width(held: DataFrame, parts: int = 1) -> int:
    """The commonest length that ``parts`` divide, the longer one of two; 0 if there is none."""
    best = held.filter((F.col("size") > 0) & (F.col("size") % parts == 0)).groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return best["size"] if best else 0


def matrix(column: pa.Array, columns: int, kind: str = "<i4") -> np.ndarray:
    """Packed vectors of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, columns)
