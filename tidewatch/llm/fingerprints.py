"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes marks chunk boundaries where it ends in ``k`` zero bits, so boundaries of block size
``2**(k+1)`` are some of those of ``2**k``. A fingerprint is ``block:chunks:coarse`` with the chunk signature at the
smallest block size that needs at most 64 chunks and at twice that size, two characters a chunk. Two fingerprints are
compared by edit distance (insertions and deletions of chunks) at their common block size; without one they are unlike.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import partitions

WINDOW, MOST_CHUNKS, SMALLEST = 7, 64, 4
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in _ALPHABET for b in _ALPHABET]
_LEAST = -(1 << 63)


def rolling(data: bytes) -> np.ndarray:
    """Polynomial hash of the seven bytes that end at each byte (zeros before the text), finished by a multiplication."""
    x = np.zeros(len(data) + WINDOW - 1, np.uint32)
    x[WINDOW - 1:] = np.frombuffer(data, np.uint8)
    x[WINDOW - 1:] += np.uint32(1)
    r = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        r *= np.uint32(0x01000193)
        r += x[k:k + len(data)]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(13)
    return r


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes; a text without bytes has one without chunks."""
    if not data:
        return f"{1 << SMALLEST}::"
    r = rolling(data)
    marks = np.flatnonzero((r & np.uint32((1 << SMALLEST) - 1)) == 0)
    values = r[marks].astype(np.int64) | (1 << 32)
    levels = np.frexp((values & -values).astype(np.float64))[1] - 1
    level = SMALLEST
    while np.count_nonzero(levels >= level) >= MOST_CHUNKS:
        level += 1

    def signature(k: int) -> str:
        starts = np.unique(np.concatenate(([0], marks[levels >= k] + 1)))
        sums = np.add.reduceat(r, starts[starts < len(r)], dtype=np.uint32)
        return "".join(_PAIRS[s] for s in ((sums * np.uint32(0x9E3779B1)) >> np.uint32(20)).tolist())

    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine operation for all of ``a`` per item of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> float:
    """1 - edit distance / chunks of both, at the finest block size both have; 0 if none is compatible."""
    if a == b:
        return 1.0
    (size_a, fine_a, coarse_a), (size_b, fine_b, coarse_b) = a.split(":"), b.split(":")
    if size_a == size_b:
        x, y = fine_a, fine_b
    elif int(size_a) == 2 * int(size_b):
        x, y = fine_a, coarse_b
    elif 2 * int(size_a) == int(size_b):
        x, y = coarse_a, fine_b
    else:
        return 0.0
    x, y = [x[i:i + 2] for i in range(0, len(x), 2)], [y[i:i + 2] for i in range(0, len(y), 2)]
    return 2 * _common(x, y) / (len(x) + len(y)) if x or y else 1.0


def _bounds(ids: DataFrame, buckets: int) -> np.ndarray:
    """Values that cut the ids into about equal runs; as many as buckets, so bounded by the partition count."""
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cut = ids.agg(F.percentile_approx("id", shares, 20 * buckets).alias("cuts")).first()["cuts"]
    return np.unique(np.array(cut or [], np.int64))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside the next one in descending id order, in one shuffle of the texts.

    Runs of ids form buckets, and the head of every bucket is also sent to the bucket before it (the head of all to
    the last one). Returns ``bucket, extra, id, text``, sorted inside partitions: the successor of a row is the row
    below it, and rows marked ``extra`` only follow. Null ids come last; rows of one id are ordered by a hash of their
    text; equal rows follow each other.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = max(2, 2 * partitions(spark))
    bounds = _bounds(docs.select("id"), count)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, ids, "right")
            order = np.lexsort((ids, bucket))
            last = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) if len(ids) else order
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][last].astype(np.int64)), pa.array(ids[order][last])], ["bucket", "id"])

    heads = (docs.select("id").mapInArrow(tops, "bucket long, id long").groupBy("bucket").agg(F.max("id").alias("id"))
             .orderBy("bucket").collect())  # one row per bucket
    above = {r["id"]: heads[(i + 1) % len(heads)]["bucket"] for i, r in enumerate(heads)}
    known, to = np.array(sorted(above), np.int64), np.array([above[k] for k in sorted(above)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            again = np.flatnonzero(known[at] == ids)
            rows = np.concatenate((np.arange(len(ids)), again))
            bucket = np.concatenate((np.searchsorted(bounds, ids, "right"), to[at[again]]))
            extra = np.arange(len(rows)) >= len(ids)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(extra), *taken.columns], ["bucket", "extra", *batch.schema.names])

    return (docs.mapInArrow(deal, "bucket long, extra boolean, given long, id long, text string")
            .repartition(count, "bucket").sortWithinPartitions("bucket", "extra", F.desc("id"), F.xxhash64("text")))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["given", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, extra, given, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "given", "text"))):
            if extra and (held is None or held[0] != bucket or held[1]):
                held = (bucket, True, None, "", "")
                continue
            mark = fingerprint(text.encode())
            if held is not None and held[0] == bucket and not held[1]:
                _, _, own, own_text, own_mark = held
                half = len(own_text) // 2
                edited = (own_text[:len(own_text) - half] + text[:half]).encode()
                edited_mark = fingerprint(edited)
                out.append((own, len(own_text), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark,
                            likeness(own_mark, edited_mark), likeness(own_mark, mark)))
            held = (bucket, extra, given, text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out))], names)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare it with that and with the next text.

    The edited text has its last ``floor(n/2)`` code points replaced by the first as many (or all) of the next text in
    descending id order; after the last comes the first. Null texts count as empty, null ids come last, one document
    is its own successor, no documents give no rows, other columns are ignored. Repeated rows give a row each.
    """
    found = neighbours(docs, id_col, text_col).mapInArrow(
        _compare, "given long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("given", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every text, without any shuffle."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.string())], ["id", "fingerprint"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(each, "id long, fingerprint string").withColumnRenamed("id", id_col)
