"""Series windows that never need a whole machine in one task.

Every per-machine operator looks a bounded number of rows back or ahead.  So a
series is cut into chunks, each chunk also receives a copy of the few rows
before and after it (its halo), and windows run per (machine, chunk).  One
machine with a third of all rows then spreads over many tasks, at the cost of
a few percent of duplicated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
CHUNK_BUCKETS = 8192
_MAX_EXPONENT = 1700      # doubles span 2**-1022 .. 2**1023


def series_window(key: str = "machine_id", order: str = "bucket"):
    return Window.partitionBy(key, CHUNK).orderBy(order)


def decay_reach(per_step: float) -> int:
    """Rows after which a geometric weight is below half an ulp of a double."""
    return int(math.ceil(60.0 / -math.log2(per_step)))


def decay_chunks(per_step: float, wanted: int) -> tuple[int, int]:
    """Chunk size (``wanted``, or what the decay needs or allows) and halo for a decay."""
    back = decay_reach(per_step)
    return min(max(wanted, 4 * back), int(_MAX_EXPONENT / -math.log2(per_step)) - back - 1), back


def halo_copies(position: Column, size: int, back: int, ahead: int) -> Column:
    """Chunk numbers a row belongs to: its own and the neighbours whose halo it is in."""
    home = F.floor(position / F.lit(size)).cast("long")
    offset = position - home * F.lit(size)
    return F.explode(F.array_compact(F.array(
        home,
        F.when(offset >= F.lit(size - back), home + 1),
        F.when(offset < F.lit(ahead), home - 1))))


def span_per_key(df: DataFrame, key: str = "machine_id", bucket: str = "bucket") -> DataFrame:
    return df.groupBy(key).agg(F.min(bucket).alias("first_bucket"), F.max(bucket).alias("last_bucket"))


def gap_fill(observed: DataFrame, per_key: DataFrame, *, key: str = "machine_id",
             bucket: str = "bucket", signals: list[str], carried: tuple[str, ...] = (),
             back: int, ahead: int, size: int = CHUNK_BUCKETS) -> DataFrame:
    """Dense series per key with missing buckets set to zero, chunked with halo.

    ``per_key`` has one row per key: ``first_bucket``, ``last_bucket`` and the
    ``carried`` columns, which reach every row without a join on the big side.
    Each (key, chunk) gets a start and an end marker; every row then emits
    itself and the empty buckets up to the next row, so one shuffle does it.
    Halo copies for a chunk that the key does not reach find no start marker
    and go before any gap is filled.  ``_first`` marks the first row of a chunk.
    """
    if back > size or ahead > size:
        raise ValueError("halo larger than a chunk")
    edges = per_key.select(
        key, *carried, "first_bucket", "last_bucket",
        F.explode(F.sequence(F.floor(F.col("first_bucket") / size).cast("long"),
                             F.floor(F.col("last_bucket") / size).cast("long"))).alias(CHUNK))
    start = F.greatest(F.col("first_bucket"), F.col(CHUNK) * size - back)
    stop = F.least(F.col("last_bucket"), F.col(CHUNK) * size + (size - 1 + ahead)) + 1
    markers = edges.select(
        key, *carried, CHUNK,
        F.inline(F.array(F.struct(start.alias(bucket), F.lit(0).alias("_kind")),
                         F.struct(stop.alias(bucket), F.lit(2).alias("_kind")))))
    rows = observed.select(key, bucket, *signals, halo_copies(F.col(bucket), size, back, ahead).alias(CHUNK),
                           F.lit(1).alias("_kind"))
    merged = rows.unionByName(markers, allowMissingColumns=True)
    w = Window.partitionBy(key, CHUNK).orderBy(bucket, "_kind")
    begin = w.rowsBetween(Window.unboundedPreceding, 0)
    stepped = merged.select(
        key, CHUNK, bucket, "_kind", *signals,
        *[F.first(c).over(begin).alias(c) for c in carried],
        F.first("_kind").over(begin).alias("_opened"), F.first(bucket).over(begin).alias("_start"),
        F.lead(bucket).over(w).alias("_next")).filter((F.col("_opened") == 0) & (F.col("_next") > F.col(bucket)))
    filled = stepped.select(
        key, CHUNK, F.col(bucket).alias("_from"), "_kind", "_start", *signals, *carried,
        F.explode(F.sequence(F.col(bucket), F.col("_next") - 1)).alias(bucket))
    real = (F.col("_kind") == 1) & (F.col("_from") == F.col(bucket))
    return filled.select(
        key, bucket, CHUNK, *carried,
        *[F.when(real, F.col(s)).otherwise(F.lit(0)).alias(s) for s in signals],
        real.alias("observed"),
        (F.floor(F.col(bucket) / size) == F.col(CHUNK)).alias("_own"),
        (F.col(bucket) == F.col("_start")).alias("_first"),
        (F.col(bucket) - F.col(CHUNK) * size).alias("_step"))


def measured(observed: DataFrame, per_key: DataFrame, *, key: str = "machine_id",
             bucket: str = "bucket", signals: list[str], carried: tuple[str, ...] = (),
             back: int, ahead: int, size: int = CHUNK_BUCKETS) -> DataFrame:
    """The measured rows of ``gap_fill`` alone, chunked with halo, for windows over ranges of buckets.

    ``_start`` is the first bucket that the chunk sees, ``_last`` the last one of
    the series.  Every (key, chunk) has a marker row, not ``observed``, a whole
    chunk before its start; look-back ranges must be shorter than that.
    """
    if back > size or ahead > size:
        raise ValueError("halo larger than a chunk")
    start = F.greatest(F.col("first_bucket"), F.col(CHUNK) * size - back)
    markers = per_key.select(
        key, *carried, "first_bucket", F.col("last_bucket").alias("_last"),
        F.explode(F.sequence(F.floor(F.col("first_bucket") / size).cast("long"),
                             F.floor(F.col("last_bucket") / size).cast("long"))).alias(CHUNK)).select(
        key, *carried, CHUNK, start.alias("_start"), "_last", (start - size).alias(bucket), F.lit(False).alias("observed"))
    rows = observed.select(key, bucket, *signals, halo_copies(F.col(bucket), size, back, ahead).alias(CHUNK),
                           F.lit(True).alias("observed"))
    w = Window.partitionBy(key, CHUNK).orderBy(bucket)
    begin = w.rowsBetween(Window.unboundedPreceding, 0)
    told = rows.unionByName(markers, allowMissingColumns=True).select(
        key, CHUNK, bucket, "observed", *signals,
        *[F.first(c).over(begin).alias(c) for c in (*carried, "_start", "_last")],
        F.lead(bucket).over(w).alias("_next"))
    # no marker: the key does not reach the chunk; of rows with an equal bucket one stays, as in ``gap_fill``
    once = told.filter(F.col("_start").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col(bucket)))).drop("_next")
    return once.withColumns({
        "_own": F.col("observed") & (F.floor(F.col(bucket) / size) == F.col(CHUNK)),
        "_first": F.col("observed") & (F.col(bucket) == F.col("_start")),
        "_step": F.col(bucket) - F.col(CHUNK) * size})


def row_chunks(df: DataFrame, *, key: str = "machine_id", order: str = "bucket",
               back: int, ahead: int = 0, size: int = 4096, span: int = CHUNK_BUCKETS) -> DataFrame:
    """Number the rows of each key (from 0) and chunk them by that number, with halo.

    ``(key, order)`` is unique.  Positions come from counts per time span, so
    no task sees more than one span of one key.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / span).cast("long"))
    counts = spans.groupBy(key, "_span").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        key, "_span",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("series_rows"))
    inside = Window.partitionBy(key, "_span").orderBy(order)
    numbered = (spans.join(base, [key, "_span"])
                .withColumn("pos", F.col("_base") + F.row_number().over(inside) - 1)
                .drop("_span", "_base"))
    return (numbered.select("*", halo_copies(F.col("pos"), size, back, ahead).alias(CHUNK))
            .withColumn("_own", F.floor(F.col("pos") / size) == F.col(CHUNK))
            .withColumn("_step", F.col("pos") - F.col(CHUNK) * size))


def owned(df: DataFrame) -> DataFrame:
    helpers = [c for c in (CHUNK, "_own", "_first", "_step", "_start", "_last") if c in df.columns]
    return df.filter("_own").drop(*helpers)


def decayed_mean(df: DataFrame, value: str, per_step: float, output: str, *,
                 key: str = "machine_id", order: str = "bucket", size: int,
                 back: int) -> DataFrame:
    """Recursive exponential mean: y = d*y + (1-d)*x, started with the first value.

    Written as a running sum of values scaled by powers of the decay at the row
    position in the chunk; the halo covers everything the weights can see.
    Null values are skipped at the front only.
    """
    rate = -math.log2(per_step)
    if (size + back) * rate > _MAX_EXPONENT or decay_reach(per_step) > back:
        raise ValueError("chunk or halo does not fit this decay")
    place = F.col("_step") - F.lit((size - back) // 2)
    w = series_window(key, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(value).isNotNull()
    first = known & (F.sum(known.cast("int")).over(run) == 1)
    lead_in = df.withColumn("_first", first)
    weight = F.when(F.col("_first"), F.lit(1.0)).otherwise(F.lit(1.0 - per_step))
    scaled = F.col(value) * weight * F.pow(F.lit(per_step), -place)
    return (lead_in.withColumn(output, F.sum(scaled).over(run) * F.pow(F.lit(per_step), place))
            .drop("_first"))
