"""Chronological splits, walk-forward folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators.chunks import CHUNK, row_chunks
from tidewatch.operators.ordered import amount_before
from tidewatch.operators.thresholds import split_point


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is known, the label as a small integer."""
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def chronological(df: DataFrame, train: float = S.TRAIN_RATIO, val: float = S.VAL_RATIO,
                  bucket: str = "bucket") -> DataFrame:
    """Add ``split``: train, val or test by time, anchored at the first bucket."""
    first, second = split_point(df, train, bucket), split_point(df, train + val, bucket)
    b = F.col(bucket)
    return df.withColumn("split", F.when(b <= first, "train").when(b <= second, "val").otherwise("test"))


def inner_tuning(train: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Halve the training range in time for parameter search."""
    return train.withColumn("inner_split",
                            F.when(F.col(bucket) <= split_point(train, 0.5, bucket), "fit").otherwise("tune"))


def walk_forward(df: DataFrame, folds: int = 5, gap: int = S.HORIZON, by: str = "bucket",
                 keys: tuple[str, ...] = ("machine_id", "bucket")) -> DataFrame:
    """One copy of each row per fold it serves in, with ``fold`` and ``role``.

    ``by="bucket"`` expands over time.  ``by="row"`` numbers rows in key order,
    as a plain time-series splitter on a machine-sorted table would.
    """
    if by == "bucket":
        extent = df.agg(F.struct(F.min("bucket").alias("lo"),
                                 (F.max("bucket") - F.min("bucket") + 1).alias("n")).alias("e")).scalar()
        placed = df.withColumn("_e", extent).withColumn("_at", F.col("bucket") - F.col("_e.lo"))
    else:
        counts = df.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("_c"))
        base = amount_before(counts, [keys[0]], F.col("_c"), "_base").select(keys[0], "_base")
        numbered = row_chunks(df, key=keys[0], order=keys[1], back=0).filter("_own")
        total = df.agg(F.struct(F.count(F.lit(1)).alias("n")).alias("e")).scalar()
        placed = (numbered.join(base, keys[0]).withColumn("_e", total)
                  .withColumn("_at", F.col("_base") + F.col("pos"))
                  .drop("pos", "_base", "series_rows", CHUNK, "_own", "_step"))
    size = F.floor(F.col("_e.n") / (folds + 1))
    entries = []
    for f in range(1, folds + 1):
        start = F.col("_e.n") - size * (folds - f + 1)
        role = (F.when(F.col("_at") < start - gap, "train")
                .when((F.col("_at") >= start) & (F.col("_at") < start + size), "test"))
        entries.append(F.struct(F.lit(f).alias("fold"), role.alias("role")))
    return (placed.withColumn("_f", F.explode(F.array(*entries)))
            .select(*df.columns, "_f.fold", "_f.role").filter(F.col("role").isNotNull()))


def draw(keys: tuple[str, ...] = ("machine_id", "bucket"), seed: int = 42) -> Column:
    """A number in [0, 1) from an md5 of the row's key: the same on every run and for every partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def seeded_sample(df: DataFrame, fraction: float, seed: int = 42, keys: tuple[str, ...] = ("machine_id", "bucket")) -> DataFrame:
    return df.filter(draw(keys, seed) < fraction)


def hash_sample(df: DataFrame, fraction: float, keys: tuple[str, ...] = ("machine_id", "bucket")) -> DataFrame:
    """Same rows on every run, whatever the partitioning."""
    slots = 1_000_000
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(slots)) < int(fraction * slots))


def row_cap(df: DataFrame, cap: int, keys: tuple[str, ...] = ("machine_id", "bucket")) -> DataFrame:
    """At most ``cap`` rows, chosen by the order of their draws (a top-k, not a full sort)."""
    return df.orderBy(draw(keys), *keys).limit(cap)


def machine_sample(df: DataFrame, machines: int, key: str = "machine_id") -> DataFrame:
    chosen = df.select(key).distinct().orderBy(draw((key,)), key).limit(machines)
    return df.join(chosen, key, "left_semi")
