"""What is known about hosts and their items: freshness, coverage, retention, pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S

ACTIVE_HOURS, STALE_HOURS = 24, 168
LONG_GAP_SECONDS = 600
CHUNK_SECONDS = 30 * 86400


def interval_statistics(readings: DataFrame, host: str = "hostid", clock: str = "clock", newest: int | None = None,
                        chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Gap statistics over all readings of each host, or its ``newest`` ones.

    Gaps are taken within stretches of time, and between the last reading of
    a stretch and the first of the next, so a chatty host is many tasks.  With
    ``newest``, the row-number filter is a top-k per group, which Spark also
    applies before the shuffle.
    """
    rows = readings.select(host, clock).filter(F.col(host).isNotNull() & F.col(clock).isNotNull())
    if newest is not None:
        place = F.row_number().over(Window.partitionBy(host).orderBy(F.col(clock).desc()))
        rows = rows.withColumn("_r", place).filter(F.col("_r") <= newest).drop("_r")
    rows = rows.withColumn("_chunk", F.floor(F.col(clock) / chunk_seconds))
    gap = F.col(clock) - F.lag(clock).over(Window.partitionBy(host, "_chunk").orderBy(clock))
    parts = (rows.withColumn("gap", gap).groupBy(host, "_chunk")
             .agg(F.count(F.lit(1)).alias("n"), F.min(clock).alias("first"), F.max(clock).alias("last"), *_gap_sums()))
    between = F.col("first") - F.lag("last").over(Window.partitionBy(host).orderBy("_chunk"))
    joints = parts.select(host, F.lit(0).cast("long").alias("n"), between.alias("gap")).groupBy(host).agg(F.sum("n").alias("n"), *_gap_sums())
    whole = (parts.drop("_chunk", "first", "last").unionByName(joints).groupBy(host)
             .agg(F.sum("n").alias("n_readings"), *[F.sum(c).alias(c) for c in ("gaps", "total", "squares", "long_gaps")],
                  F.min("min_gap").alias("min_gap"), F.max("max_gap").alias("max_gap")))
    spread = F.col("squares") - F.col("total") * F.col("total") / F.col("gaps")
    return whole.filter(F.col("n_readings") >= 2).select(
        host, "n_readings", (F.col("total") / F.col("gaps")).alias("mean_gap"),
        F.when(F.col("gaps") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("gaps") - 1))).alias("std_gap"), "min_gap", "max_gap", "long_gaps")


def _gap_sums() -> list[Column]:
    gap = F.col("gap").cast("double")
    return [F.count("gap").alias("gaps"), F.sum(gap).alias("total"), F.sum(gap * gap).alias("squares"), F.min("gap").alias("min_gap"),
            F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > LONG_GAP_SECONDS).alias("long_gaps")]


def freshness(readings: DataFrame, now: Column, host: str = "hostid", clock: str = "clock") -> DataFrame:
    last = readings.groupBy(host).agg(F.max(clock).alias("last_clock"))
    age = (now - F.col("last_clock")) / 3600.0
    return last.select(host, "last_clock", F.when(age <= ACTIVE_HOURS, "active")
                       .when(age <= STALE_HOURS, "stale").otherwise("dead").alias("freshness"))


def key_coverage(catalog: DataFrame, host: str = "hostid") -> DataFrame:
    """Long matrix host x expected item: is any key of the host a match?"""
    has = {label: F.coalesce(F.max(F.lower("key_").contains(part.lower())), F.lit(False)).alias(label)
           for label, part in S.EXPECTED_ITEM_KEYS.items()}
    return catalog.groupBy(host).agg(*has.values()).unpivot([host], list(has), "item", "present")


def retention(readings: DataFrame, now: Column, host: str = "hostid", clock: str = "clock") -> DataFrame:
    oldest = readings.groupBy(host).agg(F.min(clock).alias("oldest"), F.max(clock).alias("newest"))
    return oldest.withColumn("days", F.floor((now - F.col("oldest")) / 86400).cast("long"))


def row_estimate(kept: DataFrame) -> DataFrame:
    """Training rows to expect: hosts times the shortest non-zero retention."""
    return kept.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.min(F.when(F.col("days") > 0, F.col("days"))).alias("shortest_days"),
        (F.count(F.lit(1)) * F.min(F.when(F.col("days") > 0, F.col("days"))) * S.SLOTS_PER_DAY).alias("row_estimate"))
