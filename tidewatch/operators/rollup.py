"""Reduce raw readings to one row per machine and bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import bucket_of, bucket_start, clamp, half_even


def usable_tasks(tasks: DataFrame) -> DataFrame:
    """Drop unattributed rows, empty durations and impossible rates."""
    return tasks.filter(
        F.col("machine_id").isNotNull()
        & (F.col("end_time") > F.col("start_time"))
        & (F.col("cpu_rate") <= F.lit(S.MAX_CPU_RATE)))


def drop_audit(tasks: DataFrame) -> DataFrame:
    """How many rows each filter removes when applied in order."""
    no_machine = F.col("machine_id").isNull()
    # a null time never satisfies the comparison that drops, but fails later ones
    bad_time = ~no_machine & F.coalesce(F.col("end_time") <= F.col("start_time"), F.lit(False))
    kept = F.col("machine_id").isNotNull() & ~bad_time
    bad_rate = kept & ~F.coalesce(F.col("cpu_rate") <= S.MAX_CPU_RATE, F.lit(False))
    return tasks.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(no_machine).alias("null_machine"),
        F.count_if(bad_time).alias("bad_duration"),
        F.count_if(bad_rate).alias("bad_rate"),
        F.count_if(kept & ~bad_rate).alias("rows_out"))


#: Task records that one task's aggregation of partial rollups is planned for.
PART_ROWS = 1_000_000


def parts_for(tasks: DataFrame) -> int:
    """How many parts partial rollups that are merged later should be dealt into: the usual number, more for more records."""
    return max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tasks.count() // PART_ROWS))


def partial_rollup(tasks: DataFrame, bucket_seconds: int = S.BUCKET_SECONDS, parts: int | None = None) -> DataFrame:
    """Mergeable sums and maxima per machine and bucket.

    With ``parts``, records are dealt into so many parts by machine and bucket. Rollups with equal ``parts`` are merged where
    they are, and what a task holds grows with the records in a part, not with all of them.
    """
    keyed = (usable_tasks(tasks)
             .withColumn("bucket", bucket_of("start_time", bucket_seconds))
             .withColumn("machine_id", F.col("machine_id").cast("long")))
    if parts is not None:
        keyed = keyed.repartition(parts, "machine_id", "bucket")
    return (keyed.groupBy("machine_id", "bucket")
            .agg(F.sum(F.col("cpu_rate") * (F.col("end_time") - F.col("start_time"))).alias("cpu_time"),
                 F.max("max_cpu_rate").alias("peak_cpu"),
                 F.sum("canonical_mem_usage").alias("total_mem"),
                 F.max("max_mem_usage").alias("peak_mem"),
                 F.max("mean_disk_io_time").alias("disk_io"),
                 F.count("cpu_rate").alias("n_tasks")))


def finish_rollup(partials: DataFrame, bucket_seconds: int = S.BUCKET_SECONDS) -> DataFrame:
    width = float(bucket_seconds * 1_000_000)
    return partials.select(
        "machine_id", "bucket", bucket_start("bucket", bucket_seconds).alias("time_us"),
        (F.col("cpu_time") / F.lit(width)).alias("total_cpu"),
        "peak_cpu", "total_mem", "peak_mem", "disk_io", "n_tasks")


def rollup(tasks: DataFrame, bucket_seconds: int = S.BUCKET_SECONDS) -> DataFrame:
    return finish_rollup(partial_rollup(tasks, bucket_seconds), bucket_seconds)


def merge_partials(parts: DataFrame) -> DataFrame:
    """Second pass over partial rollups from separate batches."""
    return parts.groupBy("machine_id", "bucket").agg(
        F.sum("cpu_time").alias("cpu_time"),
        F.max("peak_cpu").alias("peak_cpu"),
        F.sum("total_mem").alias("total_mem"),
        F.max("peak_mem").alias("peak_mem"),
        F.max("disk_io").alias("disk_io"),
        F.sum("n_tasks").alias("n_tasks"))


def item_rollup(readings: DataFrame, bucket_seconds: int = S.BUCKET_SECONDS) -> DataFrame:
    """Mean per kind of reading; buckets without CPU vanish, other gaps get 0/0/1.

    ``readings``: machine_id, kind (cpu, mem, disk, load), clock seconds, value.
    """
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("value")))
    return (readings.withColumn("bucket", F.floor(F.col("clock") / bucket_seconds).cast("long"))
            .groupBy("machine_id", "bucket")
            .agg(mean("cpu").alias("cpu_pct"),
                 F.coalesce(mean("mem"), F.lit(0.0)).alias("mem_pct"),
                 F.coalesce(mean("disk"), F.lit(0.0)).alias("disk_pct"),
                 F.coalesce(mean("load"), F.lit(1.0)).alias("load_avg"))
            .filter(F.col("cpu_pct").isNotNull()))


def percent_to_units(rolled: DataFrame, cores: str | Column = "n_cores",
                     bucket_seconds: int = S.BUCKET_SECONDS) -> DataFrame:
    """Percent readings to core and capacity fractions in the aggregate schema."""
    n = F.col(cores) if isinstance(cores, str) else cores
    cpu = F.least(F.greatest(F.col("cpu_pct") / 100.0 * n, F.lit(0.0)), n.cast("double"))
    mem = clamp(F.col("mem_pct") / 100.0, 0.0, 1.0)
    return rolled.select(
        "machine_id", "bucket", bucket_start("bucket", bucket_seconds).alias("time_us"),
        cpu.alias("total_cpu"), cpu.alias("peak_cpu"), mem.alias("total_mem"), mem.alias("peak_mem"),
        clamp(F.col("disk_pct") / 100.0, 0.0, 1.0).alias("disk_io"),
        F.greatest(F.lit(1), half_even("load_avg").cast("long")).alias("n_tasks"))


def merge_duplicate_buckets(rows: DataFrame) -> DataFrame:
    """Unweighted mean of rows that share machine and bucket; earliest time kept."""
    return rows.groupBy("machine_id", "bucket").agg(
        F.min("time_us").alias("time_us"),
        *[F.avg(s).alias(s) for s in S.SIGNALS],
        F.greatest(F.lit(1), half_even(F.avg("n_tasks")).cast("long")).alias("n_tasks"))


def latest_item(catalog: DataFrame, pattern: str, host: str = "hostid") -> DataFrame:
    """Most recently active item per host whose key contains ``pattern``."""
    recency = F.struct(F.coalesce(F.col("lastclock"), F.lit(0)), -F.col("itemid"))
    return (catalog.filter(F.col("key_").contains(pattern))
            .groupBy(host)
            .agg(F.max_by(F.struct("itemid", "key_", "lastclock", "lastvalue"), recency).alias("i"))
            .select(host, "i.*"))
