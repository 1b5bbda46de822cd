"""Per-machine load profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import flag
from tidewatch.operators import chunks
from tidewatch.operators.ordered import quantiles

EPS = 1e-9
BUSINESS_SLOTS = (108, 216)
WARN_IDLE_SHARE, WARN_BUSINESS_RATIO, WARN_SPREAD = 0.40, 3.0, 0.02


def moments(agg: DataFrame, key: str = "machine_id", value: str = "total_cpu") -> DataFrame:
    """Size, mean, population deviation and upper quantiles per machine."""
    sums = agg.groupBy(key).agg(F.count(F.lit(1)).alias("n_buckets"), F.avg(value).alias("mean_cpu"),
                                F.stddev_pop(value).alias("std_cpu"))
    return sums.join(quantiles(agg, [key], value, {"p95_cpu": 0.95, "p99_cpu": 0.99}), key)


def shape(stats: DataFrame) -> DataFrame:
    mean, std = F.col("mean_cpu"), F.col("std_cpu")
    return stats.withColumns({
        "burstiness": (std - mean) / (std + mean + EPS),
        "peak_to_mean": F.col("p99_cpu") / (mean + EPS),
        "cv": std / (mean + EPS)})


def idle_fraction(agg: DataFrame, stats: DataFrame, key: str = "machine_id", value: str = "total_cpu") -> DataFrame:
    floor = F.greatest(F.lit(0.01), F.col("mean_cpu") * 0.05)
    return (agg.join(stats.select(key, "mean_cpu"), key)
            .groupBy(key).agg(F.avg(flag(F.col(value) < floor)).alias("idle_fraction")))


def business_ratio(agg: DataFrame, slots: int = S.SLOTS_PER_DAY, key: str = "machine_id",
                   value: str = "total_cpu") -> DataFrame:
    slot = F.pmod(F.col("bucket"), F.lit(slots))
    low, high = (s * slots // S.SLOTS_PER_DAY for s in BUSINESS_SLOTS)
    busy = (slot >= low) & (slot < high)
    means = agg.groupBy(key).agg(F.avg(F.when(busy, F.col(value))).alias("on"),
                                 F.avg(F.when(~busy, F.col(value))).alias("off"))
    return means.select(key, F.coalesce(F.col("on") / (F.col("off") + EPS), F.lit(1.0)).alias("biz_ratio"))


def _stepped(agg: DataFrame, stats: DataFrame, back: int, key: str, value: str) -> DataFrame:
    rows = agg.select(key, "bucket", value).join(stats.select(key, "p95_cpu"), key)
    return chunks.row_chunks(rows, key=key, back=back)


def episodes(agg: DataFrame, stats: DataFrame, key: str = "machine_id", value: str = "total_cpu") -> DataFrame:
    """Share of rows above the machine's own p95, and the mean length of such runs.

    The mean run length is rows above divided by run starts, so only the
    previous row is needed, never a whole run.
    """
    rows = _stepped(agg, stats, 1, key, value).withColumn("_above", flag(F.col(value) > F.col("p95_cpu")))
    w = chunks.series_window(key, "pos")
    starts = rows.withColumn("_start", flag((F.col("_above") == 1) & (F.coalesce(F.lag("_above").over(w), F.lit(0.0)) == 0)))
    return (starts.filter("_own").groupBy(key)
            .agg(F.avg("_above").alias("spike_rate"), F.sum("_above").alias("_rows"), F.sum("_start").alias("_runs"))
            .select(key, "spike_rate", F.when(F.col("_runs") > 0, F.col("_rows") / F.col("_runs"))
                    .otherwise(0.0).alias("mean_ep_len")))


def autocorrelation(agg: DataFrame, lags=(1, 12), key: str = "machine_id", value: str = "total_cpu") -> DataFrame:
    """Sample covariance of the lagged pairs over the population variance; rows as stored."""
    rows = chunks.row_chunks(agg.select(key, "bucket", value), key=key, back=max(lags))
    w = chunks.series_window(key, "pos")
    paired = rows.withColumns({f"_x{k}": F.lag(value, k).over(w) for k in lags}).filter("_own")
    sums = paired.groupBy(key).agg(
        F.var_pop(value).alias("_var"), F.count(F.lit(1)).alias("_n"),
        *[F.covar_samp(f"_x{k}", value).alias(f"_c{k}") for k in lags])
    acf = lambda k: F.when(F.col("_n") <= k, F.lit(None)) \
        .when(F.col("_var") < 1e-12, 0.0).otherwise(F.col(f"_c{k}") / F.col("_var"))
    return sums.select(key, *[acf(k).alias(f"acf_lag{k}") for k in lags])


def node_profile(agg: DataFrame, slots: int = S.SLOTS_PER_DAY, key: str = "machine_id") -> DataFrame:
    """One row per machine with every profile figure."""
    stats = moments(agg, key)
    return (shape(stats).join(idle_fraction(agg, stats, key), key).join(business_ratio(agg, slots, key), key)
            .join(autocorrelation(agg, key=key), key).join(episodes(agg, stats, key), key))


def warnings(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count(F.lit(1)).alias("n_machines"),
        F.count_if(F.col("idle_fraction") > WARN_IDLE_SHARE).alias("idle_machines"),
        F.count_if(F.col("biz_ratio") > WARN_BUSINESS_RATIO).alias("business_machines"),
        F.stddev_pop("spike_rate").alias("spike_rate_std")).withColumn(
        "similar_machines", (F.col("n_machines") >= 2) & (F.col("spike_rate_std") < WARN_SPREAD))


def run_lengths(rows: DataFrame, condition: Column, output: str, key: str = "machine_id",
                order: str = "bucket") -> DataFrame:
    """Length of the unbroken run of ``condition`` that ends at each row (0 if false).

    Runs may cross any number of chunks: the last row that broke a run in
    earlier chunks comes from a table with one row per chunk.
    """
    numbered = chunks.row_chunks(rows.withColumn("_hit", F.coalesce(condition, F.lit(False))),
                                 key=key, order=order, back=0)
    broken = F.when(~F.col("_hit"), F.col("pos"))
    per_chunk = numbered.groupBy(key, chunks.CHUNK).agg(F.max(broken).alias("_b"))
    earlier = Window.partitionBy(key).orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, chunks.CHUNK, F.max("_b").over(earlier).alias("_carry"))
    inside = chunks.series_window(key, "pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(broken).over(inside), F.col("_carry"), F.lit(-1))
    joined = numbered.join(carry, [key, chunks.CHUNK])
    return joined.select(*rows.columns, (F.col("pos") - last).alias(output))
