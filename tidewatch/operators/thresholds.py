"""Per-machine exceedance thresholds and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators.ordered import quantiles


def split_point(df: DataFrame, ratio: float, bucket: str = "bucket") -> Column:
    """Last bucket of the leading ``ratio`` of the time span, as a scalar subquery."""
    low, high = F.min(bucket), F.max(bucket)
    return df.agg((low + F.floor((high - low) * F.lit(ratio))).cast("long").alias("b")).scalar()


def repair(p95: Column, p99: Column) -> Column:
    """Keep the severe threshold at least a tenth above the moderate one."""
    lifted = F.when(p99 <= p95, p95 * F.lit(S.MIN_GAP_FACTOR)).otherwise(p99)
    return F.when(lifted < p95 * F.lit(S.MIN_GAP_FACTOR), p95 * F.lit(S.MIN_GAP_FACTOR)).otherwise(lifted)


def raw_quantiles(df: DataFrame, keys: list[str], value: str = "total_cpu") -> DataFrame:
    return quantiles(df, keys, value, {"p95": 0.95, "p99": 0.99})


def _with_fallback(own: DataFrame, everyone: DataFrame, overall: DataFrame, key: str) -> DataFrame:
    both = overall.select(F.struct("p95", "p99").alias("g")).scalar()
    filled = (everyone.join(own, key, "left")
              .withColumn("_g", both)
              .withColumn("p95f", F.coalesce("p95", F.col("_g.p95")))
              .withColumn("p99f", F.coalesce("p99", F.col("_g.p99"))))
    return filled.select(key, F.col("p95f").alias("threshold_p95"),
                         repair(F.col("p95f"), F.col("p99f")).alias("threshold_p99"))


def learn(agg: DataFrame, train_last: Column, key: str = "machine_id",
          value: str = "total_cpu") -> DataFrame:
    """Quantiles of the training buckets; unseen machines get the overall ones."""
    train = agg.filter(F.col("bucket") <= train_last)
    return _with_fallback(raw_quantiles(train, [key], value), agg.select(key).distinct(),
                          raw_quantiles(train, [], value), key)


def bootstrap(agg: DataFrame, min_buckets: int = S.BOOTSTRAP_MIN_BUCKETS,
              key: str = "machine_id", value: str = "total_cpu") -> DataFrame:
    """Thresholds for a new fleet: machines with little history use the overall ones."""
    depth = bucket_depth(agg, key)
    rich = depth.filter(F.col("n_buckets") >= min_buckets).select(key)
    own = raw_quantiles(agg, [key], value).join(rich, key, "left_semi")
    return _with_fallback(own, depth.select(key), raw_quantiles(agg, [], value), key)


def bucket_depth(agg: DataFrame, key: str = "machine_id") -> DataFrame:
    """Distinct buckets per machine, as two aggregations so hot machines combine early."""
    return (agg.groupBy(key, "bucket").agg(F.lit(1).alias("_x"))
            .groupBy(key).agg(F.count(F.lit(1)).alias("n_buckets")))


def bootstrap_audit(agg: DataFrame, min_buckets: int = S.BOOTSTRAP_MIN_BUCKETS) -> DataFrame:
    depth = bucket_depth(agg).agg(
        F.count(F.lit(1)).alias("n_machines_total"),
        F.count_if(F.col("n_buckets") >= min_buckets).alias("n_machines_with_per_machine"),
        F.count_if(F.col("n_buckets") < min_buckets).alias("n_machines_with_global_fallback"))
    overall = raw_quantiles(agg, [], "total_cpu").select(F.struct("p95", "p99").alias("g")).scalar()
    extent = agg.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("lo"),
                              F.max("bucket").alias("hi")).alias("e")).scalar()
    return (depth.withColumn("_g", overall).withColumn("_e", extent)
            .select(F.col("_e.n").alias("rows_in"), F.col("_e.lo").alias("min_bucket"),
                    F.col("_e.hi").alias("max_bucket"), "n_machines_total",
                    "n_machines_with_per_machine", "n_machines_with_global_fallback",
                    F.col("_g.p95").alias("global_p95"), F.col("_g.p99").alias("global_p99")))


def fallback_medians(thresholds: DataFrame) -> DataFrame:
    """One row: the medians of both threshold columns."""
    names = ["threshold_p95", "threshold_p99"]
    long = thresholds.select(*names).unpivot([], names, "which", "value")
    mid = quantiles(long, ["which"], "value", {"m": 0.5}, few_groups=True)
    pick = lambda n: F.max(F.when(F.col("which") == n, F.col("m")))
    return mid.agg(pick(names[0]).alias("median_p95"), pick(names[1]).alias("median_p99"))


def attach(df: DataFrame, thresholds: DataFrame, key: str = "machine_id",
           fallback: DataFrame | None = None) -> DataFrame:
    """Join thresholds; machines without any get the fleet fallback, and say so.

    The threshold table has a row per machine, so whether it is small enough
    to broadcast is left to the runtime size check of adaptive execution.
    """
    spare = (fallback if fallback is not None else fallback_medians(thresholds)).toDF("f95", "f99")
    pair = spare.select(F.struct("f95", "f99").alias("f")).scalar()
    known = thresholds.select(key, F.col("threshold_p95").alias("_t95"), F.col("threshold_p99").alias("_t99"))
    return (df.join(known, key, "left").withColumn("_f", pair)
            .withColumn("threshold_source", F.when(F.col("_t95").isNull(), "global_fallback").otherwise("learned"))
            .withColumn("threshold_p95", F.coalesce("_t95", F.col("_f.f95")))
            .withColumn("threshold_p99", F.coalesce("_t99", F.col("_f.f99")))
            .drop("_t95", "_t99", "_f"))


def unknown_machines(incoming: DataFrame, known: DataFrame, key: str = "machine_id") -> DataFrame:
    return (incoming.join(known.select(key), key, "left_anti")
            .groupBy(key).agg(F.count(F.lit(1)).alias("rows_in")))
