"""Comparison of machines within one bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import average_rank, collapse, quantiles, running_totals


def rank_in_bucket(agg: DataFrame, value: str = "total_cpu") -> DataFrame:
    return average_rank(agg, ["bucket"], value, "machine_rank_in_cluster")


def bucket_p90(agg: DataFrame, train_last: Column | None = None, value: str = "total_cpu") -> DataFrame:
    train = agg if train_last is None else agg.filter(F.col("bucket") <= train_last)
    return quantiles(train, ["bucket"], value, {"cluster_cpu_p90": 0.9})


def overall_p90(agg: DataFrame, train_last: Column | None = None, value: str = "total_cpu") -> Column:
    train = agg if train_last is None else agg.filter(F.col("bucket") <= train_last)
    return quantiles(train, [], value, {"p90": 0.9}).scalar()


def attach_p90(agg: DataFrame, train_last: Column | None = None, value: str = "total_cpu") -> DataFrame:
    per_bucket = bucket_p90(agg, train_last, value)
    return (agg.join(per_bucket, "bucket", "left")
            .withColumn("cluster_cpu_p90",
                        F.coalesce("cluster_cpu_p90", overall_p90(agg, train_last, value))))


def cross_section(agg: DataFrame, train_last: Column | None = None, value: str = "total_cpu") -> DataFrame:
    """Rank and p90 for every row from one collapse of (bucket, value).

    Runs on the narrow input rows, before the series stage widens them.
    """
    placed = running_totals(collapse(agg, ["bucket"], value), ["bucket"], value, ["rows_at"])
    n, through = F.col("all_rows_at"), F.col("through_rows_at")
    place = F.lit(0.9) * (n - 1)
    at = lambda rank: F.min(F.when(through > rank, F.col(value)))
    in_training = placed if train_last is None else placed.filter(F.col("bucket") <= train_last)
    p90 = (in_training.groupBy("bucket")
           .agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.max("all_rows_at").alias("_n"))
           .select("bucket", (F.col("_lo") + (F.col("_hi") - F.col("_lo"))
                              * (F.lit(0.9) * (F.col("_n") - 1) - F.floor(F.lit(0.9) * (F.col("_n") - 1))))
                   .alias("cluster_cpu_p90")))
    ranks = placed.select("bucket", value, ((through - (F.col("rows_at") - 1) / 2.0) / n)
                          .alias("machine_rank_in_cluster"))
    return (agg.join(ranks, ["bucket", value], "left").join(p90, "bucket", "left")
            .withColumn("cluster_cpu_p90",
                        F.coalesce("cluster_cpu_p90", overall_p90(agg, train_last, value))))
