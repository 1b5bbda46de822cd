"""The feature plan, shared by training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import cross, series, thresholds
from tidewatch.session import materialise

IDS = ["machine_id", "bucket", "time_us"]


def build(agg: DataFrame, limits: DataFrame, train_last: Column | None, *, bucket_seconds: int = S.BUCKET_SECONDS,
          slots: int = S.SLOTS_PER_DAY, horizon: int = S.HORIZON, at_least: int = 1,
          labels: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features (and labels) for every measured bucket.

    The cross-section is joined to the narrow rows first and written as a stage
    table; the wide result of the series stage is never shuffled again.
    """
    rows = materialise(cross.cross_section(agg, train_last), "cross-section")
    chunked = series.measured_series(rows, limits, extra=("cluster_cpu_p90", "machine_rank_in_cluster", *keep),
                                     horizon=horizon)
    done = series.observed_rows(series.measured_features(chunked, slots, labels=labels, horizon=horizon, at_least=at_least))
    time_us = (F.col("bucket") * F.lit(bucket_seconds * 1_000_000)).alias("time_us")
    columns = [F.col(f).cast("long" if f == "n_tasks" else "double").alias(f) for f in S.MODEL_FEATURES]
    return done.select("machine_id", "bucket", time_us, *columns, *(S.LABELS if labels else []),
                       *[k for k in keep if k not in S.MODEL_FEATURES])


def train(agg: DataFrame, ratio: float = S.TRAIN_RATIO, **options) -> DataFrame:
    """Thresholds from the leading part of the time span, then the feature plan."""
    last = thresholds.split_point(agg, ratio)
    return build(agg, materialise(thresholds.learn(agg, last), "thresholds"), last, **options)
