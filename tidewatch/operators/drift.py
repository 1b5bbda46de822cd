"""Population stability of features between a reference and live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import flag, psi_label, psi_status
from tidewatch.operators.ordered import quantiles
from tidewatch.operators.splits import hash_sample
from tidewatch.operators.thresholds import split_point
from tidewatch.session import materialise

SEVERITY = ["stable", "warning", "retrain", "emergency"]


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) for finite values of the columns that exist."""
    present = [f for f in features if f in df.columns]
    values = df.select(*[F.col(f).cast("double").alias(f) for f in present])
    v = F.col("value")
    return (values.unpivot([], present, "feature", "value")
            .filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def reference_edges(long_ref: DataFrame, bins: int = 10) -> DataFrame:
    """Per feature: quantile edges e0..e<bins>, or the two fixed bins of a 0/1 feature."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(long_ref, ["feature"], "value", probs, few_groups=True)
    kinds = long_ref.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_ref"), F.avg("value").alias("reference_mean"),
        (F.count_if(~F.col("value").isin(0.0, 1.0)) == 0).alias("binary"))
    fixed = {i: (-0.5 if i == 0 else 0.5 if i == 1 else 1.5) for i in range(bins + 1)}
    table = edges.join(kinds, "feature").withColumns(
        {f"e{i}": F.when(F.col("binary"), F.lit(fixed[i])).otherwise(F.col(f"e{i}")) for i in range(bins + 1)})
    # number of the last bin, which also takes values equal to the last edge
    last_bin = sum((flag(F.col(f"e{i}") < F.col(f"e{bins}")) for i in range(bins + 1)), F.lit(0.0))
    return table.withColumn("last_bin", last_bin)


def psi_table(reference: DataFrame, live: DataFrame, features: list[str] | None = None,
              bins: int = 10) -> DataFrame:
    """One row per feature: psi (null if undefined), both means, both counts.

    Bins come from edge columns and integer comparisons, so they stay in
    generated code.  The edge table has one row per feature, so broadcasting
    it is bounded by the length of the feature list.
    """
    names = features or S.MODEL_FEATURES
    spark = reference.sparkSession
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature")) for f in names])))
    long_ref, long_live = _long(reference, names), _long(live, names)
    edges = materialise(reference_edges(long_ref, bins), "psi-edges")
    both = (long_ref.withColumn("_live", F.lit(0)).unionByName(long_live.withColumn("_live", F.lit(1)))
            .join(F.broadcast(edges.drop("reference_mean", "n_ref", "binary")), "feature", "left"))
    v, last = F.col("value"), F.col(f"e{bins}")
    below = sum((flag(F.col(f"e{i}") <= v) for i in range(bins + 1)), F.lit(0.0))
    inside = (F.col("e0") < last) & (v >= F.col("e0")) & (v <= last)
    place = F.when(inside, F.when(v == last, F.col("last_bin")).otherwise(below))
    live_row = F.col("_live") == 1
    counts = both.groupBy("feature", place.alias("bin")).agg(
        F.count_if(~live_row).alias("c_ref"), F.count_if(live_row).alias("c_live"),
        F.sum(F.when(live_row, v)).alias("s_live"))
    # a feature has at most bins + 1 rows from here on
    whole = Window.partitionBy("feature")
    total = counts.withColumns({n: F.sum(c).over(whole) for n, c in
                                (("n_ref", "c_ref"), ("n_live", "c_live"), ("sum_live", "s_live"))})
    share = lambda c, n: F.greatest(F.col(c) / F.col(n), F.lit(S.PSI_FLOOR))
    a, e = share("c_live", "n_live"), share("c_ref", "n_ref")
    valid = F.col("bin").isNotNull() & (F.col("n_ref") > 0) & (F.col("n_live") > 0)
    known = lambda c: F.when(F.max(c) > 0, F.max(c))
    psi = total.groupBy("feature").agg(
        F.sum(F.when(valid, (a - e) * F.log(a / e))).alias("psi"), known("n_ref").alias("n_ref"),
        known("n_live").alias("n_live"), (F.max("sum_live") / known("n_live")).alias("live_mean"))
    return (F.broadcast(listed).join(psi, "feature", "left")
            .join(F.broadcast(edges.select("feature", "reference_mean")), "feature", "left")
            .select("feature", "psi", "reference_mean", "live_mean", "n_ref", "n_live"))


def with_status(psi: DataFrame) -> DataFrame:
    return psi.withColumn("status", psi_status("psi"))


def worst_status(psi: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    worst = with_status(psi).agg(F.max(rank).alias("_r"))
    return worst.select(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_r").cast("int")).alias("recommendation"))


def report(psi: DataFrame, live: DataFrame, bins: int = 10, min_rows_per_bin: int = 5) -> DataFrame:
    """One summary row; the alert compares features at or above the alert level with the valid ones."""
    extent = live.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("lo"),
                               F.max("bucket").alias("hi")).alias("e")).scalar()
    statuses = F.array(*[F.lit(s) for s in SEVERITY])
    graded = with_status(psi).agg(
        F.count("psi").alias("n_valid"), F.count_if(F.col("psi") >= S.SYSTEM_ALERT_PSI).alias("n_alert"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in SEVERITY],
        F.max(F.array_position(statuses, F.col("status"))).alias("_worst"))
    return graded.withColumn("_e", extent).select(
        F.col("_e.n").alias("live_rows"), F.col("_e.lo").alias("min_bucket"), F.col("_e.hi").alias("max_bucket"),
        (F.col("_e.n") / bins < min_rows_per_bin).alias("min_bins_warning"),
        F.element_at(statuses, F.col("_worst").cast("int")).alias("recommendation"),
        *[f"{s}_count" for s in SEVERITY], "n_valid", "n_alert",
        ((F.col("n_valid") > 0) & (F.col("n_alert") / F.greatest("n_valid", F.lit(1)) > S.SYSTEM_ALERT_SHARE))
        .alias("system_alert"))


def cross_domain(psi: DataFrame) -> DataFrame:
    """Labels for another fleet; a feature without any live value is missing."""
    present = F.col("n_live").isNotNull() & F.col("n_ref").isNotNull()
    return psi.select("feature", F.bround("psi", 4).alias("psi"), psi_label("psi", present).alias("interpretation"))


def reference_rows(features: DataFrame, fraction: float | None = None, ratio: float = S.TRAIN_RATIO) -> DataFrame:
    """Training buckets only; with ``fraction``, a repeatable share of their rows."""
    train = features.filter(F.col("bucket") <= split_point(features, ratio))
    return train if fraction is None else hash_sample(train, fraction)
