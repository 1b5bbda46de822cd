"""Queries over thresholds, series features, labels and the cross-section."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import chunks, cross, series, thresholds
from tidewatch.plans import features, fixtures as fx
from tidewatch.plans.registry import block, query, sql
from tidewatch.session import materialise

_REAL_FEATURES = " ".join(c for c in S.MODEL_FEATURES if c != "n_tasks")
_ALL = ", ".join([*features.IDS, *S.MODEL_FEATURES, *S.LABELS])


def _learned(spark, sf):
    agg = fx.agg_table(spark, sf)
    last = thresholds.split_point(agg, S.TRAIN_RATIO)
    return agg, last, materialise(thresholds.learn(agg, last), "thresholds")


def _series(spark, sf, **kw):
    agg, _, limits = _learned(spark, sf)
    dense = series.dense_series(agg, limits, **kw)
    return series.with_features(dense, fx.SLOTS)


def _rows(df):
    return chunks.owned(df)


@query("features", sql(f"SELECT {_ALL} FROM feat", "feat", reals=f"{_REAL_FEATURES} {' '.join(S.LABELS)}"))
def features_query(spark, sf):
    return features.train(fx.agg_table(spark, sf), bucket_seconds=fx.HOUR, slots=fx.SLOTS)


@query("label_classes_per_machine", sql("""
SELECT machine_id, severity_in_60m, count(*) AS n_rows FROM feat GROUP BY 1, 2""", "feat",
                                        reals="severity_in_60m"))
def label_classes(spark, sf):
    out = features.train(fx.agg_table(spark, sf), bucket_seconds=fx.HOUR, slots=fx.SLOTS)
    return out.groupBy("machine_id", "severity_in_60m").agg(F.count(F.lit(1)).alias("n_rows"))


# --- gap filling and windows -------------------------------------------------

@query("j4_gap_fill", sql("""
SELECT machine_id, bucket, observed, total_cpu, peak_cpu, total_mem, peak_mem, disk_io, n_tasks FROM dense""",
                          "dense", reals="total_cpu peak_cpu total_mem peak_mem disk_io"))
def gap_fill(spark, sf):
    dense = series.dense_series(fx.agg(spark, sf), back=0)
    return _rows(dense)


def _window_query(name: str, cols: str, exact: str = ""):
    reals = " ".join(c for c in cols.split() if c not in exact.split())
    body = f"SELECT machine_id, bucket, {', '.join(cols.split())} FROM series"

    @query(name, sql(body, "series", reals=reals))
    def run(spark, sf):
        return _rows(_series(spark, sf)).select("machine_id", "bucket", *cols.split())
    return run


_window_query("w1_lags", "cpu_lag_1 cpu_lag_12 cpu_lag_24")
_window_query("w3_differences", "cpu_delta_1 cpu_delta_2")
_window_query("w4_rolling_std", "cpu_rolling_std_6")
_window_query("w5_slopes", "cpu_vs_p95_delta cpu_vs_p95_slope_3 cpu_vs_p95_slope_6")
_window_query("w7_moderate_history", "spike_in_last_1 spike_in_last_3 spike_in_last_6")
_window_query("w8_severe_history", "spike_severe_in_last_1 spike_severe_in_last_3 spike_severe_in_last_6")
_window_query("w9_spike_rate", "cpu_spike_rate_24")
_window_query("w10_since_last_spike", "time_since_last_spike")


block("walk", """
SELECT machine_id, bucket, pos, total_cpu AS y6, total_cpu AS y24 FROM dense WHERE pos = 0
UNION ALL
SELECT d.machine_id, d.bucket, d.pos, pow(2, -1 / 6e0) * k.y6 + (1 - pow(2, -1 / 6e0)) * d.total_cpu,
       pow(2, -1 / 24e0) * k.y24 + (1 - pow(2, -1 / 24e0)) * d.total_cpu
FROM walk k JOIN dense d ON d.machine_id = k.machine_id AND d.pos = k.pos + 1""", "dense")


@query("w2_ewma", sql("SELECT machine_id, bucket, y6 AS cpu_ewma_6, y24 AS cpu_ewma_24 FROM walk", "walk",
                      reals="cpu_ewma_6 cpu_ewma_24"))
def ewma(spark, sf):
    return _rows(_series(spark, sf)).select("machine_id", "bucket", "cpu_ewma_6", "cpu_ewma_24")


@query("w6_time_to_threshold", sql("""
SELECT machine_id, bucket, time_to_p95_3 FROM feat""", "feat", reals="time_to_p95_3"))
def time_to_threshold(spark, sf):
    return series.observed_rows(_series(spark, sf)).select("machine_id", "bucket", "time_to_p95_3")


def _labels(spark, sf, k):
    full = series.with_labels(_series(spark, sf), S.HORIZON, k)
    return _rows(full)


@query("w11_severity_label", sql("""
SELECT machine_id, bucket, CASE WHEN ahead_rows = 12 THEN CASE WHEN ahead_99 >= 2 THEN 2e0
       WHEN ahead_95 >= 2 THEN 1e0 ELSE 0e0 END END AS severity_in_60m FROM series""", "series",
                                 reals="severity_in_60m"))
def severity_label(spark, sf):
    return _labels(spark, sf, 2).select("machine_id", "bucket", "severity_in_60m")


@query("w12_binary_labels", sql("""
SELECT machine_id, bucket, spike_in_15m, spike_in_30m, spike_in_45m FROM series""", "series",
                                reals="spike_in_15m spike_in_30m spike_in_45m"))
def binary_labels(spark, sf):
    return _labels(spark, sf, 2).select("machine_id", "bucket", *S.SHORT_HORIZONS)


@query("w13_rank_in_bucket", sql("""
SELECT machine_id, bucket, machine_rank_in_cluster FROM cross_section""", "cross_section",
                                 reals="machine_rank_in_cluster"))
def rank_in_bucket(spark, sf):
    return cross.rank_in_bucket(fx.agg(spark, sf)).select("machine_id", "bucket", "machine_rank_in_cluster")


@query("w15_latest_row", sql("""
SELECT machine_id, max(bucket) AS bucket, arg_max(total_cpu, bucket) AS total_cpu,
       arg_max(n_tasks, bucket) AS n_tasks FROM agg GROUP BY 1""", "agg", reals="total_cpu"))
def latest_row(spark, sf):
    last = F.max_by(F.struct("bucket", "total_cpu", "n_tasks"), "bucket").alias("r")
    return fx.agg(spark, sf).groupBy("machine_id").agg(last).select("machine_id", "r.*")


# --- thresholds ---------------------------------------------------------------

@query("a6_train_quantiles", sql("""
SELECT machine_id, quantile_cont(total_cpu, 0.95) AS p95, quantile_cont(total_cpu, 0.99) AS p99
FROM agg WHERE bucket <= (SELECT t1 FROM bounds) GROUP BY 1""", "agg", "bounds", reals="p95 p99"))
def train_quantiles(spark, sf):
    agg = fx.agg_table(spark, sf)
    last = thresholds.split_point(agg, S.TRAIN_RATIO)
    return thresholds.raw_quantiles(agg.filter(F.col("bucket") <= last), ["machine_id"])


@query("a7_repaired_thresholds", sql("SELECT * FROM thr", "thr", reals="threshold_p95 threshold_p99"))
def repaired(spark, sf):
    return _learned(spark, sf)[2]


_BOOT = 60
_BOOT_SQL = f"""
SELECT machine_id, p95 AS threshold_p95, CASE WHEN p99 < p95 * 1.1e0 THEN p95 * 1.1e0 ELSE p99 END AS threshold_p99
FROM (SELECT machine_id, CASE WHEN n >= {_BOOT} THEN a.p95 ELSE g.p95 END AS p95,
             CASE WHEN n >= {_BOOT} THEN a.p99 ELSE g.p99 END AS p99
      FROM (SELECT machine_id, count(DISTINCT bucket) AS n, quantile_cont(total_cpu, 0.95) AS p95,
                   quantile_cont(total_cpu, 0.99) AS p99 FROM agg GROUP BY 1) a
      CROSS JOIN (SELECT quantile_cont(total_cpu, 0.95) AS p95, quantile_cont(total_cpu, 0.99) AS p99 FROM agg) g)"""


@query("a8_bootstrap_thresholds", sql(_BOOT_SQL, "agg", reals="threshold_p95 threshold_p99"))
def bootstrap(spark, sf):
    return thresholds.bootstrap(fx.agg_table(spark, sf), _BOOT)


@query("a9_bootstrap_audit", sql(f"""
SELECT (SELECT count(*) FROM agg) AS rows_in, (SELECT min(bucket) FROM agg) AS min_bucket,
       (SELECT max(bucket) FROM agg) AS max_bucket, count(*) AS n_machines_total,
       count(*) FILTER (WHERE n >= {_BOOT}) AS n_machines_with_per_machine,
       count(*) FILTER (WHERE n < {_BOOT}) AS n_machines_with_global_fallback,
       (SELECT quantile_cont(total_cpu, 0.95) FROM agg) AS global_p95,
       (SELECT quantile_cont(total_cpu, 0.99) FROM agg) AS global_p99
FROM (SELECT machine_id, count(DISTINCT bucket) AS n FROM agg GROUP BY 1)""", "agg", reals="global_p95 global_p99"))
def bootstrap_audit(spark, sf):
    return thresholds.bootstrap_audit(fx.agg_table(spark, sf), _BOOT)


@query("a10_bucket_p90", sql("""
SELECT bucket, quantile_cont(total_cpu, 0.9) AS cluster_cpu_p90 FROM agg
WHERE bucket <= (SELECT t1 FROM bounds) GROUP BY 1""", "agg", "bounds", reals="cluster_cpu_p90"))
def bucket_p90(spark, sf):
    agg = fx.agg_table(spark, sf)
    return cross.bucket_p90(agg, thresholds.split_point(agg, S.TRAIN_RATIO))


@query("a25_fallback_medians", sql("""
SELECT median(threshold_p95) AS median_p95, median(threshold_p99) AS median_p99 FROM thr""", "thr",
                                   reals="median_p95 median_p99"))
def fallback_medians(spark, sf):
    return thresholds.fallback_medians(_learned(spark, sf)[2])


@query("j1_attach_thresholds", sql("""
SELECT a.machine_id, a.bucket, coalesce(t.threshold_p95, g.f95) AS threshold_p95,
       coalesce(t.threshold_p99, g.f99) AS threshold_p99,
       CASE WHEN t.machine_id IS NULL THEN 'global_fallback' ELSE 'learned' END AS threshold_source
FROM agg a LEFT JOIN (SELECT * FROM thr WHERE machine_id IN
      (SELECT machine_id FROM agg WHERE bucket <= (SELECT t1 FROM bounds) GROUP BY 1 HAVING count(*) >= 40)) t
     USING (machine_id)
CROSS JOIN (SELECT median(threshold_p95) AS f95, median(threshold_p99) AS f99 FROM thr WHERE machine_id IN
      (SELECT machine_id FROM agg WHERE bucket <= (SELECT t1 FROM bounds) GROUP BY 1 HAVING count(*) >= 40)) g""",
                                   "thr", reals="threshold_p95 threshold_p99"))
def attach_thresholds(spark, sf):
    agg, last, limits = _learned(spark, sf)
    deep = (agg.filter(F.col("bucket") <= last).groupBy("machine_id").count()
            .filter(F.col("count") >= 40).select("machine_id"))
    known = limits.join(deep, "machine_id", "left_semi")
    return thresholds.attach(agg, known).select("machine_id", "bucket", "threshold_p95", "threshold_p99",
                                                "threshold_source")


@query("j5_attach_bucket_p90", sql("""
SELECT machine_id, bucket, cluster_cpu_p90 FROM cross_section""", "cross_section", reals="cluster_cpu_p90"))
def attach_bucket_p90(spark, sf):
    agg = fx.agg_table(spark, sf)
    return cross.attach_p90(agg, thresholds.split_point(agg, S.TRAIN_RATIO)).select(
        "machine_id", "bucket", "cluster_cpu_p90")


@query("j7_unknown_machines", sql("""
SELECT machine_id, count(*) AS rows_in FROM agg WHERE bucket > (SELECT t1 FROM bounds) AND machine_id NOT IN
  (SELECT machine_id FROM agg WHERE bucket <= (SELECT lo + 24 FROM bounds)) GROUP BY 1""", "agg", "bounds"))
def unknown_machines(spark, sf):
    agg = fx.agg_table(spark, sf)
    first_day = agg.agg((F.min("bucket") + 24).alias("b")).scalar()
    known = agg.filter(F.col("bucket") <= first_day).select("machine_id").distinct()
    incoming = agg.filter(F.col("bucket") > thresholds.split_point(agg, S.TRAIN_RATIO))
    return thresholds.unknown_machines(incoming, known)


@query("j8_unseen_machine_thresholds", sql("""
SELECT machine_id, (SELECT quantile_cont(total_cpu, 0.95) FROM agg WHERE bucket <= (SELECT lo + 24 FROM bounds))
         AS threshold_p95
FROM (SELECT DISTINCT machine_id FROM agg) WHERE machine_id NOT IN
  (SELECT machine_id FROM agg WHERE bucket <= (SELECT lo + 24 FROM bounds))""", "agg", "bounds",
                                           reals="threshold_p95"))
def unseen_thresholds(spark, sf):
    agg = fx.agg_table(spark, sf)
    first_day = agg.agg((F.min("bucket") + 24).alias("b")).scalar()
    seen = agg.filter(F.col("bucket") <= first_day).select("machine_id")
    return (thresholds.learn(agg, first_day).join(seen, "machine_id", "left_anti")
            .select("machine_id", "threshold_p95"))


# --- scalar features -----------------------------------------------------------

def _scalar_query(name: str, cols: str):
    body = f"SELECT machine_id, bucket, {', '.join(cols.split())} FROM feat"

    @query(name, sql(body, "feat", reals=cols))
    def run(spark, sf):
        return series.observed_rows(_series(spark, sf)).select("machine_id", "bucket", *cols.split())
    return run


_scalar_query("f1_task_intensity", "task_dominance cpu_per_task")
_scalar_query("f2_threshold_ratios",
              "cpu_vs_p95 peak_cpu_vs_p95 cpu_vs_p99 peak_cpu_vs_p99 spike_now spike_severe_now")
_scalar_query("f3_severity_band", "band_width band_position")
_scalar_query("f4_time_of_day", "hour_sin hour_cos")


@query("u3_other_signal", sql("""
SELECT machine_id, bucket, total_mem AS value, coalesce(lag(total_mem) OVER w, 0) AS previous,
       coalesce(stddev_samp(total_mem) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS rolling_std
FROM dense WINDOW w AS (PARTITION BY machine_id ORDER BY bucket)""", "dense", reals="value previous rolling_std"))
def other_signal(spark, sf):
    """The same series features on memory instead of CPU."""
    agg = fx.agg_table(spark, sf)
    last = thresholds.split_point(agg, S.TRAIN_RATIO)
    limits = thresholds.learn(agg, last, value="total_mem")
    dense = series.dense_series(agg, limits, value="total_mem")
    return _rows(series.with_features(dense, fx.SLOTS)).select(
        "machine_id", "bucket", F.col("total_cpu").alias("value"),
        F.col("cpu_lag_1").alias("previous"), F.col("cpu_rolling_std_6").alias("rolling_std"))


@query("p10_exit_contract", sql("""
SELECT machine_id, bucket, time_us, CAST(total_cpu AS FLOAT) AS total_cpu, CAST(peak_cpu AS FLOAT) AS peak_cpu,
       CAST(total_mem AS FLOAT) AS total_mem, CAST(peak_mem AS FLOAT) AS peak_mem, CAST(disk_io AS FLOAT) AS disk_io,
       n_tasks FROM agg""", "agg", reals="total_cpu peak_cpu total_mem peak_mem disk_io"))
def exit_contract(spark, sf):
    from tidewatch.sources.contracts import at_rest
    return at_rest(fx.agg(spark, sf))
