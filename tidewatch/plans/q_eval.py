"""Queries over profiles, drift, splits, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scalar as X
from tidewatch.operators import baselines, chunks, drift, metrics, profile, resample, series, splits, thresholds
from tidewatch.operators.joins import with_feature_group
from tidewatch.plans import features, fixtures as fx
from tidewatch.plans.registry import block, query, sql
from tidewatch.session import materialise

# --- score fixture: simple scores with real labels -----------------------------------


def labelled_series(spark, sf):
    agg = fx.agg_table(spark, sf)
    limits = materialise(thresholds.learn(agg, thresholds.split_point(agg, S.TRAIN_RATIO)), "thresholds")
    return series.observed_rows(series.measured_features(series.measured_series(agg, limits), fx.SLOTS, labels=True))


def scores(spark, sf):
    squash = lambda c: F.col(c) / (1 + F.col(c))
    rows = labelled_series(spark, sf).select(
        "machine_id", "bucket", "total_cpu", F.col("threshold_p95").alias("p95"), *S.LABELS,
        squash("total_cpu").alias("score_a"), squash("peak_cpu").alias("score_b"))
    return materialise(rows, "scores")


block("scores", f"""
SELECT machine_id, bucket, total_cpu, threshold_p95 AS p95, {', '.join(S.LABELS)},
       total_cpu / (1 + total_cpu) AS score_a, peak_cpu / (1 + peak_cpu) AS score_b FROM feat""", "feat")
block("split_scores", """
SELECT *, CASE WHEN bucket <= t1 THEN 'train' WHEN bucket <= t2 THEN 'val' ELSE 'test' END AS split
FROM scores, bounds""", "scores", "bounds")
block("unified", "SELECT * FROM split_scores WHERE split = 'test'", "split_scores")


def unified(spark, sf):
    return splits.chronological(scores(spark, sf)).filter(F.col("split") == "test")


def rank_sql(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {k}CAST(max(n) AS BIGINT) AS n_rows, CAST(max(p) AS BIGINT) AS n_pos,
       CASE WHEN max(p) > 0 AND max(p) < max(n) THEN sum(CASE WHEN p > 0 THEN pos / p * tp / seen END) END AS pr_auc,
       CASE WHEN max(p) > 0 AND max(p) < max(n) THEN sum((tot - pos) * (tp - pos / 2)) / (max(p) * (max(n) - max(p))) END
         AS roc_auc
FROM (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(tot) OVER ({part}ORDER BY score DESC) AS seen,
             sum(pos) OVER ({part}) AS p, sum(tot) OVER ({part}) AS n
      FROM (SELECT {k}score, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS tot FROM {src}
            GROUP BY {k}score)) {group}"""


# --- profiles ---------------------------------------------------------------------------

block("stats", """
SELECT machine_id, count(*) AS n_buckets, avg(total_cpu) AS mean_cpu, stddev_pop(total_cpu) AS std_cpu,
       quantile_cont(total_cpu, 0.95) AS p95_cpu, quantile_cont(total_cpu, 0.99) AS p99_cpu
FROM agg GROUP BY 1""", "agg")


@query("a12_node_profile", sql("""
SELECT s.machine_id, n_buckets, mean_cpu, std_cpu, p95_cpu, p99_cpu, i.idle_fraction,
       (std_cpu - mean_cpu) / (std_cpu + mean_cpu + 1e-9) AS burstiness, p99_cpu / (mean_cpu + 1e-9) AS peak_to_mean,
       std_cpu / (mean_cpu + 1e-9) AS cv
FROM stats s JOIN (SELECT a.machine_id, avg(CASE WHEN total_cpu < greatest(0.01e0, mean_cpu * 0.05e0) THEN 1e0 ELSE 0 END)
                          AS idle_fraction FROM agg a JOIN stats USING (machine_id) GROUP BY 1) i USING (machine_id)""",
                               "stats", reals="mean_cpu std_cpu p95_cpu p99_cpu idle_fraction burstiness peak_to_mean cv"))
def node_profile(spark, sf):
    agg = fx.agg_table(spark, sf)
    stats = profile.moments(agg)
    return profile.shape(stats).join(profile.idle_fraction(agg, stats), "machine_id")


block("biz", """
SELECT machine_id, coalesce(avg(total_cpu) FILTER (WHERE bucket % 24 >= 9 AND bucket % 24 < 18)
       / (avg(total_cpu) FILTER (WHERE bucket % 24 < 9 OR bucket % 24 >= 18) + 1e-9), 1) AS biz_ratio
FROM agg GROUP BY 1""", "agg")


@query("a13_business_ratio", sql("SELECT * FROM biz", "biz", reals="biz_ratio"))
def business_ratio(spark, sf):
    return profile.business_ratio(fx.agg(spark, sf), fx.SLOTS)


block("above", """
SELECT a.machine_id, a.bucket, CASE WHEN total_cpu > p95_cpu THEN 1 ELSE 0 END AS above
FROM agg a JOIN stats USING (machine_id)""", "agg", "stats")
block("runs", """
SELECT machine_id, avg(above) AS spike_rate, coalesce((SELECT avg(n) FROM (
         SELECT count(*) AS n FROM (SELECT bucket, above, row_number() OVER (ORDER BY bucket)
                  - row_number() OVER (PARTITION BY above ORDER BY bucket) AS island FROM above b
                WHERE b.machine_id = x.machine_id) WHERE above = 1 GROUP BY island)), 0) AS mean_ep_len
FROM above x GROUP BY 1""", "above")


@query("a14_episodes", sql("SELECT * FROM runs", "runs", reals="spike_rate mean_ep_len"))
def episodes(spark, sf):
    agg = fx.agg_table(spark, sf)
    return profile.episodes(agg, profile.moments(agg))


block("acf", """
SELECT machine_id, CASE WHEN count(*) <= 1 THEN NULL WHEN var_pop(x) < 1e-12 THEN 0 ELSE covar_samp(x1, x) / var_pop(x) END
         AS acf_lag1,
       CASE WHEN count(*) <= 12 THEN NULL WHEN var_pop(x) < 1e-12 THEN 0 ELSE covar_samp(x12, x) / var_pop(x) END AS acf_lag12
FROM (SELECT machine_id, total_cpu AS x, lag(total_cpu, 1) OVER w AS x1, lag(total_cpu, 12) OVER w AS x12 FROM agg
      WINDOW w AS (PARTITION BY machine_id ORDER BY bucket)) GROUP BY 1""", "agg")


@query("a15_autocorrelation", sql("SELECT * FROM acf", "acf", reals="acf_lag1 acf_lag12"))
def autocorrelation(spark, sf):
    return profile.autocorrelation(fx.agg(spark, sf))


@query("a16_profile_warnings", sql("""
SELECT count(*) AS n_machines, count(*) FILTER (WHERE idle_fraction > 0.40e0) AS idle_machines,
       count(*) FILTER (WHERE biz_ratio > 3) AS business_machines, stddev_pop(spike_rate) AS spike_rate_std,
       count(*) >= 2 AND stddev_pop(spike_rate) < 0.02 AS similar_machines
FROM runs JOIN biz USING (machine_id) JOIN (
  SELECT a.machine_id, avg(CASE WHEN total_cpu < greatest(0.01e0, mean_cpu * 0.05e0) THEN 1e0 ELSE 0 END) AS idle_fraction
  FROM agg a JOIN stats USING (machine_id) GROUP BY 1) USING (machine_id)""", "runs", "biz", "stats",
                                   reals="spike_rate_std"))
def profile_warnings(spark, sf):
    return profile.warnings(profile.node_profile(fx.agg_table(spark, sf), fx.SLOTS))


@query("st7_exceedance_episodes", sql("""
SELECT machine_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS n_rows FROM (
  SELECT machine_id, bucket, bucket - row_number() OVER (PARTITION BY machine_id ORDER BY bucket) AS island
  FROM above WHERE above = 1) GROUP BY machine_id, island""", "above"))
def exceedance_episodes(spark, sf):
    """Runs of consecutive exceeding buckets as sessions; the stream form is in ``streaming``."""
    agg = fx.agg_table(spark, sf)
    own = profile.moments(agg).select("machine_id", "p95_cpu")
    hot = agg.join(own, "machine_id").filter(F.col("total_cpu") > F.col("p95_cpu"))
    at = F.timestamp_seconds(F.col("bucket") * fx.HOUR)
    session = F.session_window(at, f"{fx.HOUR + 1} seconds")
    return (hot.groupBy("machine_id", session.alias("s"))
            .agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
                 F.count(F.lit(1)).alias("n_rows")).drop("s"))


# --- drift --------------------------------------------------------------------------------

_FEATS = S.MODEL_FEATURES
_STRUCTS = ", ".join(f"{{'f': '{f}', 'v': CAST({f} AS DOUBLE)}}" for f in _FEATS)
block("feat_long", f"""
SELECT live, u.f AS feature, u.v AS v FROM (
  SELECT bucket > (SELECT t1 FROM bounds) AS live, unnest([{_STRUCTS}]) AS u FROM feat) WHERE u.v IS NOT NULL""",
      "feat", "bounds")
block("psi_edges", """
SELECT feature, CASE WHEN bool_and(v IN (0, 1)) THEN [-0.5e0, 0.5e0, 1.5e0]
       ELSE list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) END AS edges,
       avg(v) AS reference_mean, count(*) AS n_ref
FROM feat_long WHERE NOT live GROUP BY 1""", "feat_long")
block("psi_bins", """
SELECT feature, CASE WHEN v = edges[len(edges)] THEN len(edges) - 1 ELSE len(list_filter(edges, lambda e: e <= v)) END AS bin,
       count(*) FILTER (WHERE NOT live) AS cr, count(*) FILTER (WHERE live) AS cl
FROM feat_long JOIN psi_edges USING (feature)
WHERE len(edges) >= 2 AND v >= edges[1] AND v <= edges[len(edges)] GROUP BY 1, 2""", "feat_long", "psi_edges")
block("psi", """
SELECT e.feature, p.psi, e.reference_mean, l.live_mean, e.n_ref, l.n_live
FROM psi_edges e LEFT JOIN (SELECT feature, avg(v) AS live_mean, count(*) AS n_live FROM feat_long WHERE live GROUP BY 1) l
     USING (feature)
LEFT JOIN (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (
  SELECT feature, greatest(cl / CAST(n_live AS DOUBLE), 1e-4) AS a, greatest(cr / CAST(n_ref AS DOUBLE), 1e-4) AS e
  FROM psi_bins JOIN psi_edges USING (feature)
  JOIN (SELECT feature, count(*) AS n_live FROM feat_long WHERE live GROUP BY 1) USING (feature)) GROUP BY 1) p USING (feature)""",
      "psi_bins")
block("psi_status", """
SELECT *, CASE WHEN psi IS NULL THEN 'stable' WHEN psi >= 0.5 THEN 'emergency' WHEN psi >= 0.25 THEN 'retrain'
               WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status FROM psi""", "psi")


def _reference_live(spark, sf):
    agg = fx.agg_table(spark, sf)
    full = materialise(features.train(agg, bucket_seconds=fx.HOUR, slots=fx.SLOTS, labels=False), "features")
    cut = thresholds.split_point(agg, S.TRAIN_RATIO)
    return full.filter(F.col("bucket") <= cut), full.filter(F.col("bucket") > cut)


@query("d1_psi_single_feature", sql("SELECT feature, psi FROM psi WHERE feature IN ('total_cpu', 'spike_now')", "psi",
                                    reals="psi"))
def psi_single(spark, sf):
    """A continuous and a 0/1 feature straight from the series stage."""
    rows = materialise(labelled_series(spark, sf).select("bucket", "total_cpu", "spike_now"), "series")
    cut = thresholds.split_point(fx.agg(spark, sf), S.TRAIN_RATIO)
    return drift.psi_table(rows.filter(F.col("bucket") <= cut), rows.filter(F.col("bucket") > cut),
                           ["total_cpu", "spike_now"]).select("feature", "psi")


@query("d2_psi_all_features", sql("SELECT * FROM psi", "psi", reals="psi reference_mean live_mean"))
def psi_all(spark, sf):
    return drift.psi_table(*_reference_live(spark, sf))


@query("d3_psi_status", sql("SELECT feature, psi, status FROM psi_status", "psi_status", reals="psi"))
def psi_status(spark, sf):
    return drift.with_status(drift.psi_table(*_reference_live(spark, sf))).select("feature", "psi", "status")


@query("d4_drift_report", sql("""
SELECT (SELECT count(*) FROM feat WHERE bucket > (SELECT t1 FROM bounds)) AS live_rows,
       (SELECT min(bucket) FROM feat WHERE bucket > (SELECT t1 FROM bounds)) AS min_bucket,
       (SELECT max(bucket) FROM feat WHERE bucket > (SELECT t1 FROM bounds)) AS max_bucket,
       (SELECT count(*) FROM feat WHERE bucket > (SELECT t1 FROM bounds)) / 10 < 5 AS min_bins_warning,
       CASE max(CASE status WHEN 'emergency' THEN 4 WHEN 'retrain' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)
            WHEN 4 THEN 'emergency' WHEN 3 THEN 'retrain' WHEN 2 THEN 'warning' ELSE 'stable' END AS recommendation,
       count(*) FILTER (WHERE status = 'stable') AS stable_count, count(*) FILTER (WHERE status = 'warning') AS warning_count,
       count(*) FILTER (WHERE status = 'retrain') AS retrain_count,
       count(*) FILTER (WHERE status = 'emergency') AS emergency_count, count(psi) AS n_valid,
       count(*) FILTER (WHERE psi >= 0.2) AS n_alert,
       count(psi) > 0 AND count(*) FILTER (WHERE psi >= 0.2) / count(psi) > 0.1 AS system_alert
FROM psi_status""", "psi_status", "feat", "bounds"))
def drift_report(spark, sf):
    ref, live = _reference_live(spark, sf)
    return drift.report(drift.psi_table(ref, live), live)


@query("d5_cross_domain_labels", sql("""
SELECT feature, psi, CASE WHEN psi IS NULL THEN 'no variance' WHEN psi < 0.1 THEN 'minor' WHEN psi < 0.25 THEN 'moderate'
       ELSE 'MAJOR' END AS interpretation FROM (SELECT feature, round_even(psi, 4) AS psi FROM psi)
UNION ALL SELECT 'gpu_load', NULL, 'missing'""", "psi", reals="psi"))
def cross_domain(spark, sf):
    table = drift.psi_table(*_reference_live(spark, sf), features=[*S.MODEL_FEATURES, "gpu_load"])
    return drift.cross_domain(table)


@query("d6_drift_against_sample")
def drift_against_sample(spark, sf):
    """Training reference against live rows featured with thresholds of the leading part of the live window."""
    agg = fx.agg_table(spark, sf)
    opts = dict(bucket_seconds=fx.HOUR, slots=fx.SLOTS, labels=False)
    reference = materialise(drift.reference_rows(features.train(agg, **opts)), "reference")
    live = agg.filter(F.col("bucket") > thresholds.split_point(agg, S.TRAIN_RATIO))
    featured = materialise(features.build(live, thresholds.bootstrap(live.filter(F.col("bucket") <= thresholds.split_point(live, S.TRAIN_RATIO)), 24), None, **opts), "live")
    return drift.with_status(drift.psi_table(reference, featured))


@query("k1_psi_order", sql("SELECT feature, psi FROM psi ORDER BY psi DESC NULLS LAST", "psi", reals="psi"))
def psi_order(spark, sf):
    return drift.psi_table(*_reference_live(spark, sf)).select("feature", "psi").orderBy(F.desc_nulls_last("psi"))


# --- splits and samples ---------------------------------------------------------------------

@query("k8_chronological_split", sql("SELECT machine_id, bucket, CASE WHEN bucket <= t1 THEN 'train' WHEN bucket <= t2 "
                                     "THEN 'val' ELSE 'test' END AS split FROM agg, bounds", "agg", "bounds"))
def chronological_split(spark, sf):
    return splits.chronological(fx.agg(spark, sf)).select("machine_id", "bucket", "split")


block("folds", """
SELECT machine_id, bucket, fold, role FROM (
  SELECT machine_id, bucket, f AS fold, CASE
    WHEN bucket - lo < n - (n // 6) * (6 - f) - 12 THEN 'train'
    WHEN bucket - lo >= n - (n // 6) * (6 - f) AND bucket - lo < n - (n // 6) * (6 - f) + n // 6 THEN 'test' END AS role
  FROM agg, (SELECT lo, hi - lo + 1 AS n FROM bounds), range(1, 6) r(f)) WHERE role IS NOT NULL""", "agg", "bounds")


@query("k9_walk_forward_folds", sql("SELECT * FROM folds", "folds"))
def walk_forward(spark, sf):
    return splits.walk_forward(fx.agg(spark, sf).select("machine_id", "bucket"))


@query("k9_row_order_folds", sql("""
SELECT machine_id, bucket, fold, role FROM (
  SELECT machine_id, bucket, f AS fold, CASE
    WHEN r < n - (n // 6) * (6 - f) - 12 THEN 'train'
    WHEN r >= n - (n // 6) * (6 - f) AND r < n - (n // 6) * (6 - f) + n // 6 THEN 'test' END AS role
  FROM (SELECT *, row_number() OVER (ORDER BY machine_id, bucket) - 1 AS r, count(*) OVER () AS n FROM agg),
       range(1, 6) t(f)) WHERE role IS NOT NULL""", "agg"))
def row_order_folds(spark, sf):
    return splits.walk_forward(fx.agg(spark, sf).select("machine_id", "bucket"), by="row")


@query("k10_inner_tuning_split", sql("""
SELECT machine_id, bucket, CASE WHEN bucket <= (SELECT min(bucket) + CAST(floor((max(bucket) - min(bucket)) * 0.5e0) AS BIGINT)
         FROM agg WHERE bucket <= (SELECT t1 FROM bounds)) THEN 'fit' ELSE 'tune' END AS inner_split
FROM agg WHERE bucket <= (SELECT t1 FROM bounds)""", "agg", "bounds"))
def inner_split(spark, sf):
    train = splits.chronological(fx.agg(spark, sf)).filter(F.col("split") == "train")
    return splits.inner_tuning(train).select("machine_id", "bucket", "inner_split")


@query("k6_seeded_sample", sql("""
SELECT machine_id, bucket, time_us, total_cpu, peak_cpu, total_mem, peak_mem, disk_io, n_tasks FROM agg
WHERE CAST('0x' || substr(md5(machine_id || '|' || bucket || '|42'), 1, 13) AS BIGINT) / 4503599627370496e0 < 0.1""", "agg",
                              reals="total_cpu peak_cpu total_mem peak_mem disk_io"))
def seeded_sample(spark, sf):
    agg = fx.agg_table(spark, sf)
    return splits.seeded_sample(agg, 0.10)


_DRAW = "CAST('0x' || substr(md5({} || '|42'), 1, 13) AS BIGINT)"


@query("k7_row_cap_and_machine_sample", sql(f"""
SELECT *, 'rows' AS how FROM (SELECT * FROM agg ORDER BY {_DRAW.format("machine_id || '|' || bucket")}, machine_id, bucket LIMIT 2000)
UNION ALL SELECT *, 'machines' FROM agg
WHERE machine_id IN (SELECT machine_id FROM (SELECT DISTINCT machine_id FROM agg) ORDER BY {_DRAW.format("machine_id")}, machine_id LIMIT 10)""", "agg",
                                               reals="total_cpu peak_cpu total_mem peak_mem disk_io"))
def row_cap(spark, sf):
    agg = fx.agg_table(spark, sf)
    return (splits.row_cap(agg, 2_000).withColumn("how", F.lit("rows"))
            .unionByName(splits.machine_sample(agg, 10).withColumn("how", F.lit("machines"))))


@query("a11_class_rates", sql("""
SELECT split, avg(CASE WHEN severity_in_60m = 0 THEN 1e0 ELSE 0 END) AS rate_0,
       avg(CASE WHEN severity_in_60m = 1 THEN 1e0 ELSE 0 END) AS rate_1,
       avg(CASE WHEN severity_in_60m = 2 THEN 1e0 ELSE 0 END) AS rate_2,
       avg(CASE WHEN severity_in_60m > 0 THEN 1e0 ELSE 0 END) AS positive_rate
FROM split_scores WHERE severity_in_60m IS NOT NULL GROUP BY 1""", "split_scores",
                              reals="rate_0 rate_1 rate_2 positive_rate"))
def class_rates(spark, sf):
    rows = splits.chronological(scores(spark, sf)).filter(F.col("severity_in_60m").isNotNull())
    return metrics.class_rates(rows, ["split"], "severity_in_60m")


# --- baselines ---------------------------------------------------------------------------------

def _baseline(spark, sf, name):
    return baselines.score_all(unified(spark, sf), [name]).select("machine_id", "bucket", F.col(name).alias("score"))


@query("b1_random", sql("""
SELECT machine_id, bucket, CAST('0x' || substr(md5(machine_id || '|' || bucket || '|42'), 1, 13) AS BIGINT) / 4503599627370496e0 AS score
FROM unified""", "unified", reals="score"))
def random_baseline(spark, sf):
    return _baseline(spark, sf, "random")


block("b_persistence", "SELECT machine_id, bucket, least(20, total_cpu / greatest(p95, 1e-9)) AS score FROM unified", "unified")
block("b_static", """
SELECT machine_id, bucket, coalesce(avg(CASE WHEN total_cpu > p95 THEN 1e0 ELSE 0 END)
  OVER (PARTITION BY machine_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS score FROM unified""", "unified")
block("numbered", "SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY bucket) - 1 AS pos FROM unified", "unified")
block("ewma_walk", """
SELECT machine_id, bucket, pos, CAST(NULL AS DOUBLE) AS mu, CAST(NULL AS DOUBLE) AS var, total_cpu AS m,
       CAST(NULL AS DOUBLE) AS v, total_cpu FROM numbered WHERE pos = 0
UNION ALL
SELECT n.machine_id, n.bucket, n.pos, w.m, w.v, (1 - 2 / 13e0) * w.m + 2 / 13e0 * n.total_cpu,
       CASE WHEN w.v IS NULL THEN pow(n.total_cpu - w.m, 2)
            ELSE (1 - 2 / 13e0) * w.v + 2 / 13e0 * pow(n.total_cpu - w.m, 2) END, n.total_cpu
FROM ewma_walk w JOIN numbered n ON n.machine_id = w.machine_id AND n.pos = w.pos + 1""", "numbered")
block("b_ewma", """
SELECT machine_id, bucket, coalesce(CASE WHEN var IS NOT NULL THEN
       greatest(0, (total_cpu - mu) / greatest(sqrt(var), 1e-9)) END, 0) AS score FROM ewma_walk""", "ewma_walk")
block("b_rolling", """
SELECT machine_id, bucket, CASE WHEN count(*) OVER w >= 4 THEN
  greatest(0, (total_cpu - avg(total_cpu) OVER w) / greatest(stddev_samp(total_cpu) OVER w, 1e-9)) ELSE 0 END AS score
FROM unified WINDOW w AS (PARTITION BY machine_id ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""", "unified")
block("steps", """
SELECT *, total_cpu - x1 AS d0, x1 - x2 AS d1, x2 - x3 AS d2 FROM (
  SELECT *, lag(total_cpu, 1) OVER w AS x1, lag(total_cpu, 2) OVER w AS x2, lag(total_cpu, 3) OVER w AS x3
  FROM unified WINDOW w AS (PARTITION BY machine_id ORDER BY bucket))""", "unified")
block("ar2", """
SELECT machine_id, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS phi1,
       (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS phi2 FROM (
  SELECT machine_id, count(*) AS n, sum(d1 * d1) FILTER (WHERE d2 IS NOT NULL) AS s11, sum(d2 * d2) AS s22,
         sum(d1 * d2) AS s12, sum(d1 * d0) FILTER (WHERE d2 IS NOT NULL) AS s1y, sum(d2 * d0) AS s2y
  FROM steps WHERE bucket <= (SELECT min(bucket) + CAST(floor((max(bucket) - min(bucket)) * 0.6e0) AS BIGINT) FROM unified)
  GROUP BY 1) WHERE n >= 20 AND s11 * s22 - s12 * s12 > 1e-12""", "steps", "unified")
block("b_arima", """
SELECT s.machine_id, s.bucket, CASE WHEN phi1 IS NULL THEN least(20, total_cpu / greatest(p95, 1e-9))
       ELSE coalesce(greatest(0, (x1 + phi1 * d1 + phi2 * d2) / greatest(p95, 1e-9) - 0.5), 0) END AS score
FROM steps s LEFT JOIN ar2 USING (machine_id)""", "steps", "ar2")

for _key, _name, _blk in (("b2_persistence", "persistence", "b_persistence"), ("b3_static_share", "static_thresh", "b_static"),
                          ("b4_ewma_z", "ewma_zscore", "b_ewma"), ("b5_rolling_z", "rolling_zscore", "b_rolling"),
                          ("b6_ar2_forecast", "arima", "b_arima")):
    query(_key, sql(f"SELECT machine_id, bucket, score FROM {_blk}", _blk, reals="score"))(
        lambda spark, sf, name=_name: _baseline(spark, sf, name))

_NAMES = ["persistence", "static_thresh", "ewma_zscore", "rolling_zscore", "arima"]
_TASKS = [(lab, f"CAST({lab} AS BIGINT)") for lab in S.SHORT_HORIZONS] + \
         [(f"severity_class_{k}", f"CAST(severity_in_60m = {k} AS BIGINT)") for k in range(3)] + \
         [("severe_vs_rest", "CAST(severity_in_60m = 2 AS BIGINT)")]
block("all_scores", " UNION ALL ".join(
    f"SELECT '{n}' AS baseline, machine_id, bucket, score FROM {b}"
    for n, b in zip(_NAMES, ("b_persistence", "b_static", "b_ewma", "b_rolling", "b_arima"))),
      "b_persistence", "b_static", "b_ewma", "b_rolling", "b_arima")
block("task_scores", " UNION ALL ".join(
    f"SELECT baseline, '{t}' AS label, {e} AS y, round(score, 9) AS score FROM all_scores a JOIN unified u "
    f"ON a.machine_id = u.machine_id AND a.bucket = u.bucket WHERE {e} IS NOT NULL" for t, e in _TASKS), "all_scores", "unified")


@query("b7_evaluate_baselines", sql(rank_sql("task_scores", "baseline, label"), "task_scores", reals="pr_auc roc_auc"))
def evaluate_baselines(spark, sf):
    scored = baselines.score_all(unified(spark, sf), _NAMES)
    return baselines.evaluate(scored, _NAMES)


@query("u2_custom_scorer", sql("""
SELECT machine_id, bucket, total_cpu - coalesce(lag(total_cpu) OVER (PARTITION BY machine_id ORDER BY bucket), 0) AS score
FROM unified""", "unified", reals="score"))
def custom_scorer(spark, sf):
    step = F.col("total_cpu") - F.coalesce(F.lag("total_cpu").over(chunks.series_window("machine_id", "pos")), F.lit(0.0))
    baselines.register_scorer("last_step", lambda d: d.withColumn("last_step", step))
    try:
        return _baseline(spark, sf, "last_step")
    finally:
        baselines.SCORERS.pop("last_step")


# --- metrics -------------------------------------------------------------------------------------

block("short_rows", """
SELECT split, machine_id, bucket, CAST(spike_in_15m AS BIGINT) AS y, score_a, score_b FROM split_scores
WHERE spike_in_15m IS NOT NULL""", "split_scores")
block("ranked", "SELECT split, y, score_a AS score FROM short_rows", "short_rows")


def _binary(spark, sf):
    return (splits.chronological(scores(spark, sf)).filter(F.col("spike_in_15m").isNotNull())
            .withColumn("y", F.col("spike_in_15m").cast("long")))


@query("m1_average_precision", sql(f"SELECT split, n_rows, n_pos, pr_auc FROM ({rank_sql('ranked', 'split')})", "ranked",
                                   reals="pr_auc"))
def average_precision(spark, sf):
    return metrics.ranking(_binary(spark, sf), ["split"], score="score_a").select("split", "n_rows", "n_pos", "pr_auc")


@query("m2_roc_auc", sql("""
SELECT p.split, sum(CASE WHEN p.score_a > n.score_a THEN 1e0 WHEN p.score_a = n.score_a THEN 0.5e0 ELSE 0 END)
       / count(*) AS roc_auc
FROM (SELECT * FROM short_rows WHERE y = 1) p JOIN (SELECT * FROM short_rows WHERE y = 0) n USING (split) GROUP BY 1""", "short_rows",
                         reals="roc_auc"))
def roc_auc(spark, sf):
    return metrics.ranking(_binary(spark, sf), ["split"], score="score_a").select("split", "roc_auc")


block("severity_pred", """
SELECT split, CAST(severity_in_60m AS BIGINT) AS y, CASE WHEN score_a > 0.5 THEN 2 WHEN score_b > 0.3 THEN 1 ELSE 0 END AS pred
FROM split_scores WHERE severity_in_60m IS NOT NULL""", "split_scores")
block("class_report", """
SELECT split, k AS class, count(*) FILTER (WHERE y = k AND pred = k) AS tp, count(*) FILTER (WHERE pred = k) AS pp,
       count(*) FILTER (WHERE y = k) AS support FROM severity_pred, range(0, 3) r(k) GROUP BY 1, 2""", "severity_pred")
block("class_rates_f1", """
SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
       CASE WHEN pp + support > 0 THEN 2 * tp / (pp + support) ELSE 0 END AS f1 FROM class_report""", "class_report")


def _severity(spark, sf):
    rows = splits.chronological(scores(spark, sf)).filter(F.col("severity_in_60m").isNotNull())
    pred = F.when(F.col("score_a") > 0.5, 2).when(F.col("score_b") > 0.3, 1).otherwise(0)
    return rows.withColumn("y", F.col("severity_in_60m").cast("long")).withColumn("pred", pred)


@query("m3_class_report", sql("SELECT * FROM class_rates_f1", "class_rates_f1", reals="precision recall f1"))
def class_report(spark, sf):
    return metrics.class_report(_severity(spark, sf), ["split"], "y", "pred")


@query("m3_f1_summary", sql("""
SELECT split, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM class_rates_f1
WHERE support > 0 OR pp > 0 GROUP BY 1""", "class_rates_f1", reals="macro_f1 weighted_f1"))
def f1_summary(spark, sf):
    return metrics.f1_summary(metrics.class_report(_severity(spark, sf), ["split"], "y", "pred"), ["split"])


block("ovr", " UNION ALL ".join(
    f"SELECT split, {k} AS class, CAST(severity_in_60m = {k} AS BIGINT) AS y, {s} AS score FROM split_scores "
    "WHERE severity_in_60m IS NOT NULL" for k, s in enumerate(("1 - score_a", "score_b", "score_a"))), "split_scores")
block("ovr_ranked", rank_sql("ovr", "split, class"), "ovr")


@query("m4_macro_one_vs_rest", sql("""
SELECT split, avg(pr_auc) AS macro_pr_auc, avg(roc_auc) AS macro_roc_auc FROM ovr_ranked GROUP BY 1""", "ovr_ranked",
                                   reals="macro_pr_auc macro_roc_auc"))
def macro_ovr(spark, sf):
    rows = _severity(spark, sf).withColumn("score_0", 1 - F.col("score_a"))
    per_class = metrics.one_vs_rest(rows, ["split"], "severity_in_60m", ["score_0", "score_b", "score_a"])
    return metrics.macro(per_class, ["split"])


def _cuts(values):
    return ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in values)


def _sweep_block(name, values):
    block(name, f"""
SELECT split, t AS threshold, sum(CASE WHEN score_a >= t THEN y ELSE 0 END) AS tp,
       count(*) FILTER (WHERE score_a >= t) AS alarms, sum(y) AS positives, count(*) AS n_rows
FROM short_rows, (SELECT unnest([{_cuts(values)}]) AS t) GROUP BY 1, 2""", "short_rows")
    block(f"{name}_rates", f"""
SELECT split, threshold, CAST(tp AS BIGINT) AS tp, alarms, CAST(positives AS BIGINT) AS positives, n_rows,
       CASE WHEN alarms > 0 THEN tp / alarms ELSE 0 END AS precision, CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS recall,
       CASE WHEN alarms + positives > 0 THEN 2 * tp / (alarms + positives) ELSE 0 END AS f1,
       alarms / n_rows * 24 AS alarms_per_day FROM {name}""", name)


_sweep_block("swept", metrics.SWEEP)
_sweep_block("swept_report", metrics.REPORT_SWEEP)
_SWEEP_REALS = "threshold precision recall f1 alarms_per_day"


def _sweep(spark, sf, cuts=None):
    return metrics.sweep(_binary(spark, sf), ["split"], score="score_a", thresholds=cuts, slots=fx.SLOTS)


@query("m5_best_threshold", sql("""
SELECT split, coalesce(arg_max(threshold, (f1, -threshold)) FILTER (WHERE f1 > 0), 0.5) AS threshold FROM swept_rates GROUP BY 1""",
                                "swept_rates", reals="threshold"))
def best_threshold(spark, sf):
    return metrics.best_threshold(_sweep(spark, sf), ["split"])


@query("m6_threshold_with_floor", sql("""
SELECT split, coalesce(arg_max(threshold, (recall, -threshold)) FILTER (WHERE precision >= 0.25),
       arg_max(threshold, (f1, -threshold)) FILTER (WHERE f1 > 0), 0.5) AS threshold FROM swept_rates GROUP BY 1""",
                                      "swept_rates", reals="threshold"))
def threshold_with_floor(spark, sf):
    return metrics.best_threshold(_sweep(spark, sf), ["split"], 0.25)


@query("m7_sweep_table", sql("SELECT * FROM swept_report_rates", "swept_report_rates", reals=_SWEEP_REALS))
def sweep_table(spark, sf):
    return _sweep(spark, sf, metrics.REPORT_SWEEP)


@query("f11_alarm_cost", sql("""
SELECT split, threshold, alarms_per_day * (1 - precision) AS false_alarms_per_day, alarms_per_day * precision AS true_alarms_per_day
FROM swept_report_rates""", "swept_report_rates", reals="threshold false_alarms_per_day true_alarms_per_day"))
def alarm_cost(spark, sf):
    return _sweep(spark, sf, metrics.REPORT_SWEEP).select(
        "split", "threshold", (F.col("alarms_per_day") * (1 - F.col("precision"))).alias("false_alarms_per_day"),
        (F.col("alarms_per_day") * F.col("precision")).alias("true_alarms_per_day"))


block("calibrated", " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS class, CAST(severity_in_60m = {k} AS DOUBLE) AS y, {r} AS raw, {c} AS cal FROM scores "
    "WHERE severity_in_60m IS NOT NULL" for k, (r, c) in enumerate((
        ("1 - score_a", "1 - score_b"), ("score_a * 0.6e0", "score_b * 0.6e0"), ("score_a * 0.4e0", "score_b * 0.4e0")))), "scores")
block("calibration", f"""
SELECT class, sum(br) / sum(n) AS brier_raw, sum(bc) / sum(n) AS brier_cal, sum(abs(sy - sp)) / sum(n) AS ece_cal FROM (
  SELECT class, len(list_filter([{_cuts(metrics.CALIBRATION_EDGES)}], lambda e: e <= cal)) AS bin, count(*) AS n, sum(y) AS sy,
         sum(cal) AS sp, sum((y - raw) ** 2) AS br, sum((y - cal) ** 2) AS bc FROM calibrated GROUP BY 1, 2) GROUP BY 1""",
      "calibrated")


def _calibrated(spark, sf):
    rows = scores(spark, sf).filter(F.col("severity_in_60m").isNotNull())
    raw = (1 - F.col("score_a"), F.col("score_a") * 0.6, F.col("score_a") * 0.4)
    cal = (1 - F.col("score_b"), F.col("score_b") * 0.6, F.col("score_b") * 0.4)
    parts = [F.struct(F.lit(k).alias("class"), (F.col("severity_in_60m") == k).cast("double").alias("y"),
                      r.alias("raw"), c.alias("cal")) for k, (r, c) in enumerate(zip(raw, cal))]
    return metrics.calibration(rows.select(F.inline(F.array(*parts))), ["class"], "y", "raw", "cal")


@query("m8_calibration_quality", sql("SELECT * FROM calibration", "calibration", reals="brier_raw brier_cal ece_cal"))
def calibration_quality(spark, sf):
    return _calibrated(spark, sf)


@query("f11_brier_improvement", sql("""
SELECT class, CASE WHEN brier_raw > 0 THEN (brier_raw - brier_cal) / brier_raw * 100 END AS improvement_pct FROM calibration""",
                                    "calibration", reals="improvement_pct"))
def brier_improvement(spark, sf):
    gain = (F.col("brier_raw") - F.col("brier_cal")) / F.col("brier_raw") * 100
    return _calibrated(spark, sf).select("class", F.when(F.col("brier_raw") > 0, gain).alias("improvement_pct"))


@query("m9_renormalise", sql("""
SELECT machine_id, bucket, CASE WHEN t > 0 THEN c0 / t ELSE 1 / 3e0 END AS p0, CASE WHEN t > 0 THEN c1 / t ELSE 1 / 3e0 END AS p1,
       CASE WHEN t > 0 THEN c2 / t ELSE 1 / 3e0 END AS p2 FROM (
  SELECT *, c0 + c1 + c2 AS t FROM (
    SELECT machine_id, bucket, least(greatest(score_b - 0.2e0, 0), 1) AS c0, least(greatest(score_a - 0.2e0, 0), 1) AS c1,
           least(greatest(score_a * 2 - 0.8e0, 0), 1) AS c2 FROM scores))""", "scores", reals="p0 p1 p2"))
def renormalise(spark, sf):
    rows = scores(spark, sf).select("machine_id", "bucket", (F.col("score_b") - 0.2).alias("p0"),
                                    (F.col("score_a") - 0.2).alias("p1"), (F.col("score_a") * 2 - 0.8).alias("p2"))
    return metrics.renormalise(rows, ["p0", "p1", "p2"])


_FIELD = resample.FIELD
_field = lambda text, i: f"CAST('0x' || substr(md5({text}), {8 * i + 1}, 8) AS BIGINT) % {_FIELD}"
block("bootstrap_weights", f"""
SELECT r, y, score, len(list_filter([{', '.join(map(str, resample.CUTS))}], lambda c: c < (h0 * c0 + h1 * c1 + c2) % {_FIELD})) AS w
FROM (SELECT y, score_a AS score, {_field("machine_id || '|' || bucket", 0)} AS h0, {_field("machine_id || '|' || bucket", 1)} AS h1
      FROM short_rows WHERE split = 'test')
CROSS JOIN (SELECT r, {', '.join(f"{_field(chr(114) + " || '|42'", i)} AS c{i}" for i in range(3))} FROM range(1, 1001) t(r))""", "short_rows")


@query("m10_bootstrap_interval", sql("""
SELECT quantile_cont(ap, 0.025) AS low, quantile_cont(ap, 0.975) AS high FROM (
  SELECT r, sum(pos / p * tp / seen) FILTER (WHERE seen > 0) AS ap FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(tot) OVER w AS seen, sum(pos) OVER (PARTITION BY r) AS p, sum(tot) OVER (PARTITION BY r) AS n
    FROM (SELECT r, score, CAST(sum(w * y) AS DOUBLE) AS pos, CAST(sum(w) AS DOUBLE) AS tot FROM bootstrap_weights GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY r ORDER BY score DESC))
  WHERE p > 0 AND p < n GROUP BY 1)""", "bootstrap_weights", reals="low high"))
def bootstrap_interval(spark, sf):
    return metrics.bootstrap_interval(_binary(spark, sf).filter(F.col("split") == "test"), [], ["machine_id", "bucket"],
                                      score="score_a")


block("fold_rows", """
SELECT fold, CAST(spike_in_15m AS BIGINT) AS y, score_a AS score FROM folds f JOIN scores s
  ON s.machine_id = f.machine_id AND s.bucket = f.bucket WHERE role = 'test' AND spike_in_15m IS NOT NULL""", "folds", "scores")
block("fold_metrics", rank_sql("fold_rows", "fold"), "fold_rows")


def _fold_metrics(spark, sf):
    rows = splits.walk_forward(scores(spark, sf)).filter((F.col("role") == "test") & F.col("spike_in_15m").isNotNull())
    return metrics.ranking(rows.withColumn("y", F.col("spike_in_15m").cast("long")), ["fold"], score="score_a")


@query("a24_fold_summary", sql("""
SELECT 'pr_auc' AS measure, avg(pr_auc) AS mean, stddev_pop(pr_auc) AS std FROM fold_metrics UNION ALL
SELECT 'roc_auc', avg(roc_auc), stddev_pop(roc_auc) FROM fold_metrics""", "fold_metrics", reals="mean std"))
def fold_summary(spark, sf):
    return metrics.fold_summary(_fold_metrics(spark, sf), ["pr_auc", "roc_auc"])


@query("m11_kendall_trend", sql("""
SELECT tau, CASE WHEN tau < -0.3 THEN 'declining' WHEN tau > 0.3 THEN 'improving' ELSE 'stable' END AS direction FROM (
  SELECT sum(sign(b.pr_auc - a.pr_auc)) / sqrt(count(*) * count(*) FILTER (WHERE a.pr_auc <> b.pr_auc)) AS tau
  FROM fold_metrics a JOIN fold_metrics b ON a.fold < b.fold)""", "fold_metrics", reals="tau"))
def kendall_trend(spark, sf):
    return metrics.kendall_trend(_fold_metrics(spark, sf), "fold", "pr_auc")


@query("m12_random_level", sql("""
SELECT split, avg(r) AS random_pr_auc FROM (
  SELECT split, severity_in_60m, count(*) / sum(count(*)) OVER (PARTITION BY split) AS r FROM split_scores
  WHERE severity_in_60m IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "split_scores", reals="random_pr_auc"))
def random_level(spark, sf):
    rows = splits.chronological(scores(spark, sf)).filter(F.col("severity_in_60m").isNotNull())
    return metrics.random_level(rows, ["split"], "severity_in_60m")


@query("f10_transfer_decision", sql(f"""
SELECT label, metric, source, metric / source AS retention, CASE WHEN metric / source IS NULL OR source <= 0 THEN 'undetermined'
       WHEN metric / source >= 0.7 THEN 'deploy' WHEN metric / source >= 0.4 THEN 'adapt' ELSE 'retrain' END AS decision FROM (
  SELECT 'spike_in_15m' AS label, max(pr_auc) FILTER (WHERE split = 'test') AS metric,
         max(pr_auc) FILTER (WHERE split = 'train') AS source FROM ({rank_sql('ranked', 'split')}))""", "ranked",
                                    reals="metric source retention"))
def transfer_decision(spark, sf):
    by_split = metrics.ranking(_binary(spark, sf), ["split"], score="score_a")
    pick = lambda s: F.max(F.when(F.col("split") == s, F.col("pr_auc")))
    return by_split.agg(pick("test").alias("metric"), pick("train").alias("source")).select(
        F.lit("spike_in_15m").alias("label"), "metric", "source", (F.col("metric") / F.col("source")).alias("retention"),
        X.transfer_decision("metric", "source").alias("decision"))


@query("t3_cascade_rows", sql("""
SELECT machine_id, bucket, CAST(severity_in_60m = 2 AS BIGINT) AS severe FROM scores WHERE severity_in_60m > 0""",
                              "scores"))
def cascade_rows(spark, sf):
    from tidewatch.operators.models import cascade_rows as cascade
    return cascade(scores(spark, sf)).select("machine_id", "bucket", "severe")


@query("t8_fold_class_counts", sql("""
SELECT fold, role, count(*) FILTER (WHERE severity_in_60m = 0) AS n_0, count(*) FILTER (WHERE severity_in_60m = 1) AS n_1,
       count(*) FILTER (WHERE severity_in_60m = 2) AS n_2
FROM folds f JOIN scores s ON s.machine_id = f.machine_id AND s.bucket = f.bucket WHERE severity_in_60m IS NOT NULL
GROUP BY 1, 2""", "folds", "scores"))
def fold_class_counts(spark, sf):
    rows = splits.walk_forward(scores(spark, sf)).filter(F.col("severity_in_60m").isNotNull())
    return metrics.fold_class_counts(rows, ["fold", "role"], "severity_in_60m")


# --- attribution ------------------------------------------------------------------------------------

_SIG = [*S.SIGNALS, "n_tasks"]
block("latest", f"SELECT machine_id, {', '.join(f'CAST(arg_max({s}, bucket) AS DOUBLE) AS {s}' for s in _SIG)} FROM agg GROUP BY 1",
      "agg")
block("contributions", " UNION ALL ".join(
    f"SELECT machine_id, class, '{s}' AS feature, {s} * (class - 1.25e0) AS contribution FROM latest, range(0, 3) r(class)"
    for s in _SIG), "latest")


def _contributions(spark, sf):
    """Signed per-class contributions of the newest row of each machine."""
    newest = fx.agg(spark, sf).groupBy("machine_id").agg(F.max_by(F.struct(*_SIG), "bucket").alias("r")) \
        .select("machine_id", *[F.col(f"r.{s}").cast("double").alias(s) for s in _SIG])
    long = newest.unpivot(["machine_id"], _SIG, "feature", "value")
    classes = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("class")
    return long.select("machine_id", classes, "feature", "value").withColumn(
        "contribution", F.col("value") * (F.col("class") - 1.25))


@query("k2_top_contributions", sql("""
SELECT machine_id, r AS place, feature, share FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY round(share, 9) DESC, feature) AS r FROM (
    SELECT machine_id, feature, CASE WHEN sum(c) OVER (PARTITION BY machine_id) > 0 THEN c / sum(c) OVER (PARTITION BY machine_id)
           ELSE 1e0 / count(*) OVER (PARTITION BY machine_id) END AS share
    FROM (SELECT machine_id, feature, sum(abs(contribution)) AS c FROM contributions GROUP BY 1, 2))) WHERE r <= 3""",
                                   "contributions", reals="share"))
def top_contributions(spark, sf):
    from tidewatch.operators.models import top_contributions as top
    return top(_contributions(spark, sf), 3)


block("gain", "SELECT feature, sum(abs(contribution)) AS gain FROM contributions GROUP BY 1", "contributions")


@query("k3_top_features", sql("""
SELECT feature, gain / (SELECT sum(gain) FROM gain) AS gain_share FROM gain ORDER BY gain DESC, feature LIMIT 4""", "gain",
                              reals="gain_share"))
def top_features(spark, sf):
    from tidewatch.operators.models import normalised_gain
    gain = _contributions(spark, sf).groupBy("feature").agg(F.sum(F.abs("contribution")).alias("gain"))
    return normalised_gain(gain).orderBy(F.desc("gain_share"), "feature").limit(4)


@query("j11_feature_groups", sql("""
SELECT feature, gain, CASE WHEN feature = 'other_signal' THEN 'Other' ELSE 'Raw Signal' END AS feature_group
FROM (SELECT * FROM gain UNION ALL SELECT 'other_signal', sum(gain) FROM gain)""", "gain", reals="gain"))
def feature_groups(spark, sf):
    gain = _contributions(spark, sf).groupBy("feature").agg(F.sum(F.abs("contribution")).alias("gain"))
    extra = gain.agg(F.sum("gain").alias("gain")).select(F.lit("other_signal").alias("feature"), "gain")
    return with_feature_group(gain.unionByName(extra))
