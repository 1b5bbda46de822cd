"""Queries over scoring logic, summaries, service levels, streams and models."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scalar as X
from tidewatch.operators import bundle, chunks, metrics, models, profile, scoring, series, splits, thresholds
from tidewatch.plans import features, fixtures as fx
from tidewatch.plans.q_eval import scores
from tidewatch.plans.registry import as_text, block, query, sql
from tidewatch.session import fresh_path, materialise
from tidewatch.streaming import streams

ALARMS = {"15m": 0.45, "30m": 0.5, "45m": 0.4, "60m": 0.25, "severe": 0.55}
_REAL_FEATURES = " ".join(c for c in S.MODEL_FEATURES if c != "n_tasks")
_OPTS = dict(bucket_seconds=fx.HOUR, slots=fx.SLOTS)

# --- history and live features ------------------------------------------------------------------

block("history_rows", """
SELECT machine_id, count(*) AS observations_used, CASE WHEN count(*) < 12 THEN 'cold_start' WHEN count(*) < 24 THEN 'degraded'
       ELSE 'success' END AS status FROM live_agg GROUP BY 1""", "live_agg")


def _live(spark, sf):
    agg = fx.agg_table(spark, sf)
    limits = materialise(thresholds.learn(agg, thresholds.split_point(agg, S.TRAIN_RATIO)), "thresholds")
    return fx.live(agg), limits


@query("i1_history_status", sql("""
SELECT *, CASE WHEN status <> 'cold_start' THEN round_even(least(observations_used, 24) / 24e0, 4) END AS data_quality
FROM history_rows""", "history_rows", reals="data_quality"))
def history_status(spark, sf):
    return scoring.history(fx.live(fx.agg(spark, sf)))


@query("i2_live_features", sql(f"SELECT machine_id, bucket, time_us, {', '.join(S.MODEL_FEATURES)} FROM live_feat", "live_feat",
                               reals=_REAL_FEATURES))
def live_features(spark, sf):
    rows, limits = _live(spark, sf)
    known = scoring.limits_for(rows, limits).drop("threshold_source")
    return features.build(rows, known, None, labels=False, **_OPTS)


# --- decisions: rule-made probabilities on the newest row of each machine ------------------------

block("probs", """
SELECT h.machine_id, h.observations_used, h.status,
       CASE WHEN h.status <> 'cold_start' THEN least(1e0, f.cpu_vs_p95 * 0.5) END AS p15,
       CASE WHEN h.status = 'success' THEN least(1e0, f.cpu_spike_rate_24 * 4) END AS p30,
       CASE WHEN h.status <> 'cold_start' THEN least(1e0, f.peak_cpu_vs_p95 * 0.4) END AS p45,
       CASE WHEN h.status <> 'cold_start' THEN 1 - f.total_cpu / (1 + f.total_cpu) END AS p_no,
       CASE WHEN h.status <> 'cold_start' THEN f.total_cpu / (1 + f.total_cpu) * 0.6e0 END AS p_mod,
       CASE WHEN h.status <> 'cold_start' THEN f.total_cpu / (1 + f.total_cpu) * 0.4e0 END AS p_sev,
       CASE WHEN h.observations_used >= 18 THEN least(1e0, f.cpu_vs_p99 * 0.6) END AS p_ovr
FROM history_rows h LEFT JOIN (SELECT machine_id, max(bucket) AS bucket FROM live_agg GROUP BY 1) l USING (machine_id)
LEFT JOIN live_feat f ON f.machine_id = l.machine_id AND f.bucket = l.bucket""", "history_rows", "live_feat", "live_agg")
block("monotone", """
SELECT *, p_mod + p_sev AS any60, p15 AS p_spike_15m,
       CASE WHEN k THEN greatest(p15, p30) ELSE p30 END AS p_spike_30m,
       CASE WHEN k THEN greatest(p15, p30, p45) ELSE p45 END AS p_spike_45m,
       CASE WHEN k THEN greatest(p15, p30, p45, p_mod + p_sev) ELSE p_mod + p_sev END AS p_spike_60m
FROM (SELECT *, p15 IS NOT NULL AND p30 IS NOT NULL AND p45 IS NOT NULL AND p_mod IS NOT NULL AS k FROM probs)""", "probs")
block("verdict", """
SELECT *, p_spike_15m >= 0.45 AS alarm_15m, p_spike_30m >= 0.5 AS alarm_30m, p_spike_45m >= 0.4 AS alarm_45m,
       CAST(CASE WHEN p_mod IS NULL THEN NULL WHEN p_no >= p_mod AND p_no >= p_sev THEN 0 WHEN p_mod >= p_sev THEN 1 ELSE 2 END
         AS BIGINT) AS severity_class,
       CASE WHEN p_mod IS NULL THEN NULL WHEN p_ovr IS NOT NULL THEN any60 >= 0.15 AND p_ovr >= 0.55 ELSE p_sev >= 0.25 END
         AS is_severe
FROM monotone""", "monotone")
block("decided", """
SELECT *, severity_class >= 1 AS is_spike,
       CASE WHEN coalesce(p15, p30, p45, p_mod) IS NULL THEN NULL WHEN coalesce(alarm_15m, false) THEN 'preempt_now'
            WHEN coalesce(alarm_30m, false) THEN 'migrate_jobs' WHEN coalesce(alarm_45m, false) THEN 'defer_new_jobs'
            WHEN severity_class >= 1 AND is_severe THEN 'defer_batch' WHEN severity_class >= 1 THEN 'monitor' ELSE 'normal' END
         AS recommended_action FROM verdict""", "verdict")
_PROBS = ["p15", "p30", "p45", "p_no", "p_mod", "p_sev", "p_ovr"]


def _probs(spark, sf):
    rows, limits = _live(spark, sf)
    chunked = series.measured_series(rows, limits, horizon=0)
    newest = scoring.latest(series.observed_rows(series.measured_features(chunked, fx.SLOTS)).select(
        "machine_id", "bucket", "total_cpu", "cpu_vs_p95", "cpu_spike_rate_24", "peak_cpu_vs_p95", "cpu_vs_p99"))
    warm = F.col("status") != "cold_start"
    one = lambda c: F.least(F.lit(1.0), c)
    share = F.col("total_cpu") / (1 + F.col("total_cpu"))
    made = {"p15": one(F.col("cpu_vs_p95") * 0.5),
            "p30": F.when(F.col("status") == "success", one(F.col("cpu_spike_rate_24") * 4)),
            "p45": one(F.col("peak_cpu_vs_p95") * 0.4), "p_no": 1 - share, "p_mod": share * 0.6, "p_sev": share * 0.4,
            "p_ovr": F.when(F.col("observations_used") >= 18, one(F.col("cpu_vs_p99") * 0.6))}
    return scoring.history(rows).join(newest, "machine_id", "left").withColumns(
        {k: F.when(warm, v) for k, v in made.items()})


def _decided(spark, sf):
    return scoring.decide(_probs(spark, sf), ALARMS)


_P_SPIKE = "p_spike_15m p_spike_30m p_spike_45m p_spike_60m"


@query("i4_monotone_horizons", sql("SELECT machine_id, p_spike_15m, p_spike_30m, p_spike_45m, p_spike_60m FROM monotone",
                                   "monotone", reals=_P_SPIKE))
def monotone_horizons(spark, sf):
    return _decided(spark, sf).select("machine_id", *_P_SPIKE.split())


@query("i5_cascade_gate", sql("SELECT machine_id, any60, p_ovr, is_severe FROM verdict", "verdict", reals="any60 p_ovr", flags="is_severe"))
def cascade_gate(spark, sf):
    return as_text(_decided(spark, sf).select("machine_id", (F.col("p_mod") + F.col("p_sev")).alias("any60"), "p_ovr", "is_severe"), "is_severe")


@query("i6_horizon_flags", sql("SELECT machine_id, alarm_15m, alarm_30m, alarm_45m, severity_class, is_spike FROM decided",
                               "decided", flags="alarm_15m alarm_30m alarm_45m is_spike"))
def horizon_flags(spark, sf):
    return as_text(_decided(spark, sf).select("machine_id", "alarm_15m", "alarm_30m", "alarm_45m", "severity_class", "is_spike"), "alarm_15m alarm_30m alarm_45m is_spike")


@query("i6_threshold_override", sql("""
SELECT machine_id, p_spike_15m >= 0.2 AS alarm_15m, p_spike_30m >= 0.2 AS alarm_30m, p_spike_45m >= 0.2 AS alarm_45m
FROM monotone""", "monotone", flags="alarm_15m alarm_30m alarm_45m"))
def threshold_override(spark, sf):
    return as_text(scoring.decide(_probs(spark, sf), ALARMS, override=0.2).select("machine_id", "alarm_15m", "alarm_30m", "alarm_45m"), "alarm_15m alarm_30m alarm_45m")


@query("f5_action_ladder", sql("SELECT machine_id, status, recommended_action FROM decided", "decided"))
def action_ladder(spark, sf):
    return _decided(spark, sf).select("machine_id", "status", "recommended_action")


@query("i7_prediction_rows", sql("""
SELECT machine_id, status, observations_used, round(p_spike_15m, 6) AS p_spike_15m, alarm_15m AS is_spike_15m,
       round(p_spike_60m, 6) AS p_spike_60m, is_spike AS is_spike_60m,
       CASE WHEN p_spike_60m IS NOT NULL THEN 0.25e0 END AS alarm_threshold_60m, severity_class, is_severe,
       round(p_mod, 6) AS p_moderate_60m, CASE WHEN p_spike_60m IS NOT NULL THEN is_severe END AS is_severe_60m,
       CASE WHEN p_spike_60m IS NOT NULL AND p_ovr IS NOT NULL THEN 0.55e0 END AS alarm_threshold_ovr,
       CASE WHEN status <> 'cold_start' THEN 0.25e0 END AS alarm_threshold, 'v1' AS model_version,
       CASE WHEN status <> 'cold_start' THEN CAST(p_spike_15m IS NOT NULL AS BIGINT) + CAST(p_spike_30m IS NOT NULL AS BIGINT)
            + CAST(p_spike_45m IS NOT NULL AS BIGINT) + CAST(p_spike_60m IS NOT NULL AS BIGINT) END AS horizons,
       CASE WHEN status <> 'cold_start' THEN round_even(least(observations_used, 24) / 24e0, 4) END AS quality,
       recommended_action FROM decided""", "decided", reals="p_spike_15m p_spike_60m alarm_threshold_60m quality p_moderate_60m alarm_threshold_ovr alarm_threshold",
                                            flags="is_spike_15m is_spike_60m is_severe is_severe_60m"))
def prediction_rows(spark, sf):
    """The nested row, flattened for comparison."""
    nested = scoring.envelope(_decided(spark, sf), ALARMS, model_version="v1")
    at = lambda h, f: F.col("imminence")[h][f]
    return as_text(nested.select(
        "machine_id", "status", "observations_used", at("15m", "p_spike").alias("p_spike_15m"),
        at("15m", "is_spike").alias("is_spike_15m"), at("60m", "p_spike").alias("p_spike_60m"),
        at("60m", "is_spike").alias("is_spike_60m"), at("60m", "alarm_threshold").alias("alarm_threshold_60m"),
        at("60m", "p_moderate").alias("p_moderate_60m"), at("60m", "is_severe").alias("is_severe_60m"),
        at("60m", "alarm_threshold_ovr").alias("alarm_threshold_ovr"), "alarm_threshold", "model_version",
        F.size("imminence").cast("long").alias("horizons"), "severity_class", "is_severe", F.col("data_quality.score").alias("quality"),
        "recommended_action"), "is_spike_15m is_spike_60m is_severe is_severe_60m")


@query("i7_batch_counters", sql("""
SELECT count(*) AS machines_total, count(*) FILTER (WHERE status <> 'cold_start') AS machines_predicted,
       count(*) FILTER (WHERE status = 'cold_start') AS machines_cold_start FROM history_rows""", "history_rows"))
def batch_counters(spark, sf):
    return scoring.batch_counters(scoring.history(fx.live(fx.agg(spark, sf))))


# --- cycles: one prediction per machine and hour ---------------------------------------------------

block("pred", """
SELECT bucket AS cycle, machine_id, CASE WHEN r < 12 THEN 'cold_start' WHEN r < 24 THEN 'degraded' ELSE 'success' END AS status,
       CASE WHEN r >= 12 THEN 0.5e0 * score_a END AS p_moderate, CASE WHEN r >= 12 THEN 0.45e0 * score_b END AS p_severe,
       0.35e0 AS alarm_threshold, CASE WHEN r >= 12 THEN score_a > 0.6 END AS alarm_15m,
       CASE WHEN r >= 12 THEN score_b > 0.55 END AS alarm_30m, CASE WHEN r >= 12 THEN score_b > 0.5 END AS alarm_45m,
       CASE WHEN r >= 12 THEN 0.5e0 * score_a + 0.45e0 * score_b > 0.3 END AS is_spike,
       CASE WHEN r >= 12 THEN 0.45e0 * score_b > 0.2 END AS is_severe
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY bucket) AS r,
             total_cpu / (1 + total_cpu) AS score_a, peak_cpu / (1 + peak_cpu) AS score_b FROM agg)""", "agg")
block("pred_action", """
SELECT *, CASE WHEN status = 'cold_start' THEN NULL WHEN alarm_15m THEN 'preempt_now' WHEN alarm_30m THEN 'migrate_jobs'
               WHEN alarm_45m THEN 'defer_new_jobs' WHEN is_spike AND is_severe THEN 'defer_batch' WHEN is_spike THEN 'monitor'
               ELSE 'normal' END AS recommended_action FROM pred""", "pred")


def predictions(spark, sf):
    rows = chunks.owned(chunks.row_chunks(fx.agg(spark, sf), back=0))
    seen = F.col("pos") + 1
    warm = lambda c: F.when(seen >= S.COLD_START_ROWS, c)
    a, b = F.col("total_cpu") / (1 + F.col("total_cpu")), F.col("peak_cpu") / (1 + F.col("peak_cpu"))
    made = rows.select(
        F.col("bucket").alias("cycle"), "machine_id", X.history_status(seen).alias("status"),
        warm(0.5 * a).alias("p_moderate"), warm(0.45 * b).alias("p_severe"), F.lit(0.35).alias("alarm_threshold"),
        warm(a > 0.6).alias("alarm_15m"), warm(b > 0.55).alias("alarm_30m"), warm(b > 0.5).alias("alarm_45m"),
        warm(0.5 * a + 0.45 * b > 0.3).alias("is_spike"), warm(0.45 * b > 0.2).alias("is_severe"))
    ladder = X.recommended_action("alarm_15m", "alarm_30m", "alarm_45m", F.col("is_spike").cast("int"), "is_severe")
    return materialise(made.withColumn("recommended_action", F.when(F.col("status") != "cold_start", ladder)), "predictions")


block("smooth_walk", """
SELECT n.machine_id, n.cycle, n.r, p AS s FROM warm_pred n WHERE r = 1 UNION ALL
SELECT n.machine_id, n.cycle, n.r, 0.5e0 * n.p + 0.5e0 * w.s FROM smooth_walk w
JOIN warm_pred n ON n.machine_id = w.machine_id AND n.r = w.r + 1""", "warm_pred")
block("warm_pred", """
SELECT machine_id, cycle, p_moderate + p_severe AS p, row_number() OVER (PARTITION BY machine_id ORDER BY cycle) AS r
FROM pred WHERE status <> 'cold_start'""", "pred")
block("smoothed", """
SELECT p.machine_id, p.cycle, p.status, w.s AS p_spike_smoothed, p.alarm_15m, p.alarm_30m, p.alarm_45m,
       CASE WHEN w.s < alarm_threshold THEN false ELSE is_spike END AS is_spike,
       CASE WHEN w.s < alarm_threshold THEN false ELSE is_severe END AS is_severe,
       CASE WHEN w.s < alarm_threshold THEN 'normal' ELSE recommended_action END AS recommended_action
FROM pred_action p LEFT JOIN smooth_walk w ON w.machine_id = p.machine_id AND w.cycle = p.cycle""", "pred_action", "smooth_walk")
block("streaks", """
SELECT machine_id, cycle, CAST(r - coalesce(max(CASE WHEN NOT is_spike THEN r END) OVER (PARTITION BY machine_id ORDER BY cycle
         ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS consecutive_alarms
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY cycle) AS r FROM smoothed WHERE status <> 'cold_start')""",
      "smoothed")
block("debounced", """
SELECT s.machine_id, s.cycle, s.status, s.p_spike_smoothed, s.alarm_15m, s.alarm_30m, s.alarm_45m,
       coalesce(k.consecutive_alarms, 0) AS consecutive_alarms,
       CASE WHEN k.consecutive_alarms = 1 THEN false ELSE is_spike END AS is_spike,
       CASE WHEN k.consecutive_alarms = 1 THEN false ELSE is_severe END AS is_severe,
       CASE WHEN k.consecutive_alarms = 1 THEN 'normal' ELSE recommended_action END AS recommended_action
FROM smoothed s LEFT JOIN streaks k ON k.machine_id = s.machine_id AND k.cycle = s.cycle""", "smoothed", "streaks")
_SMOOTH_COLS = ["machine_id", "cycle", "status", "p_spike_smoothed", "is_spike", "is_severe", "recommended_action"]
_BOUNCE_COLS = [*_SMOOTH_COLS, "consecutive_alarms"]


@query("w17_consecutive_spikes", sql("""
SELECT machine_id, cycle, CAST(r - coalesce(max(CASE WHEN NOT is_spike THEN r END) OVER (PARTITION BY machine_id ORDER BY cycle
         ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS consecutive
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY cycle) AS r FROM pred WHERE status <> 'cold_start')""", "pred"))
def consecutive_spikes(spark, sf):
    warm = predictions(spark, sf).filter(F.col("status") != "cold_start").select("machine_id", "cycle", "is_spike")
    return profile.run_lengths(warm, F.col("is_spike"), "consecutive", order="cycle").drop("is_spike")


@query("st4_smoothing", sql(f"SELECT {', '.join(_SMOOTH_COLS)} FROM smoothed", "smoothed", reals="p_spike_smoothed", flags="is_spike is_severe"))
def smoothing(spark, sf):
    return as_text(scoring.smooth(predictions(spark, sf)).select(*_SMOOTH_COLS), "is_spike is_severe")


@query("st5_debounce", sql(f"SELECT {', '.join(_BOUNCE_COLS)} FROM debounced", "debounced", reals="p_spike_smoothed", flags="is_spike is_severe"))
def debounce(spark, sf):
    return as_text(scoring.debounce(scoring.smooth(predictions(spark, sf))).select(*_BOUNCE_COLS), "is_spike is_severe")


def _final(spark, sf):
    return scoring.debounce(scoring.smooth(predictions(spark, sf)))


@query("a23_fleet_summary", sql("""
SELECT cycle, count(*) FILTER (WHERE w AND alarm_15m) AS spikes_in_15m, count(*) FILTER (WHERE w AND alarm_30m) AS spikes_in_30m,
       count(*) FILTER (WHERE w AND alarm_45m) AS spikes_in_45m, count(*) FILTER (WHERE w AND is_spike) AS spikes_in_60m,
       count(*) FILTER (WHERE recommended_action IN ('preempt_now', 'migrate_jobs')) AS nodes_requiring_action
FROM (SELECT *, status <> 'cold_start' AS w FROM debounced) GROUP BY 1""", "debounced"))
def fleet_summary(spark, sf):
    return scoring.fleet_summary(_final(spark, sf), ["cycle"])


@query("f6_alarm_source", sql("""
SELECT machine_id, cycle, h AS horizon, CASE WHEN status <> 'cold_start' THEN coalesce(h IN ('15m', '30m', '45m'), false) END
         AS spike_imminent,
       CASE WHEN status = 'cold_start' THEN NULL WHEN h IN ('15m', '30m', '45m') THEN 'binary_' || h
            WHEN is_spike THEN '60m_severity' ELSE 'none' END AS alarm_source
FROM (SELECT *, CASE WHEN status = 'cold_start' THEN NULL WHEN alarm_15m THEN '15m' WHEN alarm_30m THEN '30m'
                     WHEN alarm_45m THEN '45m' WHEN is_spike THEN '60m' END AS h FROM debounced)""", "debounced", flags="spike_imminent"))
def alarm_source(spark, sf):
    return as_text(scoring.node_summary(_final(spark, sf)).select("machine_id", "cycle", "horizon", "spike_imminent", "alarm_source"), "spike_imminent")


@query("f7_scheduler_score", sql("""
SELECT machine_id, cycle, CAST(round_even(100 * (1 - (p_moderate + p_severe)), 0) AS BIGINT) AS scheduler_score FROM pred""", "pred"))
def scheduler_score(spark, sf):
    raw = predictions(spark, sf).withColumn("p_spike_smoothed", F.col("p_moderate") + F.col("p_severe"))
    return scoring.node_summary(raw).select("machine_id", "cycle", "scheduler_score")


@query("f8_finite_or_null", sql("""
SELECT machine_id, bucket, CASE WHEN n_tasks <= 2 THEN NULL ELSE round_even(total_cpu / 3, 4) END AS value FROM agg""", "agg",
                                reals="value"))
def finite_or_null(spark, sf):
    dirty = F.when(F.col("n_tasks") == 1, F.lit(float("nan"))).when(F.col("n_tasks") == 2, F.lit(float("inf"))) \
        .otherwise(F.col("total_cpu") / 3)
    return fx.agg(spark, sf).select("machine_id", "bucket", X.finite_or_null(dirty, 4).alias("value"))


@query("f9_model_version", sql("""
SELECT l_suppkey AS model_id, CASE WHEN l_suppkey % 7 = 0 THEN 'unknown' ELSE strftime(max(l_shipdate), '%Y%m%dT%H%M%SZ') END
       || '_' || CASE WHEN l_suppkey % 11 = 0 THEN '000000' ELSE substr(sha256(string_agg(DISTINCT l_returnflag || l_linestatus, '|'
            ORDER BY l_returnflag || l_linestatus)), 1, 6) END AS model_version
FROM lineitem GROUP BY 1"""))
def model_version(spark, sf):
    """One model per supplier: trained at its last shipment, on columns named by its flags."""
    names = F.collect_set(F.concat("l_returnflag", "l_linestatus"))
    per = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(
        F.max("l_shipdate").alias("at"), names.alias("cols"))
    at = F.when(F.col("model_id") % 7 != 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"))
    cols = F.when(F.col("model_id") % 11 != 0, F.col("cols"))
    return per.select("model_id", X.model_version(at, cols).alias("model_version"))


# --- service levels ------------------------------------------------------------------------------------

block("cycle_stats", """
SELECT *, CASE WHEN machines_predicted > 0 THEN alarm_count / CAST(machines_predicted AS DOUBLE) END AS alarm_rate,
       CASE WHEN machines_total > 0 THEN machines_cold_start / CAST(machines_total AS DOUBLE) END AS cold_start_rate FROM (
  SELECT cycle, count(*) AS machines_total, count(*) FILTER (WHERE status <> 'cold_start') AS machines_predicted,
         count(*) FILTER (WHERE status = 'cold_start') AS machines_cold_start,
         count(*) FILTER (WHERE recommended_action NOT IN ('normal', 'monitor')) AS alarm_count FROM pred_action GROUP BY 1)""",
      "pred_action")
block("slo", """
SELECT cycle AS cycle_index, round_even(machines_total / 128e0, 3) AS latency_s, cycle % 11 <> 0 AS success,
       CASE WHEN cycle % 11 <> 0 THEN machines_total END AS machines_total,
       CASE WHEN cycle % 11 <> 0 THEN machines_predicted END AS machines_predicted,
       CASE WHEN cycle % 11 <> 0 THEN machines_cold_start END AS machines_cold_start,
       CASE WHEN cycle % 11 <> 0 THEN alarm_count END AS alarm_count,
       CASE WHEN cycle % 11 <> 0 THEN round_even(alarm_rate, 4) END AS alarm_rate,
       CASE WHEN cycle % 11 <> 0 THEN round_even(cold_start_rate, 4) END AS cold_start_rate FROM cycle_stats""", "cycle_stats")
block("slo_window", "SELECT * FROM slo ORDER BY cycle_index DESC LIMIT 300", "slo")
_SLO_REALS = "latency_s alarm_rate cold_start_rate"


def _slo(spark, sf):
    stats = scoring.cycle_stats(predictions(spark, sf))
    return scoring.slo_records(stats, F.col("machines_total") / 128.0, F.col("cycle") % 11 != 0)


@query("a21_cycle_stats", sql("SELECT * FROM cycle_stats", "cycle_stats", reals="alarm_rate cold_start_rate"))
def cycle_stats(spark, sf):
    return scoring.cycle_stats(predictions(spark, sf))


@query("k4_first_alarms", sql("""
SELECT cycle, string_agg(machine_id, ', ' ORDER BY machine_id) AS first_alarms FROM (
  SELECT cycle, machine_id, row_number() OVER (PARTITION BY cycle ORDER BY machine_id) AS r FROM pred_action
  WHERE recommended_action NOT IN ('normal', 'monitor')) WHERE r <= 5 GROUP BY 1""", "pred_action"))
def first_alarms(spark, sf):
    return scoring.first_alarms(predictions(spark, sf))


@query("w16_last_cycles", sql("SELECT cycle_index, latency_s, success FROM slo_window", "slo_window", reals="latency_s"))
def last_cycles(spark, sf):
    return scoring.last_cycles(_slo(spark, sf)).select("cycle_index", "latency_s", "success")


@query("st6_slo_records", sql("SELECT * FROM slo_window", "slo_window", reals=_SLO_REALS))
def slo_records(spark, sf):
    return scoring.last_cycles(_slo(spark, sf))


@query("a22_slo_summary", sql("""
SELECT count(*) AS window_cycles, min(cycle_index) AS window_start, max(cycle_index) AS window_end,
       avg(CASE WHEN success THEN 1e0 ELSE 0 END) AS success_rate, quantile_cont(latency_s, 0.5) AS latency_p50_s,
       quantile_cont(latency_s, 0.95) AS latency_p95_s, avg(alarm_rate) AS alarm_rate_mean,
       CASE WHEN count(alarm_rate) >= 2 THEN stddev_pop(alarm_rate) END AS alarm_rate_std,
       avg(cold_start_rate) AS cold_start_rate_mean FROM slo_window""", "slo_window",
                              reals="success_rate latency_p50_s latency_p95_s alarm_rate_mean alarm_rate_std cold_start_rate_mean"))
def slo_summary(spark, sf):
    return scoring.slo_summary(scoring.last_cycles(_slo(spark, sf)))


# --- streams ---------------------------------------------------------------------------------------------

def _event_stream(spark, sf):
    static = fx.table(spark, sf, "events")
    return streams.landed_files(spark, sf, static.schema, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("machine_id"), "event_type", "value")


@query("st1_stream_rollup", sql("SELECT machine_id, bucket, s / 100e0 AS total_value, m / 100e0 AS peak_value, n_tasks FROM raw_agg",
                                "raw_agg", reals="total_value peak_value"))
def stream_rollup(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    out = streams.rollup_stream(
        _event_stream(spark, sf), [F.sum(cents).alias("s"), F.max(cents).alias("m"), F.count(F.lit(1)).alias("n_tasks")],
        width="1 hour", lateness="40 days")
    path = fresh_path(spark, "rollup")
    streams.run_available(out, streams.versioned_sink(path), "rollup")
    return streams.newest_version(spark, path, ["machine_id", "bucket"]).select(
        "machine_id", "bucket", (F.col("s") / 100.0).alias("total_value"), (F.col("m") / 100.0).alias("peak_value"), "n_tasks")


@query("st2_lookback", sql("""
SELECT machine_id, bucket, count(*) OVER w AS rows_in_window, avg(total_cpu) OVER w AS mean_in_window FROM agg
WINDOW w AS (PARTITION BY machine_id ORDER BY bucket RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)""", "agg", reals="mean_in_window"))
def stream_lookback(spark, sf):
    """Rollup lands in three files by time; each micro-batch meets the recent past of the table."""
    agg = fx.agg_table(spark, sf).select("machine_id", "bucket", "total_cpu")
    landing = fresh_path(spark, "landing")
    third = agg.agg(F.struct(F.min("bucket").alias("lo"), (F.max("bucket") - F.min("bucket") + 1).alias("n")).alias("e")).scalar()
    slot = F.floor((F.col("bucket") - third["lo"]) * 3 / third["n"])
    staged = materialise(agg.withColumn("slot", slot), "staged")
    for i in range(3):
        staged.filter(F.col("slot") == i).drop("slot").coalesce(1).write.mode("append").parquet(landing)
    history, output = fresh_path(spark, "history"), fresh_path(spark, "lookback")
    stream = streams.landed_files(spark, landing, agg.schema)
    streams.run_available(stream, streams.lookback_sink(history, output), "lookback", mode="append")
    return spark.read.parquet(output).drop("batch")


@query("st2_late_rows", sql("""
SELECT machine_id, bucket, count(*) OVER w AS rows_in_window, avg(total_cpu) OVER w AS mean_in_window FROM agg
WINDOW w AS (PARTITION BY machine_id ORDER BY bucket RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)""", "agg", reals="mean_in_window"))
def stream_late_rows(spark, sf):
    """Every seventh bucket lands after all others; the change log's newest rows are those of the batch form."""
    agg = fx.agg_table(spark, sf).select("machine_id", "bucket", "total_cpu")
    landing = fresh_path(spark, "landing")
    for late in (False, True):
        agg.filter((F.col("bucket") % 7 == 0) == F.lit(late)).coalesce(1).write.mode("append").parquet(landing)
    history, output = fresh_path(spark, "history"), fresh_path(spark, "lookback")
    streams.run_available(streams.landed_files(spark, landing, agg.schema), streams.lookback_sink(history, output), "lookback", mode="append")
    return streams.newest_version(spark, output, ["machine_id", "bucket"])


block("cycle_part", """
SELECT a.*, (a.bucket - b.lo) * 3 // (b.hi - b.lo + 1) AS cycle FROM agg a, (SELECT min(bucket) AS lo, max(bucket) AS hi FROM agg) b""", "agg")
block("cycle_rows", """
SELECT c.cycle, r.machine_id, r.bucket, r.total_cpu FROM (SELECT cycle, max(bucket) AS last FROM cycle_part WHERE total_cpu < 20 GROUP BY 1) c
JOIN cycle_part r ON r.total_cpu < 20 AND r.bucket <= c.last AND r.bucket > c.last - 24 AND r.cycle <= c.cycle""", "cycle_part")


@query("st3_scoring_cycle", sql("""
SELECT cycle AS cycle_index, count(*) AS machines_total, count(*) FILTER (WHERE n >= 3) AS machines_predicted,
       count(*) FILTER (WHERE n < 3) AS machines_cold_start, count(*) FILTER (WHERE n >= 3 AND newest > mean) AS alarm_count, true AS success
FROM (SELECT cycle, machine_id, count(*) AS n, arg_max(total_cpu, bucket) AS newest, avg(total_cpu) AS mean FROM cycle_rows GROUP BY 1, 2)
GROUP BY 1""", "cycle_rows"))
def scoring_cycle(spark, sf):
    """Three micro-batches by time: rows set aside, newest features, decisions, alarms and a service-level row each."""
    agg = fx.agg_table(spark, sf).select("machine_id", "bucket", "total_cpu")
    extent = agg.agg(F.struct(F.min("bucket").alias("lo"), (F.max("bucket") - F.min("bucket") + 1).alias("n")).alias("e")).scalar()
    staged = materialise(agg.withColumn("slot", F.floor((F.col("bucket") - extent["lo"]) * 3 / extent["n"])), "staged")
    landing, root = fresh_path(spark, "landing"), fresh_path(spark, "cycle")
    for i in range(3):
        staged.filter(F.col("slot") == i).drop("slot").coalesce(1).write.mode("append").parquet(landing)

    def build(rows):
        return rows.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("total_cpu", "bucket").alias("newest"), F.avg("total_cpu").alias("mean"))

    def score(rows):
        cold = F.col("n") < 3
        return rows.select("machine_id", F.when(cold, "cold_start").otherwise("success").alias("status"),
                           F.when(~cold, F.when(F.col("newest") > F.col("mean"), "migrate_jobs").otherwise("normal")).alias("recommended_action"))

    sink = streams.scoring_cycle_sink(F.col("total_cpu") < 20, build, score, root)
    streams.run_available(streams.landed_files(spark, landing, agg.schema), sink, "cycle", mode="append")
    return spark.read.parquet(f"{root}/slo").select("cycle_index", "machines_total", "machines_predicted", "machines_cold_start", "alarm_count", "success")


@query("st3_quarantine_cycle", sql("""
SELECT count(*) AS rows_in, count(*) FILTER (WHERE event_type <> 'error' AND value >= 1) AS rows_accepted,
       count(*) FILTER (WHERE event_type = 'error' OR value < 1) AS rows_quarantined, true AS success FROM events"""))
def quarantine_cycle(spark, sf):
    root = fresh_path(spark, "cycle")
    valid = (F.col("event_type") != "error") & (F.col("value") >= 1)
    sink = streams.cycle_sink(valid, f"{root}/accepted", f"{root}/quarantine", f"{root}/slo")
    streams.run_available(_event_stream(spark, sf), sink, "cycle", mode="append")
    return spark.read.parquet(f"{root}/slo").drop("batch")


@query("st45_stream_alarm_state", sql(f"SELECT {', '.join(_BOUNCE_COLS)} FROM debounced", "debounced", reals="p_spike_smoothed", flags="is_spike is_severe"))
def stream_alarm_state(spark, sf):
    """Smoothing and debounce with keyed state over two micro-batches; equals the batch form."""
    rows = predictions(spark, sf)
    landing = fresh_path(spark, "landing")
    half = rows.agg(((F.min("cycle") + F.max("cycle")) / 2).alias("h")).scalar()
    for part in (F.col("cycle") <= half, F.col("cycle") > half):
        rows.filter(part).coalesce(1).write.mode("append").parquet(landing)
    out = fresh_path(spark, "alarms")
    stream = streams.alarm_states(streams.landed_files(spark, landing, rows.schema))
    streams.run_available(stream, streams.versioned_sink(out), "alarms", mode="append")
    return as_text(spark.read.parquet(out).select(*_BOUNCE_COLS), "is_spike is_severe")


@query("s12_incremental_parts", sql("""
SELECT start_time, end_time, machine_id, cpu_rate, max_cpu_rate, canonical_mem_usage, max_mem_usage, mean_disk_io_time, sample_portion
FROM task_usage""", "task_usage", reals="cpu_rate max_cpu_rate canonical_mem_usage max_mem_usage mean_disk_io_time"))
def incremental_parts(spark, sf):
    """Two runs over a growing folder; the second reads only what is new."""
    folder, table, checkpoint = (fresh_path(spark, n) for n in ("parts", "table", "checkpoint"))
    raw = fx.task_usage(spark, sf)
    wide = raw.select(*[F.col(S.TRACE_POSITIONS[i]).alias(f"c{i}") if i in S.TRACE_POSITIONS
                        else F.lit(float(i)).alias(f"c{i}") for i in range(20)], "batch_key")
    for parity in (0, 1):
        wide.filter(F.col("batch_key") % 2 == parity).drop("batch_key").write.mode("append") \
            .option("compression", "gzip").csv(folder)
        streams.ingest_parts(spark, folder, table, checkpoint, 24 * 365 * 60)
    return spark.read.parquet(table)


# --- models -------------------------------------------------------------------------------------------------

_SMALL = dict(trees=5, depth=3)


def _training(spark, sf):
    out = features.train(fx.agg_table(spark, sf), **_OPTS)
    return materialise(splits.chronological(out), "features")


def _part(df, name, label):
    return splits.labelled(df.filter(F.col("split") == name), label)


@query("t1_binary_model")
def binary_model(spark, sf):
    """At most 20 trees, fewer once the validation rows gain nothing."""
    rows = _training(spark, sf)
    model = models.fit_stopped(_part(rows, "train", "spike_in_15m"), _part(rows, "val", "spike_in_15m"), "spike_in_15m", depth=3)
    scored = models.positive_probability(model, _part(rows, "test", "spike_in_15m"), "score")
    return metrics.ranking(scored.withColumn("y", F.col("spike_in_15m")), [])


@query("t2_severity_model")
def severity_model(spark, sf):
    rows = _training(spark, sf)
    model = models.fit_severity(_part(rows, "train", "severity_in_60m"), trees=10, depth=5)
    names = ["p_no", "p_mod", "p_sev"]
    scored = models.class_probabilities(model, _part(rows, "test", "severity_in_60m"), names)
    return metrics.one_vs_rest(scored, [], "severity_in_60m", names)


@query("t4_parameter_search")
def parameter_search(spark, sf):
    train = _part(_training(spark, sf), "train", "spike_in_15m")
    return models.search(train, "spike_in_15m", [dict(trees=3, depth=2), dict(trees=3, depth=4)])


_GRID = [dict(trees=3, depth=d, step=s) for d in (2, 4) for s in (0.1, 0.3)]


@query("t4_halving_rungs", sql("""
SELECT rung, CASE rung WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS trials, CASE rung WHEN 0 THEN 2 ELSE 1 END AS kept, train_n, train_pos, tune_n, tune_pos
FROM (SELECT rung, count(*) FILTER (WHERE bucket <= mid AND bucket > hi - CAST(floor((hi - lo + 1) * share) AS BIGINT)) AS train_n,
             count(*) FILTER (WHERE bucket <= mid AND y > 0 AND bucket > hi - CAST(floor((hi - lo + 1) * share) AS BIGINT)) AS train_pos,
             count(*) FILTER (WHERE bucket > mid) AS tune_n, count(*) FILTER (WHERE bucket > mid AND y > 0) AS tune_pos
      FROM (SELECT *, min(bucket) FILTER (WHERE bucket <= mid) OVER () AS lo, max(bucket) FILTER (WHERE bucket <= mid) OVER () AS hi
            FROM (SELECT bucket, spike_in_15m AS y, min(bucket) OVER () + CAST(floor((max(bucket) OVER () - min(bucket) OVER ()) * 0.5e0) AS BIGINT) AS mid
                  FROM cv_rows WHERE spike_in_15m IS NOT NULL)),
           (VALUES (0, 0.25e0), (1, 0.5e0), (2, 1e0)) r(rung, share) GROUP BY rung)""", "cv_rows"))
def halving_rungs(spark, sf):
    """Trials and rows of each rung of a search by successive halving."""
    train = _part(_training(spark, sf), "train", "spike_in_15m")
    table, _, _ = models.halving(train, "spike_in_15m", _GRID, min_positive=1, refit=False)
    return table.groupBy("rung").agg(F.count(F.lit(1)).alias("trials"), F.count_if("kept").alias("kept"), *[
        F.max(c).alias(c) for c in ("train_n", "train_pos", "tune_n", "tune_pos")])


@query("t4_refitted_winner")
def refitted_winner(spark, sf):
    """Ranking quality on the test rows of the severity forest that won its search, fitted again on all training rows."""
    rows = _training(spark, sf)
    label, classes = "severity_in_60m", (0, 1, 2)
    _, _, model = models.halving(_part(rows, "train", label), label, [dict(trees=5, depth=d) for d in (3, 6)], classes=classes, min_positive=1)
    scored = models.class_probabilities(model, _part(rows, "test", label), bundle.CLASSES)
    return metrics.one_vs_rest(scored, [], label, bundle.CLASSES)


@query("t5_gain_importance")
def gain_importance(spark, sf):
    train = _part(_training(spark, sf), "train", "spike_in_15m")
    gain = models.gain_importance(models.fit_binary(train, "spike_in_15m", **_SMALL))
    return models.normalised_gain(gain).orderBy(F.desc("gain_share"))


@query("t6_occlusion_attribution")
def occlusion_attribution(spark, sf):
    rows = _training(spark, sf)
    train = _part(rows, "train", "spike_in_15m")
    model = models.fit_binary(train, "spike_in_15m", **_SMALL)
    return models.occlusion(model, _part(rows, "val", "spike_in_15m"), train)


def _newest(spark, sf):
    live, limits = _live(spark, sf)
    known = scoring.limits_for(live, limits)
    return scoring.latest(features.build(live, known.drop("threshold_source"), None, labels=False, **_OPTS))


def _attributed(spark, sf):
    train = _part(_training(spark, sf), "train", "severity_in_60m")
    model = models.fit_severity(train, trees=10, depth=5)
    return models.contributions(model, _newest(spark, sf), models.medians_of(train, S.MODEL_FEATURES))


@query("k2_fitted_contributions")
def fitted_contributions(spark, sf):
    """What each feature adds to the class probabilities of every machine's newest row, by the fitted severity model."""
    return _attributed(spark, sf)


@query("k2_fitted_top_features")
def fitted_top_features(spark, sf):
    return models.top_contributions(_attributed(spark, sf), 3)


def _folds(spark, sf, label):
    table = features.train(fx.agg_table(spark, sf), **_OPTS)
    train = splits.labelled(splits.chronological(table).filter("split = 'train'").drop("split"), label)
    return materialise(splits.walk_forward(train), "folds", by=("fold", "role"))


block("cv_rows", """
SELECT f.machine_id, f.bucket, f.severity_in_60m, f.spike_in_15m FROM feat f, bounds WHERE f.bucket <= t1""", "feat", "bounds")


def _plan_sql(label, classes):
    n = lambda role, k: f"count(*) FILTER (WHERE role = '{role}' AND y = {k})"
    counts = ", ".join(f"{n(role, k)} AS {name}_{k}" for role, name in (("train", "train"), ("test", "val")) for k in classes)
    positive = " + ".join(f"train_{k}" for k in classes if k)
    some = " + ".join(f"val_{k}" for k in classes if k)
    missing = ", ".join(f"CASE WHEN train_{k} = 0 THEN '{k}' END" for k in classes)
    return f"""
SELECT fold, CASE WHEN reason IS NULL THEN 'fitted' ELSE 'skipped' END AS status, reason, train_n, val_n,
       {', '.join(f'{name}_{k}' for name in ('train', 'val') for k in classes)},
       CASE WHEN train_n > 0 THEN ({positive}) / train_n END AS train_spike_rate, CASE WHEN val_n > 0 THEN ({some}) / val_n END AS val_spike_rate
FROM (SELECT *, CASE WHEN {positive} = 0 THEN 'no positive training rows'
        WHEN concat_ws(', ', {missing}) <> '' THEN 'no training rows of class ' || concat_ws(', ', {missing})
        WHEN val_n = 0 THEN 'no validation rows' END AS reason FROM (
  SELECT fold, count(*) FILTER (WHERE role = 'train') AS train_n, count(*) FILTER (WHERE role = 'test') AS val_n, {counts} FROM (
    SELECT f AS fold, y, CASE WHEN bucket - lo < n - (n // 6) * (6 - f) - 12 THEN 'train'
      WHEN bucket - lo >= n - (n // 6) * (6 - f) AND bucket - lo < n - (n // 6) * (6 - f) + n // 6 THEN 'test' END AS role
    FROM (SELECT bucket, CAST({label} AS BIGINT) AS y, min(bucket) OVER () AS lo, max(bucket) OVER () - min(bucket) OVER () + 1 AS n
          FROM cv_rows WHERE {label} IS NOT NULL), range(1, 6) r(f)) WHERE role IS NOT NULL GROUP BY 1))"""


def _plan_columns(df, classes):
    return df.select("fold", F.when(F.col("reason").isNull(), "fitted").otherwise("skipped").alias("status"), "reason", "train_n", "val_n",
                     *[f"{name}_{k}" for name in ("train", "val") for k in classes], "train_spike_rate", "val_spike_rate")


@query("t8_fold_plan", sql(_plan_sql("severity_in_60m", (0, 1, 2)), "cv_rows", reals="train_spike_rate val_spike_rate"))
def fold_plan(spark, sf):
    return _plan_columns(models.fold_plan(_folds(spark, sf, "severity_in_60m"), "severity_in_60m", (0, 1, 2)), (0, 1, 2))


@query("t8_walk_forward_fits", sql(_plan_sql("spike_in_15m", (0, 1)), "cv_rows", reals="train_spike_rate val_spike_rate"))
def walk_forward_fits(spark, sf):
    """Folds as fitted or skipped, with the counts they were decided by; the measures are in a24_walk_forward_summary."""
    done = models.cross_validate(_folds(spark, sf, "spike_in_15m"), "spike_in_15m", (0, 1), lambda t: models.fit_binary(t, "spike_in_15m", min_positive=1, **_SMALL))
    return _plan_columns(done, (0, 1))


@query("a24_walk_forward_summary")
def walk_forward_summary(spark, sf):
    folds = _folds(spark, sf, "severity_in_60m")
    done = models.cross_validate(folds, "severity_in_60m", (0, 1, 2), lambda t: models.fit_severity(t, trees=10, depth=5, min_positive=1))
    return metrics.fold_summary(done, models.FOLD_MEASURES)


@query("t7_saved_model")
def saved_model(spark, sf):
    rows = _training(spark, sf)
    path = models.save(models.fit_binary(_part(rows, "train", "spike_in_15m"), "spike_in_15m", **_SMALL),
                       fresh_path(spark, "model"))
    return models.positive_probability(models.load(spark, path), _part(rows, "test", "spike_in_15m"), "score").select(
        "machine_id", "bucket", "score")


def _stored_bundle(spark, sf, without=()):
    """Fitted models, calibrators and fixed alarm levels saved as a version and read back, with the features they were fitted on and the rows these are of."""
    agg = fx.agg_table(spark, sf)
    last = thresholds.split_point(agg, S.TRAIN_RATIO)
    limits = materialise(thresholds.learn(agg, last), "thresholds")
    rows = materialise(splits.chronological(features.build(agg, limits, last, **_OPTS)), "features")
    train, val = _part(rows, "train", "severity_in_60m"), _part(rows, "val", "severity_in_60m")
    binary = lambda name: models.fit_binary(_part(rows, "train", bundle.LABELS[name]), bundle.LABELS[name], **_SMALL)
    wanted = {bundle.SEVERITY: lambda: models.fit_severity(train, trees=10, depth=5),
              bundle.CASCADE: lambda: models.fit_binary(models.cascade_rows(train), "severe", **_SMALL),
              **{name: partial(binary, name) for name in ("15m", "30m", "45m")}}
    fits = models.side_by_side({name: fit for name, fit in wanted.items() if name not in without})
    held = materialise(models.class_probabilities(fits[bundle.SEVERITY], val, bundle.CLASSES).select("severity_in_60m", *bundle.CLASSES), "val")
    made = bundle.Bundle(fits, limits, ALARMS, models.fit_calibrators(held, "severity_in_60m", bundle.CLASSES))
    root = fresh_path(spark, "bundles")
    bundle.save(made, root, "0001")
    return bundle.load(spark, root), rows, agg


def _scored(agg, stored):
    live = fx.live(agg)
    known = scoring.limits_for(live, stored.thresholds)
    newest = scoring.latest(features.build(live, known.drop("threshold_source"), None, labels=False, **_OPTS))
    hist = scoring.history(live)
    warm = newest.join(hist.filter(F.col("status") != "cold_start").select("machine_id"), "machine_id", "left_semi")
    every = hist.join(bundle.probabilities(stored, warm).select("machine_id", *_PROBS), "machine_id", "left").join(
        known.select("machine_id", "threshold_source"), "machine_id", "left")
    return scoring.decide(every, stored.alarms)


_SCORED_COLS = ["severity_class", "is_spike", "is_severe", "recommended_action"]


@query("i3_multi_model_scoring")
def multi_model_scoring(spark, sf):
    """Newest row per machine through every model of a stored bundle, calibrated, then the decision logic."""
    stored, _, agg = _stored_bundle(spark, sf)
    return _scored(agg, stored).select("machine_id", "status", "observations_used", "threshold_source", *_PROBS, *_SCORED_COLS)


@query("i3_scored_machines", sql("""
SELECT machine_id, status, observations_used, CASE WHEN t.machine_id IS NULL THEN 'global_fallback' ELSE 'learned' END AS threshold_source,
       status <> 'cold_start' AS has_classes, false AS has_45m, false AS has_cascade
FROM history_rows LEFT JOIN (SELECT machine_id FROM thr) t USING (machine_id)""", "history_rows", "thr"))
def scored_machines(spark, sf):
    """Which machines a bundle without two of its optional models has probabilities for."""
    stored, _, agg = _stored_bundle(spark, sf, without=("45m", bundle.CASCADE))
    return _scored(agg, stored).select("machine_id", "status", "observations_used", "threshold_source", F.col("p_no").isNotNull().alias("has_classes"),
                                             F.col("p45").isNotNull().alias("has_45m"), F.col("p_ovr").isNotNull().alias("has_cascade"))


@query("t7_bundle_thresholds", sql("SELECT * FROM thr", "thr", reals="threshold_p95 threshold_p99"))
def bundle_thresholds(spark, sf):
    """Machine thresholds as the newest of two versions has them."""
    root = fresh_path(spark, "bundles")
    limits = _live(spark, sf)[1]
    for version, table in (("0001", limits.limit(0)), ("0002", limits)):
        bundle.save(bundle.Bundle({}, table, ALARMS), root, version)
    return bundle.load(spark, root).thresholds.select("machine_id", "threshold_p95", "threshold_p99")


def _calibration(spark, sf):
    rows = _training(spark, sf)
    names = ["p_no", "p_mod", "p_sev"]
    model = models.fit_severity(_part(rows, "train", "severity_in_60m"), trees=10, depth=5)
    val = materialise(models.class_probabilities(model, _part(rows, "val", "severity_in_60m"), names)
                      .select("severity_in_60m", *names), "val")
    test = models.class_probabilities(model, _part(rows, "test", "severity_in_60m"), names)
    return val, test, names


@query("m9_isotonic_calibration")
def isotonic_calibration(spark, sf):
    val, test, names = _calibration(spark, sf)
    fits = models.fit_calibrators(val, "severity_in_60m", names)
    return models.apply_calibrators(fits, test, names).select("machine_id", "bucket", "cal_0", "cal_1", "cal_2")


@query("m13_domain_backtest")
def domain_backtest(spark, sf):
    """Sweep on validation, then ranking quality and alarm rate on test."""
    rows = _training(spark, sf)
    model = models.fit_binary(_part(rows, "train", "spike_in_15m"), "spike_in_15m", **_SMALL)

    def score(part):
        scored = models.positive_probability(model, _part(rows, part, "spike_in_15m"), "score")
        return materialise(scored.select(F.col("spike_in_15m").cast("int").alias("y"), "score"), part)

    val, test = score("val"), score("test")
    chosen = metrics.best_threshold(metrics.sweep(val, []), []).scalar()
    rate = test.agg(F.avg(F.when(F.col("score") >= chosen, 1.0).otherwise(0.0)).alias("r")).scalar()
    return metrics.ranking(test, []).withColumns({"threshold": chosen, "alarm_rate": rate,
                                                  "n_val": val.agg(F.count(F.lit(1)).alias("n")).scalar()})


block("domain_rows", """
SELECT f.severity_in_60m AS "severity", CASE WHEN f.severity_in_60m > 0 THEN CASE WHEN f.severity_in_60m = 2 THEN 1 ELSE 0 END END AS "cascade",
       f.spike_in_15m AS "15m", f.spike_in_30m AS "30m", f.spike_in_45m AS "45m", f.bucket > t2 AS held
FROM feat f, bounds WHERE f.bucket > t1""", "feat", "bounds")
block("domain_counts", """
SELECT model, count(*) FILTER (WHERE NOT held) AS n_val, count(*) FILTER (WHERE held) AS n_test, count(*) FILTER (WHERE held AND y > 0) AS n_pos
FROM (UNPIVOT (SELECT held, CAST(COLUMNS(* EXCLUDE held) AS DOUBLE) FROM domain_rows) ON "15m", "30m", "45m", "severity", "cascade" INTO NAME model VALUE y)
GROUP BY 1""", "domain_rows")


@query("m13_domain_backtest_rows", sql("""
SELECT model, n_val, n_test, n_pos, n_pos / n_test AS pos_rate, CASE WHEN reason IS NULL THEN 'evaluated' ELSE 'skipped' END AS status, reason
FROM (SELECT *, CASE WHEN model <> 'severity' AND n_val < 100 THEN 'fewer than 100 rows to sweep' WHEN n_test = 0 THEN 'no test rows'
        WHEN model <> 'severity' AND n_pos IN (0, n_test) THEN 'test labels of one class' END AS reason FROM domain_counts)""", "domain_counts", reals="pos_rate"))
def domain_backtest_rows(spark, sf):
    """What each model of the bundle is judged on, and whether it can be; its measures are in m13_domain_backtest_report."""
    return _backtest(spark, sf).select("model", "n_val", "n_test", "n_pos", "pos_rate", "status", "reason")


@query("m13_domain_backtest_report")
def domain_backtest_report(spark, sf):
    return _backtest(spark, sf)


def _backtest(spark, sf):
    stored, rows, _ = _stored_bundle(spark, sf)
    return bundle.backtest(stored, rows.filter("split = 'val'"), rows.filter("split = 'test'"))


@query("m14_domain_recalibration")
def domain_recalibration(spark, sf):
    """Per class: ranking quality with the model's own and with re-fitted calibration."""
    val, test, names = _calibration(spark, sf)
    calibrated = models.apply_calibrators(models.fit_calibrators(val, "severity_in_60m", names), test, names)
    both = materialise(calibrated.select("severity_in_60m", *names, "cal_0", "cal_1", "cal_2"), "calibrated")
    before = metrics.one_vs_rest(both, [], "severity_in_60m", names).withColumn("kind", F.lit("raw"))
    after = metrics.one_vs_rest(both, [], "severity_in_60m", ["cal_0", "cal_1", "cal_2"]).withColumn("kind", F.lit("recalibrated"))
    return before.unionByName(after)


@query("m14_recalibrated_rows", sql("""
SELECT model, n_val, n_test, n_pos, CASE WHEN reason IS NULL THEN 'recalibrated' ELSE 'skipped' END AS status, reason
FROM (SELECT *, CASE WHEN model = 'severity' AND n_val < 1000 THEN 'fewer than 1000 rows to calibrate' WHEN model <> 'severity' AND n_val < 100 THEN 'fewer than 100 rows to sweep'
        WHEN n_test = 0 THEN 'no test rows' WHEN model <> 'severity' AND n_pos IN (0, n_test) THEN 'test labels of one class' END AS reason FROM domain_counts)""", "domain_counts"))
def recalibrated_rows(spark, sf):
    """What each model of the bundle is fitted to another fleet on, and whether it can be."""
    return _recalibrated(spark, sf)[0].filter(F.col("class").isNull() & (F.col("model") != bundle.ANY)).select("model", "n_val", "n_test", "n_pos", "status", "reason")


@query("m14_recalibration_report")
def recalibration_report(spark, sf):
    return _recalibrated(spark, sf)[0]


@query("m14_recalibrated_scoring")
def recalibrated_scoring(spark, sf):
    """Newest rows scored by the recalibrated bundle, saved as a version and read back."""
    root = fresh_path(spark, "bundles")
    _, fitted, agg = _recalibrated(spark, sf)
    bundle.save(fitted, root, "0001")
    return _scored(agg, bundle.load(spark, root)).select("machine_id", "status", *_PROBS, *_SCORED_COLS)


def _recalibrated(spark, sf):
    stored, rows, agg = _stored_bundle(spark, sf)
    return *bundle.recalibrate(stored, rows.filter("split = 'val'"), rows.filter("split = 'test'")), agg
