"""From probabilities to recommendations, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scalar as X
from tidewatch.operators import chunks
from tidewatch.operators.profile import run_lengths
from tidewatch.operators.thresholds import fallback_medians

HORIZONS = ["15m", "30m", "45m", "60m"]
SMOOTH_ROWS = 1024


def history(agg: DataFrame, key: str = "machine_id") -> DataFrame:
    """Rows of history, status and data quality of every machine."""
    rows = agg.groupBy(key).agg(F.count(F.lit(1)).alias("observations_used"))
    return rows.withColumn("status", X.history_status("observations_used")).withColumn(
        "data_quality", F.when(F.col("status") != "cold_start", X.data_quality("observations_used")))


def limits_for(agg: DataFrame, thresholds: DataFrame, key: str = "machine_id") -> DataFrame:
    """Thresholds for the machines at hand, with the fleet medians for new ones."""
    pair = fallback_medians(thresholds).select(F.struct("median_p95", "median_p99").alias("f")).scalar()
    return (agg.select(key).distinct().join(thresholds, key, "left").withColumn("_f", pair)
            .withColumn("threshold_source", F.when(F.col("threshold_p95").isNull(), "global_fallback").otherwise("learned"))
            .withColumn("threshold_p95", F.coalesce("threshold_p95", F.col("_f.median_p95")))
            .withColumn("threshold_p99", F.coalesce("threshold_p99", F.col("_f.median_p99"))).drop("_f"))


def latest(df: DataFrame, key: str = "machine_id", order: str = "bucket") -> DataFrame:
    """Newest row per machine; partial aggregation keeps one row per machine and task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")) \
        .select(key, "_r.*")


def decide(df: DataFrame, alarms: dict[str, float] | None = None, override: float | None = None) -> DataFrame:
    """Flags, severity and action from p15, p30, p45, p_no, p_mod, p_sev and p_ovr (any may be null).

    The stage-one gate sees the raw spike probability; the horizons are made
    monotone afterwards.  ``override`` replaces every alarm threshold.
    """
    level = {h: (override if override is not None else (alarms or {}).get(h, 0.5)) for h in [*HORIZONS, "severe"]}
    any60 = F.col("p_mod") + F.col("p_sev")
    e15, e30, e45, e60 = X.horizon_scan("p15", "p30", "p45", any60)
    known = F.col("p_mod").isNotNull()
    severity = F.when(known, X.largest_class("p_no", "p_mod", "p_sev"))
    severe = F.when(known | F.col("p_ovr").isNotNull(),
                    X.severe_verdict("p_sev", "p_ovr", F.coalesce(any60, F.lit(0.0)), F.lit(level["60m"]), F.lit(level["severe"])))
    out = df.withColumns({"p_spike_15m": e15, "p_spike_30m": e30, "p_spike_45m": e45, "p_spike_60m": e60,
                          "severity_class": severity, "is_severe": severe})
    out = out.withColumns({f"alarm_{h}": F.col(f"p_spike_{h}") >= F.lit(level[h]) for h in ("15m", "30m", "45m")})
    action = X.recommended_action("alarm_15m", "alarm_30m", "alarm_45m", "severity_class", "is_severe")
    unknown = F.coalesce("p15", "p30", "p45", "p_mod").isNull()
    return out.withColumns({"is_spike": F.col("severity_class") >= 1,
                            "recommended_action": F.when(~unknown, action)})


def envelope(decided: DataFrame, alarms: dict[str, float], trained_at: str | None = None, predicted_at: str | None = None,
             model_version: str | None = None) -> DataFrame:
    """One nested row per machine (and cycle, if there is one), as the prediction table stores it and ``smooth`` reads it.

    Horizons without a probability are left out of ``imminence``; the one of
    60 minutes also holds the classes.  Cold machines have nulls.  The machine's
    own threshold is taken from ``threshold_p95`` and ``threshold_source``, and
    the features that speak for an alarm from ``top_features``, if present.
    """
    cold = F.col("status") == "cold_start"
    warm = lambda c: F.when(~cold, c)
    level = {h: F.lit(round(alarms.get(h, 0.5), 4)) for h in [*HORIZONS, "severe"]}
    classes = {n: F.round(p, 6) for p, n in (("p_no", "p_no_spike"), ("p_mod", "p_moderate"), ("p_sev", "p_severe"), ("p_ovr", "p_severe_ovr"))}
    last = {"severity_class": F.col("severity_class"), **classes, "is_severe": F.col("is_severe"),
            "alarm_threshold_ovr": F.when(F.col("p_ovr").isNotNull(), level["severe"])}
    kinds = {"severity_class": dict(decided.dtypes)["severity_class"], "is_severe": "boolean"}

    def entry(h: str) -> Column:
        own = {n: c if h == "60m" else F.lit(None).cast(kinds.get(n, "double")) for n, c in last.items()}
        return F.when(F.col(f"p_spike_{h}").isNotNull(), F.struct(
            F.round(f"p_spike_{h}", 6).alias("p_spike"),
            (F.col("is_spike") if h == "60m" else F.col(f"alarm_{h}")).alias("is_spike"),
            level[h].alias("alarm_threshold"), *[c.alias(n) for n, c in own.items()]))

    every = F.map_from_arrays(F.array(*[F.lit(h) for h in HORIZONS]), F.array(*[entry(h) for h in HORIZONS]))
    imminence = F.map_filter(every, lambda _, e: e.isNotNull())
    known = {c: F.col(c) for c in ("threshold_source", "top_features") if c in decided.columns}
    if "threshold_p95" in decided.columns:
        known["threshold_used"] = F.round("threshold_p95", 6)
    return decided.select(
        "machine_id", *[c for c in ("cycle",) if c in decided.columns], "status", "observations_used",
        F.lit(trained_at).cast("string").alias("trained_at"), F.lit(predicted_at).cast("string").alias("predicted_at"),
        F.lit(model_version).cast("string").alias("model_version"), warm(imminence).alias("imminence"),
        "severity_class", *[c.alias(n) for n, c in classes.items()], "is_spike", "is_severe", "recommended_action",
        warm(level["60m"]).alias("alarm_threshold"), *[warm(c).alias(n) for n, c in known.items()],
        warm(F.struct(F.col("data_quality").alias("score"), F.col("status").alias("status"))).alias("data_quality"))


def batch_counters(predictions: DataFrame) -> DataFrame:
    cold = F.col("status") == "cold_start"
    return predictions.agg(F.count(F.lit(1)).alias("machines_total"), F.count_if(~cold).alias("machines_predicted"),
                           F.count_if(cold).alias("machines_cold_start"))


# --- smoothing and debounce over cycles -------------------------------------------------------

def _suppress(df: DataFrame, when: Column) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({"is_spike": F.when(hit, False).otherwise(F.col("is_spike")),
                           "is_severe": F.when(hit, False).otherwise(F.col("is_severe")),
                           "recommended_action": F.when(hit, "normal").otherwise(F.col("recommended_action"))})


def smooth(predictions: DataFrame, alpha: float = S.SMOOTHING_ALPHA) -> DataFrame:
    """Exponential mean of the spike probability over cycles; weak ones lose their alarm.

    Cold-start rows carry no probability, keep no state and stay as they are.
    """
    cold = (F.col("status") == "cold_start") | F.col("p_moderate").isNull()
    warm = predictions.filter(~cold).withColumn("_p", F.col("p_moderate") + F.col("p_severe"))
    if alpha >= 1.0:
        smoothed = warm.withColumn("p_spike_smoothed", F.col("_p"))
    else:
        size, back = chunks.decay_chunks(1.0 - alpha, SMOOTH_ROWS)
        rows = chunks.row_chunks(warm, order="cycle", back=back, size=size)
        smoothed = chunks.owned(chunks.decayed_mean(rows, "_p", 1.0 - alpha, "p_spike_smoothed", order="pos",
                                                    size=size, back=back)).drop("pos", "series_rows")
    kept = _suppress(smoothed.drop("_p"), F.col("p_spike_smoothed") < F.col("alarm_threshold"))
    return kept.unionByName(predictions.filter(cold).withColumn("p_spike_smoothed", F.lit(None).cast("double")))


def debounce(smoothed: DataFrame, at_least: int = S.MIN_CONSECUTIVE) -> DataFrame:
    """Alarms count only from the ``at_least``-th spiking cycle in a row."""
    cold = F.col("status") == "cold_start"
    warm = run_lengths(smoothed.filter(~cold), F.col("is_spike"), "consecutive_alarms", order="cycle")
    early = (F.col("consecutive_alarms") > 0) & (F.col("consecutive_alarms") < at_least)
    return _suppress(warm, early).unionByName(smoothed.filter(cold).withColumn("consecutive_alarms", F.lit(0).cast("long")))


# --- fleet summary and service levels -----------------------------------------------------------

def node_summary(df: DataFrame) -> DataFrame:
    """Scheduler view of each machine: earliest horizon, alarm source, score."""
    cold = F.col("status") == "cold_start"
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    horizon = (F.when(cold, F.lit(None)).when(yes("alarm_15m"), "15m").when(yes("alarm_30m"), "30m")
               .when(yes("alarm_45m"), "45m").when(yes("is_spike"), "60m"))
    short = yes("alarm_15m") | yes("alarm_30m") | yes("alarm_45m")
    return df.withColumns({
        "horizon": horizon,
        "spike_imminent": F.when(~cold, short),
        "alarm_source": F.when(cold, F.lit(None)).when(short, F.concat(F.lit("binary_"), horizon))
                         .when(yes("is_spike"), "60m_severity").otherwise("none"),
        "scheduler_score": X.whole_half_even(100 * (1 - F.col("p_spike_smoothed")))})


def fleet_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    warm = F.col("status") != "cold_start"
    return df.groupBy(*keys).agg(
        *[F.count_if(warm & F.col(f"alarm_{h}")).alias(f"spikes_in_{h}") for h in ("15m", "30m", "45m")],
        F.count_if(warm & F.col("is_spike")).alias("spikes_in_60m"),
        F.count_if(F.col("recommended_action").isin(*S.URGENT_ACTIONS)).alias("nodes_requiring_action"))


def alarming(df: DataFrame) -> DataFrame:
    """Rows whose action is more than passive - the alarm list, kept as rows."""
    return df.filter(F.col("recommended_action").isNotNull() & ~F.col("recommended_action").isin(*S.PASSIVE_ACTIONS))


def cycle_stats(df: DataFrame, cycle: str = "cycle") -> DataFrame:
    cold = F.col("status") == "cold_start"
    active = F.col("recommended_action").isNotNull() & ~F.col("recommended_action").isin(*S.PASSIVE_ACTIONS)
    sums = df.groupBy(cycle).agg(F.count(F.lit(1)).alias("machines_total"), F.count_if(~cold).alias("machines_predicted"),
                                 F.count_if(cold).alias("machines_cold_start"), F.count_if(active).alias("alarm_count"))
    return sums.withColumns({"alarm_rate": F.try_divide("alarm_count", "machines_predicted"),
                             "cold_start_rate": F.try_divide("machines_cold_start", "machines_total")})


def first_alarms(df: DataFrame, k: int = 5, cycle: str = "cycle") -> DataFrame:
    """The first ``k`` alarming machines of each cycle as text; a top-k, so nothing longer is gathered."""
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy(cycle).orderBy("machine_id"))
    top = alarming(df).select(cycle, "machine_id").withColumn("_r", place).filter(F.col("_r") <= k)
    return top.groupBy(cycle).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("machine_id")), lambda m: m.cast("string")), ", ").alias("first_alarms"))


def slo_records(stats: DataFrame, latency: Column, success: Column, cycle: str = "cycle") -> DataFrame:
    """One service-level row per cycle; a failed cycle keeps its latency only."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    rows = stats.withColumns({"latency_s": F.bround(latency, 3), "success": success})
    return rows.select(
        F.col(cycle).alias("cycle_index"), "latency_s", "success",
        *[ok(c).alias(c) for c in ("machines_total", "machines_predicted", "machines_cold_start", "alarm_count")],
        F.bround(ok("alarm_rate"), 4).alias("alarm_rate"), F.bround(ok("cold_start_rate"), 4).alias("cold_start_rate"))


def last_cycles(records: DataFrame, n: int = S.SLO_WINDOW) -> DataFrame:
    """The rolling window of the newest cycles (a top-k)."""
    return records.orderBy(F.desc("cycle_index")).limit(n)


def slo_summary(records: DataFrame) -> DataFrame:
    """Success rate, latency percentiles over all cycles, alarm figures over successful ones.

    ``records`` is a rolling window, so its size is bounded by construction.
    """
    ok_rate = F.when(F.col("success"), F.col("alarm_rate"))
    ok_cold = F.when(F.col("success"), F.col("cold_start_rate"))
    return records.agg(
        F.count(F.lit(1)).alias("window_cycles"), F.min("cycle_index").alias("window_start"),
        F.max("cycle_index").alias("window_end"),
        F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"),
        F.percentile("latency_s", 0.5).alias("latency_p50_s"), F.percentile("latency_s", 0.95).alias("latency_p95_s"),
        F.avg(ok_rate).alias("alarm_rate_mean"),
        F.when(F.count(ok_rate) >= 2, F.stddev_pop(ok_rate)).alias("alarm_rate_std"),
        F.avg(ok_cold).alias("cold_start_rate_mean"))
