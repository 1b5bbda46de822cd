"""Per-machine series features and look-ahead labels of a series whose missing buckets are zero.

``dense_series`` does the only shuffle; everything after it runs on the same
(machine, chunk) partitions.  Exceedance counts are kept as running counts, so
every "how many of the last/next k" question is a difference of two offsets.
``measured_series`` and ``measured_features`` give the same for the measured rows
without filling gaps: windows are ranges of buckets, and what a gap adds to them
is calculated.  Unused columns are pruned together with their window functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import clamp, day_angle, flag, ratio_or_zero
from tidewatch.operators import chunks

BACK = max(chunks.decay_reach(2.0 ** (-1.0 / h)) for h in S.HALF_LIVES)


def dense_series(agg: DataFrame, thresholds: DataFrame | None = None, *, extra: tuple[str, ...] = (),
                 value: str = "total_cpu", horizon: int = S.HORIZON, back: int = BACK,
                 size: int = chunks.CHUNK_BUCKETS) -> DataFrame:
    """Gap-filled series; thresholds ride along on the per-machine markers."""
    return _chunked(chunks.gap_fill, agg, thresholds, extra, value, horizon, back, size)


def measured_series(agg: DataFrame, thresholds: DataFrame | None = None, *, extra: tuple[str, ...] = (),
                    value: str = "total_cpu", horizon: int = S.HORIZON, back: int = BACK,
                    size: int = chunks.CHUNK_BUCKETS) -> DataFrame:
    """Measured rows of ``dense_series`` and a marker row per (machine, chunk)."""
    return _chunked(chunks.measured, agg, thresholds, extra, value, horizon, back, size)


def _chunked(how, agg: DataFrame, thresholds: DataFrame | None, extra: tuple[str, ...], value: str, horizon: int,
             back: int, size: int) -> DataFrame:
    rows = agg if value == "total_cpu" else agg.drop("total_cpu").withColumnRenamed(value, "total_cpu")
    spans = chunks.span_per_key(rows)
    carried: tuple[str, ...] = ()
    if thresholds is not None:
        spans = spans.join(thresholds, "machine_id", "left")
        carried = tuple(c for c in thresholds.columns if c != "machine_id")
    signals = [c for c in (*S.SIGNALS, "n_tasks", *extra) if c in rows.columns]
    ahead = max(horizon, *S.SHORT_HORIZONS.values())
    return how(rows, spans, signals=signals, carried=carried, back=back, ahead=ahead, size=size)


def _offsets(w, cpu: Column) -> dict[str, Column]:
    zero = lambda k: F.coalesce(F.lag(cpu, k).over(w), F.lit(0.0))
    return {f"_ago_{k}": zero(k) for k in (1, 2, 3, 6, 12, 24)}


def ewma_columns(w, cpu: Column, half_lives=S.HALF_LIVES, size: int = chunks.CHUNK_BUCKETS) -> dict[str, Column]:
    """Exponential means by half-life (see ``chunks.decayed_mean`` for the method)."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for h in half_lives:
        keep = F.lit(2.0 ** (-1.0 / h))
        place = F.col("_step") - F.lit((size - BACK) // 2)
        weight = F.when(F.col("_first"), F.lit(1.0)).otherwise(1.0 - keep)
        out[f"cpu_ewma_{h}"] = F.sum(cpu * weight * F.pow(keep, -place)).over(run) * F.pow(keep, place)
    return out


def with_features(dense: DataFrame, slots: int = S.SLOTS_PER_DAY,
                  size: int = chunks.CHUNK_BUCKETS) -> DataFrame:
    """All per-machine feature columns of ``dense_series``; needs threshold_p95 and threshold_p99."""
    w = chunks.series_window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cpu, p95, p99 = F.col("total_cpu"), F.col("threshold_p95"), F.col("threshold_p99")
    over95, over99 = flag(cpu > p95), flag(cpu > p99)

    base = dense.withColumns({"spike_now": over95, "spike_severe_now": over99})
    first = base.withColumns({
        **_offsets(w, cpu), **ewma_columns(w, cpu, size=size),
        "cpu_rolling_std_6": F.coalesce(F.stddev_samp(cpu).over(w.rowsBetween(-5, 0)), F.lit(0.0)),
        "_count95": F.sum("spike_now").over(run),
        "_count99": F.sum("spike_severe_now").over(run),
        "_seen": F.row_number().over(w),
        "_last_spike": F.last(F.when(F.col("spike_now") == 1.0, F.col("bucket")), ignorenulls=True)
                        .over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })

    def recent(count: str, k: int) -> Column:
        before = lambda n: F.coalesce(F.lag(count, n).over(w), F.lit(0.0))
        return before(1) - before(k + 1)

    second = first.withColumns({
        **{f"spike_in_last_{k}": F.least(recent("_count95", k), F.lit(1.0)) for k in S.HISTORY_WINDOWS},
        **{f"spike_severe_in_last_{k}": F.least(recent("_count99", k), F.lit(1.0))
           for k in S.HISTORY_WINDOWS},
        "cpu_spike_rate_24": recent("_count95", S.HISTORY_CAP) / F.least(F.lit(S.HISTORY_CAP), F.col("_seen")),
        "time_since_last_spike": F.least(
            F.coalesce(F.col("bucket") - F.col("_last_spike"), F.lit(S.HISTORY_CAP)),
            F.lit(S.HISTORY_CAP)).cast("double"),
    })
    return _derived(second, slots)


def measured_features(rows: DataFrame, slots: int = S.SLOTS_PER_DAY, size: int = chunks.CHUNK_BUCKETS, *,
                      labels: bool = False, horizon: int = S.HORIZON, at_least: int = 1) -> DataFrame:
    """Columns of ``with_features`` (and ``with_labels``) for the owned rows of ``measured_series``."""
    w = chunks.series_window()
    run, bucket = w.rowsBetween(Window.unboundedPreceding, 0), F.col("bucket")
    cpu, p95, p99 = F.col("total_cpu"), F.col("threshold_p95"), F.col("threshold_p99")
    held = F.struct(cpu.alias("v"))
    at = lambda k: F.coalesce(F.first(held).over(w.rangeBetween(-k, -k))["v"], F.lit(0.0))
    base = rows.withColumns({
        "spike_now": flag(F.col("observed") & (cpu > p95)), "spike_severe_now": flag(F.col("observed") & (cpu > p99)),
        # whether a bucket without a row exceeds
        "_gap95": flag(p95 < 0), "_gap99": flag(p99 < 0), "_seen": bucket - F.col("_start") + 1})

    def exceeding(low: int, high: int, which: str) -> Column:
        """How many of the series' buckets from ``low`` to ``high`` away exceed."""
        frame = w.rangeBetween(low, high)
        buckets = F.lit(high - low + 1) if low > 0 else F.least(F.lit(high - low + 1), F.col("_seen") + high)
        return (F.coalesce(F.sum("spike_now" if which == "95" else "spike_severe_now").over(frame), F.lit(0.0))
                + F.col(f"_gap{which}") * (buckets - F.count(F.lit(1)).over(frame)))

    last6 = w.rangeBetween(-5, 0)
    n, mean = F.col("_n6"), F.col("_mean6")
    gaps = F.least(F.lit(6), F.col("_seen")) - F.col("_rows6")
    size_ = n + gaps
    first = base.withColumns({
        **{f"_ago_{k}": at(k) for k in (1, 2, 3, 6, 12, 24)},
        **{name: F.coalesce(c, F.when(F.col("_seen") > F.row_number().over(w) - 1, F.lit(0.0)))
           for name, c in ewma_columns(w, cpu, size=size).items()},
        "_rows6": F.count(F.lit(1)).over(last6), "_n6": F.count(cpu).over(last6),
        "_mean6": F.avg(cpu).over(last6), "_var6": F.var_pop(cpu).over(last6),
        **{f"spike_in_last_{k}": F.least(exceeding(-k, -1, "95"), F.lit(1.0)) for k in S.HISTORY_WINDOWS},
        **{f"spike_severe_in_last_{k}": F.least(exceeding(-k, -1, "99"), F.lit(1.0)) for k in S.HISTORY_WINDOWS},
        "cpu_spike_rate_24": exceeding(-S.HISTORY_CAP, -1, "95") / F.least(F.lit(S.HISTORY_CAP), F.col("_seen")),
        "_before": F.max("bucket").over(w.rangeBetween(Window.unboundedPreceding, -1)),
        "_last_spike": F.last(F.when(F.col("spike_now") == 1.0, bucket), ignorenulls=True)
                        .over(w.rowsBetween(Window.unboundedPreceding, -1)),
        **(_measured_labels(exceeding, horizon, at_least) if labels else {}),
    })
    after_gap = F.when((F.col("_gap95") == 1.0) & (bucket - F.greatest("_before", F.col("_start") - 1) > 1), bucket - 1)
    last_spike = F.greatest("_last_spike", F.last(after_gap, ignorenulls=True).over(run))
    second = first.withColumns({
        # zeros of gaps added to the variance of the measured values
        "cpu_rolling_std_6": F.coalesce(F.when(size_ > 1, F.sqrt((F.col("_var6") * n + mean * mean * n * gaps / size_) / (size_ - 1))), F.lit(0.0)),
        "time_since_last_spike": F.least(F.coalesce(bucket - last_spike, F.lit(S.HISTORY_CAP)), F.lit(S.HISTORY_CAP)).cast("double"),
    })
    return _derived(second, slots)


def _measured_labels(exceeding, horizon: int, at_least: int) -> dict[str, Column]:
    whole = lambda n: F.col("bucket") + n <= F.col("_last")
    return {
        **{name: F.when(whole(n), flag(exceeding(1, n, "95") >= 1)) for name, n in S.SHORT_HORIZONS.items()},
        "severity_in_60m": F.when(~whole(horizon), F.lit(None)).when(exceeding(1, horizon, "99") >= at_least, 2)
                            .when(exceeding(1, horizon, "95") >= at_least, 1).otherwise(0).cast("double")}


def _derived(second: DataFrame, slots: int) -> DataFrame:
    cpu, p95, p99 = F.col("total_cpu"), F.col("threshold_p95"), F.col("threshold_p99")
    norm = cpu / p95
    slope = lambda k: F.when(p95 > 0, (norm - F.col(f"_ago_{k}") / p95) / k).otherwise(0.0)
    room = 1.0 - norm
    eta = F.when(slope(3) > 0.01, room / slope(3)).otherwise(F.when(room < 0, -24.0).otherwise(24.0))
    width = F.greatest(p99 - p95, F.lit(1e-6))
    delta1 = cpu - F.col("_ago_1")
    angle = day_angle("bucket", slots)
    return second.withColumns({
        "cpu_per_task": cpu / F.greatest(F.col("n_tasks"), F.lit(1)),
        **{f"cpu_lag_{k}": F.col(f"_ago_{k}") for k in S.LAGS},
        "cpu_delta_1": delta1,
        "cpu_delta_2": delta1 - (F.col("_ago_1") - F.col("_ago_2")),
        "task_dominance": F.when(cpu > 0, F.col("peak_cpu") / cpu).otherwise(0.0),
        "cpu_vs_p95": ratio_or_zero(cpu, p95),
        "peak_cpu_vs_p95": ratio_or_zero("peak_cpu", p95),
        "cpu_vs_p99": ratio_or_zero(cpu, p99),
        "peak_cpu_vs_p99": ratio_or_zero("peak_cpu", p99),
        "cpu_vs_p95_delta": F.when(p95 > 0, delta1 / p95).otherwise(0.0),
        "cpu_vs_p95_slope_3": slope(3),
        "cpu_vs_p95_slope_6": slope(6),
        "time_to_p95_3": F.when(p95 > 0, clamp(eta, -24.0, 24.0)).otherwise(0.0),
        "band_width": width,
        "band_position": F.greatest((cpu - p95) / width, F.lit(0.0)),
        "hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
    })


def severity_label(horizon: int = S.HORIZON, at_least: int = 1) -> Column:
    """2, 1 or 0 by how many of the next ``horizon`` buckets exceed; null near the end."""
    w = chunks.series_window()
    ahead = lambda c: F.lead(c, horizon).over(w) - F.col(c)
    return (F.when(F.lead("_seen", horizon).over(w).isNull(), F.lit(None))
            .when(ahead("_count99") >= at_least, 2)
            .when(ahead("_count95") >= at_least, 1).otherwise(0)).cast("double")


def binary_label(horizon: int, at_least: int = 1) -> Column:
    w = chunks.series_window()
    ahead = F.lead("_count95", horizon).over(w) - F.col("_count95")
    return F.when(F.lead("_seen", horizon).over(w).isNotNull(), flag(ahead >= at_least))


def with_labels(featured: DataFrame, horizon: int = S.HORIZON, at_least: int = 1) -> DataFrame:
    """Look-ahead labels; the short horizons always ask for a single exceedance."""
    return featured.withColumns({
        **{name: binary_label(n) for name, n in S.SHORT_HORIZONS.items()},
        "severity_in_60m": severity_label(horizon, at_least)})


def observed_rows(df: DataFrame) -> DataFrame:
    """Only buckets that were really measured, and only by the chunk that owns them."""
    return chunks.owned(df.filter("observed")).drop("observed")
