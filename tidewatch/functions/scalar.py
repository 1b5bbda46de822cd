"""Column expressions; every one stays inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_of(micros, bucket_seconds: int = S.BUCKET_SECONDS) -> Column:
    """Index of the fixed-width bucket that holds a microsecond instant."""
    return F.floor(col(micros) / F.lit(bucket_seconds * 1_000_000)).cast("long")


def bucket_start(bucket, bucket_seconds: int = S.BUCKET_SECONDS) -> Column:
    return col(bucket) * F.lit(bucket_seconds * 1_000_000)


def half_even(value, digits: int = 0) -> Column:
    return F.bround(col(value), digits)


def whole_half_even(value) -> Column:
    """Nearest integer with ties to even, done in plain double arithmetic."""
    v = col(value)
    low = F.floor(v).cast("double")
    rest = v - low
    even = (low % 2) == 0
    return (F.when(rest < 0.5, low).when(rest > 0.5, low + 1)
            .when(even, low).otherwise(low + 1)).cast("long")


def finite_or_null(value, digits: int | None = None) -> Column:
    v = col(value).cast("double")
    clean = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
    return clean if digits is None else F.bround(clean, digits)


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def ratio_or_zero(top, bottom) -> Column:
    b = col(bottom)
    return F.when(b > 0, col(top) / b).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def day_angle(bucket, slots: int = S.SLOTS_PER_DAY) -> Column:
    return F.lit(2.0 * math.pi) * F.pmod(col(bucket), F.lit(slots)) / F.lit(slots)


def horizon_scan(p15, p30, p45, p60) -> tuple[Column, Column, Column, Column]:
    """Make four horizon probabilities non-decreasing if all four are known."""
    seq = [col(p) for p in (p15, p30, p45, p60)]
    known = seq[0].isNotNull() & seq[1].isNotNull() & seq[2].isNotNull() & seq[3].isNotNull()
    out = [seq[0]]
    for i in range(1, 4):
        out.append(F.when(known, F.greatest(*seq[: i + 1])).otherwise(seq[i]))
    return tuple(out)


def severe_verdict(p_severe, p_cascade, p_any, alarm_60m, alarm_cascade,
                   gate: float = S.STAGE_ONE_GATE) -> Column:
    """Severe flag; the cascade output counts only where stage one fires."""
    cascade = F.when(col(p_any) >= F.lit(gate), col(p_cascade) >= col(alarm_cascade)) \
               .otherwise(F.lit(False))
    return F.when(col(p_cascade).isNotNull(), cascade).otherwise(col(p_severe) >= col(alarm_60m))


def largest_class(*probs) -> Column:
    """Zero-based position of the first maximum."""
    arr = F.array(*[col(p) for p in probs])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("long")


def recommended_action(alarm15, alarm30, alarm45, severity, severe) -> Column:
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    any60 = F.coalesce(col(severity) >= 1, F.lit(False))
    return (F.when(yes(alarm15), "preempt_now")
            .when(yes(alarm30), "migrate_jobs")
            .when(yes(alarm45), "defer_new_jobs")
            .when(any60 & yes(severe), "defer_batch")
            .when(any60, "monitor")
            .otherwise("normal"))


def history_status(rows) -> Column:
    r = col(rows)
    return (F.when(r < S.COLD_START_ROWS, "cold_start")
            .when(r < S.FULL_HISTORY_ROWS, "degraded").otherwise("success"))


def data_quality(rows) -> Column:
    return F.bround(F.least(col(rows), F.lit(S.FULL_HISTORY_ROWS)) / F.lit(24.0), 4)


def psi_status(psi) -> Column:
    p = col(psi)
    return (F.when(p.isNull(), "stable")
            .when(p >= S.PSI_EMERGENCY, "emergency")
            .when(p >= S.PSI_WARNING, "retrain")
            .when(p >= S.PSI_STABLE, "warning")
            .otherwise("stable"))


def psi_label(psi, present=None) -> Column:
    p = col(psi)
    label = (F.when(p.isNull(), "no variance")
             .when(p < S.PSI_STABLE, "minor")
             .when(p < S.PSI_WARNING, "moderate").otherwise("MAJOR"))
    return label if present is None else F.when(col(present), label).otherwise("missing")


def feature_hash(columns) -> Column:
    """Six hex digits that identify a set of column names, order ignored."""
    names = col(columns)
    digest = F.sha2(F.array_join(F.array_sort(names), "|"), 256)
    return F.when(names.isNull() | (F.size(names) == 0), "000000") \
            .otherwise(F.substring(digest, 1, 6))


def model_version(trained_at, columns) -> Column:
    """Compact UTC instant, underscore, feature hash."""
    raw = col(trained_at)
    parsed = F.try_to_timestamp(raw)
    stamp = F.date_format(parsed, "yyyyMMdd'T'HHmmss'Z'")
    stripped = F.regexp_replace(F.substring(raw, 1, 20), "[: -]", "")
    safe = F.when(stripped == "", "unknown").otherwise(stripped)
    part = F.when(raw.isNull() | (raw == ""), "unknown").otherwise(F.coalesce(stamp, safe))
    return F.concat_ws("_", part, feature_hash(columns))


def transfer_decision(metric, source) -> Column:
    kept = col(metric) / col(source)
    return (F.when(kept.isNull() | (col(source) <= 0), "undetermined")
            .when(kept >= 0.70, "deploy").when(kept >= 0.40, "adapt").otherwise("retrain"))
