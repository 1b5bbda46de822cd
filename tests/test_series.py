"""Worked cases for gap filling, windows and labels."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import chunks, cross, series, thresholds
from tidewatch.operators.ordered import average_rank, quantiles, running_totals
from tidewatch.plans import features


def agg_rows(spark, cells, tasks=5):
    rows = [(m, b, b * 300_000_000, float(c), float(c) * 1.2, 0.10, 0.20, 0.01, tasks) for m, b, c in cells]
    return spark.createDataFrame(rows, S.CLUSTER_AGG)


def limits(spark, table):
    return spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in table.items()],
                                 "machine_id long, threshold_p95 double, threshold_p99 double")


def full(spark, cells, table, size=chunks.CHUNK_BUCKETS, horizon=12, at_least=1):
    dense = series.dense_series(agg_rows(spark, cells), limits(spark, table), horizon=horizon, size=size)
    return series.with_labels(series.with_features(dense, size=size), horizon, at_least)


def collected(df, *cols):
    return {(r.machine_id, r.bucket): tuple(r[c] for c in cols) for r in chunks.owned(df).collect()}


GAP = [(7, 1, .3), (7, 2, .4), (7, 5, .5), (7, 6, .6), (7, 7, .7)]


def test_gap_rows_are_idle_and_leave_the_output(spark):
    out = full(spark, GAP, {7: (.45, .65)})
    cells = collected(out, "observed", "total_cpu")
    assert sorted(b for _, b in cells) == [1, 2, 3, 4, 5, 6, 7]
    assert cells[7, 3] == (False, 0.0) and cells[7, 5] == (True, .5)
    assert sorted(r.bucket for r in series.observed_rows(out).collect()) == [1, 2, 5, 6, 7]


def test_first_row_lags_are_zero_and_gap_counts_as_history(spark):
    got = collected(full(spark, GAP, {7: (.45, .65)}), "cpu_lag_1", "cpu_delta_1", "cpu_delta_2", "cpu_rolling_std_6",
                    "spike_in_last_1", "time_since_last_spike", "cpu_spike_rate_24")
    assert got[7, 1][:4] == (0.0, .3, .3, 0.0)
    assert got[7, 5][0] == 0.0 and got[7, 5][1] == .5
    assert got[7, 6][4:] == (1.0, 1.0, pytest.approx(1 / 6))
    assert got[7, 7][4:] == (1.0, 1.0, pytest.approx(2 / 7))
    assert got[7, 5][5] == 24.0


def test_label_needs_a_whole_horizon(spark):
    cells = [(1, b, .9 if b == 6 else .1) for b in range(1, 26)]
    got = collected(full(spark, cells, {1: (.5, .95)}), "severity_in_60m", "spike_in_15m")
    assert got[1, 5] == (1.0, 1.0) and got[1, 6] == (0.0, 0.0)
    assert sum(v[0] is None for v in got.values()) == 12
    assert sum(v[1] is None for v in got.values()) == 3
    k2 = collected(full(spark, cells, {1: (.5, .95)}, at_least=2), "severity_in_60m")
    assert k2[1, 5] == (0.0,)


def test_chunk_borders_change_nothing(spark):
    """A series cut into many chunks equals the same series in one."""
    cells = [(m, b, ((b * 37 + m * 11) % 100) / 50) for m in (1, 2) for b in range(3, 4200) if (b * 13 + m) % 7]
    table = {1: (1.2, 1.6), 2: (1.0, 1.5)}
    names = ["cpu_ewma_6", "cpu_ewma_24", "cpu_rolling_std_6", "cpu_lag_24", "time_since_last_spike", "cpu_spike_rate_24",
             "spike_severe_in_last_6", "severity_in_60m", "spike_in_45m"]
    whole, cut = (chunks.owned(full(spark, cells, table, size=s)).select("machine_id", "bucket", *names).toPandas()
                  .sort_values(["machine_id", "bucket"], ignore_index=True) for s in (8192, 1500))
    pd.testing.assert_frame_equal(whole, cut, check_exact=False, atol=1e-12)


def test_ewma_equals_pandas(spark):
    cells = [(1, b, ((b * 37) % 101) / 25) for b in range(500)]
    got = chunks.owned(full(spark, cells, {1: (2.0, 3.0)})).select("bucket", "total_cpu", "cpu_ewma_6").toPandas() \
        .sort_values("bucket", ignore_index=True)
    want = got["total_cpu"].ewm(halflife=6, adjust=False).mean()
    assert (got["cpu_ewma_6"] - want).abs().max() < 1e-13


def test_decayed_mean_over_rows_equals_pandas(spark):
    rows = [(1, 3 * i + i % 2, float((i * 17) % 29)) for i in range(3000)]
    df = spark.createDataFrame(rows, "machine_id long, bucket long, v double")
    frame = chunks.row_chunks(df, back=512, size=600, span=256)
    out = chunks.owned(chunks.decayed_mean(frame, "v", 11 / 13, "m", order="pos", size=600, back=512)).toPandas() \
        .sort_values("bucket", ignore_index=True)
    want = out["v"].ewm(span=12, adjust=False).mean()
    assert (out["m"] - want).abs().max() < 1e-11 and list(out["pos"]) == list(range(3000))


def test_slopes_and_time_to_threshold(spark):
    cells = [(1, b, .1 * b) for b in range(1, 9)]
    got = collected(full(spark, cells, {1: (1.0, 1.2)}), "cpu_vs_p95_slope_3", "time_to_p95_3")
    assert got[1, 1][0] == pytest.approx(.1 / 3)
    assert got[1, 8] == (pytest.approx(.1), pytest.approx(2.0))
    flat = collected(full(spark, [(1, b, 2.0) for b in range(1, 9)], {1: (1.0, 1.2)}), "time_to_p95_3")
    assert flat[1, 8] == (-24.0,)


def test_quantiles_match_numpy_with_ties_and_negatives(spark):
    values = [((i * 7919) % 1000 - 300) / 7 for i in range(997)] + [0.0] * 500
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: (r.a, r.b, r.c) for r in quantiles(df, ["k"], "v", {"a": 0.0, "b": .5, "c": .95}).collect()}
    for k, part in df.toPandas().groupby("k"):
        assert got[k] == pytest.approx(tuple(part["v"].quantile([0, .5, .95])), abs=1e-12)
    one = quantiles(df, [], "v", {"q": .99}).first().q
    assert one == pytest.approx(pd.Series(values).quantile(.99), abs=1e-12)


def test_running_totals_in_both_directions(spark):
    df = spark.createDataFrame([("x", float(i) / 3 - 5, 1) for i in range(40)], "k string, v double, m long")
    for desc in (False, True):
        rows = running_totals(df, ["k"], "v", ["m"], descending=desc).orderBy("v").collect()
        want = list(range(40, 0, -1)) if desc else list(range(1, 41))
        assert [r.through_m for r in rows] == want and rows[0].all_m == 40


def test_rank_ties_are_averaged(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 0.5), (2, 3.0)], "bucket long, total_cpu double")
    got = sorted(r.r for r in average_rank(df, ["bucket"], "total_cpu", "r").filter("bucket = 1").collect())
    assert got == [.5, .5, 1.0]


def test_p90_uses_training_buckets_only(spark):
    cells = [(m, b, m * .1) for m in range(1, 4) for b in range(10)] + [(9, 9, 50.0)]
    agg = agg_rows(spark, cells)
    got = {r.bucket: r.cluster_cpu_p90 for r in cross.attach_p90(agg, F.lit(5)).collect()}
    assert got[9] == pytest.approx(got[8]) and got[9] < 1
    both = cross.cross_section(agg, F.lit(5)).collect()
    assert all(math.isclose(r.cluster_cpu_p90, got[r.bucket]) for r in both)


def test_threshold_gap_and_fallbacks(spark):
    cells = [(1, b, .5) for b in range(20)] + [(2, b, b / 10) for b in range(20)] + [(3, 19, 4.0)]
    got = {r.machine_id: (r.threshold_p95, r.threshold_p99) for r in thresholds.learn(agg_rows(spark, cells), F.lit(11)).collect()}
    assert got[1] == (pytest.approx(.5), pytest.approx(.55))
    assert got[3][0] == pytest.approx(pd.Series([.5] * 12 + [b / 10 for b in range(12)]).quantile(.95))
    sparse = {r.machine_id: r.threshold_p95 for r in thresholds.bootstrap(agg_rows(spark, cells), 20).collect()}
    assert sparse[3] == pytest.approx(pd.Series([c for _, _, c in cells]).quantile(.95)) and sparse[1] == pytest.approx(.5)


def test_training_and_scoring_features_agree(spark):
    cells = [(m, b, ((b * 31 + m * 17) % 40) / 20) for m in (1, 2, 3) for b in range(100, 150) if (b + m) % 5]
    agg = agg_rows(spark, cells)
    table = thresholds.learn(agg, F.lit(149))
    a = features.build(agg, table, F.lit(149)).select("machine_id", "bucket", *S.MODEL_FEATURES)
    b = features.build(agg, table, None, labels=False).select("machine_id", "bucket", *S.MODEL_FEATURES)
    keys = ["machine_id", "bucket"]
    pd.testing.assert_frame_equal(a.toPandas().sort_values(keys, ignore_index=True), b.toPandas().sort_values(keys, ignore_index=True))
    assert a.count() == len(cells)


def test_series_plan_has_one_exchange_of_the_rows_and_no_python(spark):
    dense = series.dense_series(agg_rows(spark, GAP), limits(spark, {7: (.45, .65)}))
    plan = series.observed_rows(series.with_labels(series.with_features(dense)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert plan.count("hashpartitioning(machine_id") - plan.count("hashpartitioning(machine_id#") == 0
    assert sum("_chunk" in line for line in plan.splitlines() if "Exchange" in line) == 1


def test_hot_machine_spreads_over_tasks(spark):
    """One machine with most of the rows still fills several tasks, each with few of its rows."""
    cells = [(1, b, b % 9 / 4) for b in range(0, 20_000, 2)] + [(m, b, .1) for m in range(2, 6) for b in range(40)]
    table = {m: (1.0, 2.0) for m in range(1, 6)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dense = series.dense_series(agg_rows(spark, cells), limits(spark, table), size=1500)
        hot = dense.filter("machine_id = 1 and _own").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in hot) == 19_999
    assert len(hot) >= 4 and max(r["count"] for r in hot) < 12_000


def test_no_gap_is_filled_for_chunks_a_machine_does_not_reach(spark):
    """The halo of a chunk holds copies of the last rows; without a chunk to follow there is nothing to fill for them."""
    cells = [(1, b, b % 9 / 4) for b in range(2000, 4000, 10)]  # the chunk is 4096 long, all after 2656 is in the halo of the next
    dense = series.dense_series(agg_rows(spark, cells), limits(spark, {1: (1.0, 2.0)}), size=4096)
    rows = dense.select("bucket", "_own", "_first").orderBy("bucket").collect()
    assert [(r.bucket, r._own, r._first) for r in rows] == [(b, True, b == 2000) for b in range(2000, 3991)]
    both = series.dense_series(agg_rows(spark, cells + [(1, 5000, 1.0)]), limits(spark, {1: (1.0, 2.0)}), size=4096)
    assert [r.bucket for r in both.filter("_own").select("bucket").orderBy("bucket").collect()] == list(range(2000, 5001))
    assert [(r.bucket, r._own) for r in both.filter("_first").select("bucket", "_own").orderBy("bucket").collect()] == [(2000, True), (2656, False)]


def test_measured_rows_alone_give_what_the_filled_series_gives(spark):
    """Gaps, nulls, machines without thresholds, idle buckets above a negative threshold, chunk borders."""
    cells = [(m, b, ((b * 37 + (m or 0) * 11) % 100) / 50 - .4) for m in (1, 2, 3, None) for b in [*range(3, 90), *range(91, 4200)]
             if (b * b * 13 + (m or 0)) % 11 < 3 or 1490 < b < 1530]
    table = {1: (1.2, 1.3), 2: (-.2, -.1), 4: (1.0, 2.0)}
    agg = agg_rows(spark, cells).unionByName(agg_rows(spark, [(5, 7, 1.0)])).withColumn(
        "total_cpu", F.when(F.col("bucket") % 29 == 3, None).otherwise(F.col("total_cpu")))
    known = limits(spark, table)
    for at_least in (1, 3):
        dense = series.observed_rows(series.with_labels(series.with_features(series.dense_series(agg, known, size=1500), size=1500), 12, at_least))
        chunked = series.measured_series(agg, known, size=1500)
        rows = series.observed_rows(series.measured_features(chunked, size=1500, labels=True, at_least=at_least))
        names = ["machine_id", "bucket", *[c for c in S.MODEL_FEATURES if c in dense.columns], *S.LABELS]
        want, got = (df.select(names).toPandas().sort_values(["machine_id", "bucket"], ignore_index=True) for df in (dense, rows))
        assert len(want) == len(cells) + 1 and want["spike_in_last_1"].sum() > 0
        pd.testing.assert_frame_equal(want, got, check_exact=False, rtol=1e-12, atol=1e-12)


def test_features_fill_no_gaps(spark):
    """A machine measured twice, a year apart: what is sorted does not grow with the buckets between."""
    agg = agg_rows(spark, [(1, 0, .5), (1, 8000, .7)])
    plan = features.build(agg, limits(spark, {1: (.4, .6)}), None)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_from" not in text
    assert {r.bucket: (r.cpu_lag_1, r.time_since_last_spike) for r in plan.collect()} == {0: (0.0, 24.0), 8000: (0.0, 24.0)}
