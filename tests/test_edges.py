"""Legal but awkward input: NaN and infinite values, wide ids, empty micro-batches, rows without probability, any smoothing."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import inventory, models, ordered, scoring, splits
from tidewatch.session import fresh_path
from tidewatch.sources import contracts, readers
from tidewatch.streaming import streams

NAN, INF = float("nan"), float("inf")


def numbers(spark, values):
    return spark.createDataFrame([("g", v) for v in values], "k string, v double")


def test_quantiles_ignore_nan_and_order_infinities(spark):
    half = lambda values: ordered.quantiles(numbers(spark, values), ["k"], "v", {"m": 0.5}).first().m
    assert half([0.5, 0.6, 0.7, NAN, 3.0, None]) == pytest.approx(0.65)
    assert half([-INF, 1.0, INF]) == 1.0 and half([INF, INF, 1.0]) == INF and half([-INF, -INF, 1.0]) == -INF


def test_nan_has_no_rank(spark):
    rows = ordered.average_rank(numbers(spark, [0.5, 1.5, NAN, 3.0, INF]), ["k"], "v", "r").collect()
    assert {r.v: r.r for r in rows if not math.isnan(r.v)} == {0.5: 0.25, 1.5: 0.5, 3.0: 0.75, INF: 1.0}
    assert [r.r for r in rows if math.isnan(r.v)] == [None]


def test_quantiles_shuffle_values_of_the_wanted_bands_only(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("k"), (F.rand(1) + 1).alias("v"))
    got = ordered.quantiles(rows, ["k"], "v", {"m": 0.5}, few_groups=True)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.find("Initial Plan"):] if "Initial Plan" in plan else plan
    # values are shuffled only after the join with the two bands that hold the wanted rank
    below = initial[initial.find("_band", initial.find("Exchange hashpartitioning(k")):]
    assert "BroadcastHashJoin" in below and "v#" not in below[below.find("BroadcastHashJoin"):].split("Exchange hashpartitioning", 1)[-1].split(")")[0]


def test_wide_ids_survive(spark, tmp_path):
    wide = 9007199254740993
    rows = spark.createDataFrame([(str(wide), "7.0", "1e3", "x")], "machine_id string, bucket string, time_us string, n_tasks string")
    got = contracts.coerce(rows).first()
    assert (got.machine_id, got.bucket, got.time_us, got.n_tasks) == (wide, 7, 1000, None)
    assert contracts.coerce(spark.createDataFrame([(wide,)], "machine_id long")).first().machine_id == wide
    rows.select("machine_id", "bucket").write.option("header", True).csv(f"{tmp_path}/agg.csv")
    assert readers.cluster_agg(spark, f"{tmp_path}/agg.csv").first().machine_id == wide


def predictions(spark, rows):
    schema = ("machine_id long, cycle long, status string, p_moderate double, p_severe double, is_spike boolean, is_severe boolean, "
              "recommended_action string, alarm_threshold double")
    return spark.createDataFrame([(1, c, s, p, 0.0 if p is not None else None, spike, False, "act" if spike else "normal", 0.5) for c, s, p, spike in rows], schema)


def test_a_warm_row_without_probability_ends_the_streak_in_stream_and_batch(spark, tmp_path):
    rows = predictions(spark, [(1, "ok", 0.9, True), (2, "ok", None, False), (3, "ok", 0.9, True), (4, "ok", 0.9, True), (5, "cold_start", None, False), (6, "ok", 0.9, True)])
    batch = {r.cycle: (r.consecutive_alarms, r.is_spike) for r in scoring.debounce(scoring.smooth(rows)).collect()}
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.alarm_states(streams.landed_files(spark, f"{tmp_path}/in", rows.schema))
    streams.run_available(stream, streams.versioned_sink(f"{tmp_path}/out"), "alarms", mode="append")
    streamed = {r.cycle: (r.consecutive_alarms, r.is_spike) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert streamed == batch and batch[3] == (1, False) and batch[4] == (2, True) and batch[6] == (3, True)


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.9, 0.999, 1.0])
def test_smoothing_takes_any_weight(spark, alpha):
    p = [0.1 + 0.8 * ((7 * i) % 10) / 10 for i in range(60)]
    got = {r.cycle: r.p_spike_smoothed for r in scoring.smooth(predictions(spark, [(i, "ok", x, True) for i, x in enumerate(p)]), alpha).collect()}
    mean = p[0]
    for i, x in enumerate(p):
        mean = x if i == 0 else alpha * x + (1 - alpha) * mean
        assert got[i] == pytest.approx(mean)


def test_an_empty_first_batch_leaves_a_table(spark):
    history, out = fresh_path(spark, "history"), fresh_path(spark, "out")
    rows = spark.createDataFrame([(1, b, float(b)) for b in range(4)], "machine_id long, bucket long, total_cpu double")
    sink = streams.lookback_sink(history, out, buckets=3)
    for i, part in enumerate((rows.limit(0), rows.filter("bucket < 2"), rows.filter("bucket >= 2"))):
        sink(part, i)
    got = {r.bucket: (r.rows_in_window, r.mean_in_window) for r in spark.read.parquet(out).collect()}
    assert got == {0: (1, 0.0), 1: (2, 0.5), 2: (3, 1.0), 3: (3, 2.0)}


def test_interval_statistics_whole_cut_and_newest(spark):
    clocks = [0, 100, 1000, 1500, 90_000, 90_060, 400_000]
    rows = spark.createDataFrame([(1, c) for c in clocks] + [(2, 5), (None, 7)], "hostid long, clock long")
    whole = inventory.interval_statistics(rows).collect()
    assert [tuple(r) for r in inventory.interval_statistics(rows, chunk_seconds=1000).collect()] == [pytest.approx(tuple(r)) for r in whole]
    assert (whole[0].n_readings, whole[0].min_gap, whole[0].max_gap, whole[0].long_gaps) == (7, 60, 309_940, 3)
    newest = inventory.interval_statistics(rows, newest=2).first()
    assert (newest.n_readings, newest.min_gap, newest.std_gap) == (2, 309_940, None)


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(2000).select(F.col("id").alias("machine_id"), (F.col("id") % 7).alias("bucket"))
    ids = lambda df: sorted(r.machine_id for r in splits.seeded_sample(df, 0.1).collect())
    assert ids(rows) == ids(rows.repartition(5, F.rand(3))) and 120 < len(ids(rows)) < 280


def test_long_feature_lists_are_compared_whole(spark, tmp_path):
    names = [f"f{i}" for i in range(12_000)]
    spark.createDataFrame(list(enumerate(names)), "position int, feature string").write.json(f"{tmp_path}/features")
    with pytest.raises(ValueError, match="feature list"):
        models.load(spark, str(tmp_path), names[:-1])
    with pytest.raises(Exception) as found:  # the list is right; only the model is missing
        models.load(spark, str(tmp_path), names)
    assert "feature list" not in str(found.value)


def test_the_prediction_record_feeds_smoothing(spark):
    schema = ("machine_id long, cycle long, status string, observations_used long, data_quality double, threshold_p95 double, threshold_source string, "
              "p15 double, p30 double, p45 double, p_no double, p_mod double, p_sev double, p_ovr double")
    rows = [(1, c, "success", 30, 1.0, 0.4, "learned", 0.2, None, None, 0.2, 0.5, 0.3, None) for c in range(3)]
    rows += [(2, c, "cold_start", 3, 0.1, None, None, None, None, None, None, None, None, None) for c in range(3)]
    decided = scoring.decide(spark.createDataFrame(rows, schema))
    record = scoring.envelope(decided, {"60m": 0.25}, trained_at="2024-01-01", model_version="v2")
    first = record.filter("machine_id = 1 and cycle = 0").first()
    assert sorted(first.imminence) == ["15m", "60m"] and first.imminence["60m"].p_moderate == 0.5 and first.imminence["15m"].p_moderate is None
    assert (first.alarm_threshold, first.threshold_used, first.threshold_source, first.model_version, first.trained_at) == (0.25, 0.4, "learned", "v2", "2024-01-01")
    cold = record.filter("machine_id = 2").first()
    assert cold.imminence is None and cold.alarm_threshold is None and cold.threshold_used is None
    got = {(r.machine_id, r.cycle): r for r in scoring.debounce(scoring.smooth(record)).collect()}
    assert got[1, 0].is_spike is False and got[1, 2].is_spike is True and got[1, 2].p_spike_smoothed == pytest.approx(0.8) and got[2, 1].p_spike_smoothed is None


def test_calibrators_get_a_bounded_number_of_points(spark):
    rows = spark.range(5000).select((F.col("id") / 5000).alias("p0"), (F.col("id") % 5000 > 2500).cast("int").alias("y"))
    fit = models.fit_calibrators(rows.withColumn("y", 1 - F.col("y")), "y", ["p0"], grid=20)[0]
    assert fit.boundaries.size <= 21 and fit.predictions[-1] > 0.9 and fit.predictions[0] < 0.1
