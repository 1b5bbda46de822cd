"""Decisions, smoothing, debounce, service levels and the stream forms."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as X
from tidewatch.operators import models, scoring
from tidewatch.session import fresh_path
from tidewatch.streaming import streams

COLS = "machine_id long, status string, p15 double, p30 double, p45 double, p_no double, p_mod double, p_sev double, p_ovr double"


def decide(spark, *rows, **kw):
    return {r.machine_id: r for r in scoring.decide(spark.createDataFrame(list(rows), COLS), **kw).collect()}


def test_ladder_gate_and_monotone_horizons(spark):
    got = decide(
        spark,
        (1, "success", .9, .1, .1, .9, .05, .05, None), (2, "success", .1, .6, .2, .9, .05, .05, None),
        (3, "success", .1, .2, .6, .9, .05, .05, None), (4, "success", .1, .1, .1, .2, .2, .6, None),
        (5, "success", .1, .1, .1, .2, .6, .2, None), (6, "success", .1, .1, .1, .95, .03, .02, .99),
        (7, "cold_start", None, None, None, None, None, None, None), (8, "success", .4, None, .1, .9, .05, .05, None))
    assert [got[i].recommended_action for i in range(1, 8)] == [
        "preempt_now", "migrate_jobs", "defer_new_jobs", "defer_batch", "monitor", "normal", None]
    assert got[1].p_spike_60m == .9 and got[6].is_severe is False and got[7].is_spike is None
    assert got[8].p_spike_45m == .1 and got[5].is_severe is False
    assert decide(spark, (1, "success", .3, .3, .3, .9, .05, .05, None), override=.2)[1].recommended_action == "preempt_now"


def preds(spark, seqs, threshold=.5):
    rows = [(c, m, "success", p * .6, p * .4, threshold, p >= .4, p >= .8, "monitor" if p >= .4 else "normal")
            for m, ps in seqs.items() for c, p in enumerate(ps) if p is not None]
    rows += [(c, m, "cold_start", None, None, threshold, None, None, None)
             for m, ps in seqs.items() for c, p in enumerate(ps) if p is None]
    return spark.createDataFrame(rows, "cycle long, machine_id long, status string, p_moderate double, p_severe double,"
                                       "alarm_threshold double, is_spike boolean, is_severe boolean, recommended_action string")


SEQ = {1: [.9, .9, .1, .9, .9, .9], 2: [None, None, .9, .9, .2, .2], 3: [.1, .9, .1, .1, .1, .1]}


def test_smoothing_only_removes_alarms_and_debounce_waits(spark):
    s = {(r.machine_id, r.cycle): r for r in scoring.smooth(preds(spark, SEQ)).collect()}
    assert s[1, 0].p_spike_smoothed == pytest.approx(.9) and s[1, 2].p_spike_smoothed == pytest.approx(.5)
    assert s[3, 1].p_spike_smoothed == pytest.approx(.5) and s[2, 0].p_spike_smoothed is None
    d = {(r.machine_id, r.cycle): r for r in scoring.debounce(scoring.smooth(preds(spark, SEQ))).collect()}
    assert [d[1, c].consecutive_alarms for c in range(6)] == [1, 2, 0, 1, 2, 3]
    assert [d[1, c].is_spike for c in range(6)] == [False, True, False, False, True, True]
    assert d[2, 0].consecutive_alarms == 0 and d[2, 3].recommended_action == "monitor"


def test_stream_state_equals_batch(spark):
    rows = preds(spark, SEQ)
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "out")
    for lo, hi in ((0, 1), (2, 3), (4, 5)):
        rows.filter(F.col("cycle").between(lo, hi)).coalesce(1).write.mode("append").parquet(landing)
    streams.run_available(streams.alarm_states(streams.landed_files(spark, landing, rows.schema)),
                          streams.versioned_sink(out), "alarms", mode="append")
    cols = ["machine_id", "cycle", "is_spike", "is_severe", "recommended_action", "consecutive_alarms", F.round("p_spike_smoothed", 9)]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert key(spark.read.parquet(out)) == key(scoring.debounce(scoring.smooth(rows)))


def test_stream_rollup_and_sessions(spark):
    rows = [(f"2024-01-01 00:{m:02d}:30", k, float(m)) for m in range(0, 50, 2) for k in (1, 2)]
    df = spark.createDataFrame(rows, "ts string, machine_id long, v double").withColumn("ts", F.to_timestamp("ts"))
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "out")
    df.coalesce(1).write.parquet(landing)
    stream = streams.landed_files(spark, landing, df.schema)
    streams.run_available(streams.rollup_stream(stream, [F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")]),
                          streams.versioned_sink(out), "rollup")
    got = streams.newest_version(spark, out, ["machine_id", "bucket"])
    assert got.count() == 20 and got.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    hot = df.filter("v % 10 < 6").withColumn("v", F.lit(1.0))
    assert streams.session_episodes(hot, F.col("v") > 0, 120).groupBy("machine_id").count().first()["count"] == 5


def test_summary_and_slo(spark):
    p = preds(spark, SEQ).withColumns({f"alarm_{h}": F.col("is_severe") for h in ("15m", "30m", "45m")}) \
        .withColumn("p_spike_smoothed", F.col("p_moderate") + F.col("p_severe"))
    node = {(r.machine_id, r.cycle): r for r in scoring.node_summary(p).collect()}
    assert node[1, 0].alarm_source == "binary_15m" and node[1, 0].scheduler_score == 10 and node[2, 0].alarm_source is None
    assert scoring.fleet_summary(p, ["cycle"]).filter("cycle = 1").first().spikes_in_60m == 2
    stats = scoring.cycle_stats(p)
    assert stats.filter("cycle = 0").first().cold_start_rate == pytest.approx(1 / 3)
    slo = scoring.slo_records(stats, F.lit(.5), F.col("cycle") == 0)
    one = scoring.slo_summary(slo).first()
    assert one.success_rate == pytest.approx(1 / 6) and one.alarm_rate_std is None and one.latency_p95_s == .5
    assert slo.filter("cycle_index = 1").first().machines_total is None
    assert scoring.last_cycles(slo, 2).count() == 2


def test_version_strings(spark):
    df = spark.createDataFrame([("2026-04-29T14:30:00+00:00", ["b", "a"]), (None, ["a", "b"]), ("not a date", [])],
                               "at string, cols array<string>")
    got = [r.v for r in df.select(X.model_version("at", "cols").alias("v")).collect()]
    import hashlib
    h = hashlib.sha256(b"a|b").hexdigest()[:6]
    assert got == [f"20260429T143000Z_{h}", f"unknown_{h}", "notadate_000000"]


def test_model_round_trip_guards_and_learning(spark, tmp_path):
    rows = [(i, i % 50, float(i % 10), float((i * 7) % 11), int(i % 10 > 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "machine_id long, bucket long, a double, b double, y int")
    model = models.fit_binary(df, "y", ["a", "b"], trees=3, depth=2)
    path = models.save(model, str(tmp_path / "m"), ["a", "b"])
    again = models.load(spark, path, ["a", "b"])
    scored = models.positive_probability(again, df, "p").groupBy("y").agg(F.avg("p").alias("p")).collect()
    assert {r.y: r.p for r in scored}[1] > {r.y: r.p for r in scored}[0]
    with pytest.raises(ValueError, match="feature list"):
        models.load(spark, path, ["b", "a"])
    with pytest.raises(ValueError, match="positive"):
        models.fit_binary(df.filter("y = 0"), "y", ["a", "b"])
    top = models.occlusion(model, df, df, ["a", "b"]).orderBy(F.desc("attribution")).first()
    assert top.feature == "a"


def test_calibration_stays_a_distribution(spark):
    rows = [(i % 3, (i % 7) / 10, (i % 5) / 10, (i % 4) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double")
    fits = models.fit_calibrators(df, "y", ["p0", "p1", "p2"])
    out = models.apply_calibrators(fits, df, ["p0", "p1", "p2"]).select((F.col("cal_0") + F.col("cal_1") + F.col("cal_2")).alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in out.collect())
