"""Streams against their batch forms: late rows, whole cycles, expiring state."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.session import fresh_path
from tidewatch.streaming import streams
from tests.test_edges import predictions

AGG = "machine_id long, bucket long, total_cpu double"


def by_key(df):
    return {(r.machine_id, r.bucket): (r.rows_in_window, round(r.mean_in_window, 9)) for r in df.collect()}


def test_late_and_repeated_rows_correct_what_follows(spark):
    rng = random.Random(3)
    rows = {(m, b): rng.random() for m in (1, 2) for b in range(40) if rng.random() < 0.8}
    late = {k: v for k, v in rows.items() if rng.random() < 0.2}
    again = {k: v for k, v in rows.items() if k not in late and k[1] < 20 and rng.random() < 0.2}
    first = {k: v for k, v in rows.items() if k not in late and k[1] < 25} | {k: -5.0 for k in again}
    second = {k: v for k, v in rows.items() if k not in late and k[1] >= 25}
    history, out = fresh_path(spark, "history"), fresh_path(spark, "log")
    sink = streams.lookback_sink(history, out, buckets=5)
    table = lambda part: spark.createDataFrame([(*k, v) for k, v in part.items()], AGG)
    for i, part in enumerate((first, second, late)):
        sink(table(part), i)
    sink(table(again), 3)
    sink(table(again), 3)  # a replay
    want = by_key(streams.lookback(table(rows), 5))
    keys = ["machine_id", "bucket"]
    assert by_key(streams.newest_version(spark, out, keys)) == want and len(want) == len(rows)
    log = spark.read.parquet(out)
    assert log.filter("batch = 2").count() < len(rows)  # only rows whose window changed are written anew
    streams.compact(spark, out, keys)
    assert by_key(spark.read.parquet(out)) == want and spark.read.parquet(out).select("batch").distinct().count() == 1
    more = {(1, 41): 0.5, (2, 39): 0.25}
    sink(table(more), 4)
    assert by_key(streams.newest_version(spark, out, keys)) == by_key(streams.lookback(table(rows | more), 5))


def test_a_compaction_that_broke_off_is_completed(spark):
    path = fresh_path(spark, "log")
    for i, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([(1, 1, v), (2, i, v)], AGG).write.parquet(f"{path}/batch={i}")
    want = {(1, 1, 2.0), (2, 0, 1.0), (2, 1, 2.0)}
    spark.createDataFrame(sorted(want), AGG).write.parquet(f"{path}-folded/batch=1")
    open(f"{path}-folded/_SUCCESS", "w").close()
    streams.compact(spark, path, ["machine_id", "bucket"])
    assert {(r.machine_id, r.bucket, r.total_cpu) for r in spark.read.parquet(path).collect()} == want


def cycles(spark):
    good = spark.createDataFrame([(m, b, 0.1 * m + 0.01 * b) for m in (1, 2, 9) for b in range(6)], AGG)
    bad = spark.createDataFrame([(1, 7, -1.0), (2, 7, None)], AGG)
    return [good, good.limit(0), bad, spark.createDataFrame([(9, 6, 0.99), (3, 6, 0.2)], AGG)]


def build(rows):
    return rows.groupBy("machine_id").agg(F.max_by("total_cpu", "bucket").alias("total_cpu"), F.count("*").alias("n"))


def decided(features):
    action = F.when(F.col("total_cpu") > 0.8, "migrate_jobs").otherwise("normal")
    return features.select("machine_id", "total_cpu", F.when(F.col("n") < 3, "cold_start").otherwise("success").alias("status"), action.alias("recommended_action"))


def test_a_cycle_writes_features_scores_alarms_and_record(spark):
    root = fresh_path(spark, "cycle")
    sink = streams.scoring_cycle_sink(F.col("total_cpu") >= 0, build, decided, root, buckets=4)
    for i, batch in enumerate(cycles(spark)):
        sink(batch, i)
    read = lambda name: sorted(map(tuple, spark.read.parquet(f"{root}/{name}").collect()), key=str)
    first = {name: read(name) for name in ("accepted", "quarantine", "features", "scores", "alarms", "slo")}
    slo = {r.cycle_index: r for r in spark.read.parquet(f"{root}/slo").collect()}
    assert [slo[i].success for i in range(4)] == [True, False, False, True]
    assert [slo[i].problem for i in range(4)] == [None, "no accepted rows", "no accepted rows", None]
    assert (slo[0].machines_total, slo[0].machines_predicted, slo[0].alarm_count) == (3, 3, 1) and slo[2].machines_total is None
    assert (slo[3].machines_total, slo[3].machines_cold_start, slo[3].alarm_count) == (4, 1, 1)
    accepted = spark.read.parquet(f"{root}/accepted").drop("batch")
    batch = decided(build(accepted.filter("bucket > 2")))  # the last cycle's buckets, all at once
    assert [r[:4] for r in read("scores") if r[4] == 3] == sorted(map(tuple, batch.collect()), key=str)
    for i, part in enumerate(cycles(spark)):
        sink(part, i)
    assert {name: read(name) for name in first} == first  # a replay writes the same


def test_a_failing_model_is_recorded(spark):
    root = fresh_path(spark, "cycle")
    sink = streams.scoring_cycle_sink(F.lit(True), build, lambda f: f.select("no_such_column"), root)
    sink(cycles(spark)[0], 0)
    record = spark.read.parquet(f"{root}/slo").first()
    assert record.success is False and record.problem == "AnalysisException" and record.rows_accepted == 18 and record.machines_total is None


@pytest.mark.parametrize("silent, streaks", [(3600.0, [1, 2, 3, 4]), (0.001, [1, 2, 1, 2])])
def test_the_state_of_a_silent_machine_goes(spark, tmp_path, silent, streaks):
    rows = predictions(spark, [(i, "ok", 0.9, True) for i in range(4)])
    rows.filter("cycle < 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for part in (None, "cycle >= 2"):
        if part:
            time.sleep(1)
            rows.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.alarm_states(streams.landed_files(spark, f"{tmp_path}/in", rows.schema), silent=silent)
        streams.run_available(stream, streams.versioned_sink(f"{tmp_path}/out"), "alarms", mode="append", checkpoint=f"{tmp_path}/checkpoint")
    got = {r.cycle: r.consecutive_alarms for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[i] for i in range(4)] == streaks


def _alarms_by_pandas(rows, smoothed, streak, alpha, at_least):
    """``streams.step_alarms`` with a step of pandas for each of its steps."""
    rows = rows.sort_values("cycle", ignore_index=True)
    warm = (rows["status"] != "cold_start").to_numpy()
    p = (rows["p_moderate"] + rows["p_severe"]).to_numpy(dtype=float)
    known = warm & ~np.isnan(p)
    means = np.full(len(rows), np.nan)
    if known.any():
        values = p[known] if smoothed is None else np.concatenate(([smoothed], p[known]))
        means[known] = pd.Series(values).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-known.sum():]
        smoothed = float(means[known][-1])
    limit = rows["alarm_threshold"].to_numpy(dtype=float)
    spiking = warm & np.array([v is True for v in rows["is_spike"]]) & (~known | (means >= limit))
    streaks, n = np.zeros(len(rows), np.int64), streak
    for i in np.flatnonzero(warm):
        n = n + 1 if spiking[i] else 0
        streaks[i] = n
    quiet = warm & (known & (means < limit) | ((streaks > 0) & (streaks < at_least)))
    for column, value in (("is_spike", False), ("is_severe", False), ("recommended_action", "normal")):
        rows[column] = rows[column].mask(quiet, value)
    return rows.assign(p_spike_smoothed=means, consecutive_alarms=streaks), smoothed, n


def test_alarm_steps_equal_those_of_pandas_and_cost_less():
    draw = np.random.default_rng(3)

    def machine(n, cold):
        some = lambda *of: pd.Series(draw.choice(np.array(of, dtype=object), n), dtype=object)
        rows = pd.DataFrame({"machine_id": 5, "cycle": draw.permutation(n), "status": ["cold_start"] * cold + ["success"] * (n - cold),
                             "p_moderate": draw.random(n), "p_severe": np.where(draw.random(n) < .2, np.nan, draw.random(n) * .4), "alarm_threshold": .5,
                             "alarm_15m": some(True, False, None), "is_spike": some(True, True, False, None), "is_severe": some(True, False, None),
                             "recommended_action": some("migrate_jobs", "normal", None)})
        return rows if draw.random() < .5 else rows.assign(cycle=np.arange(n))

    cases = [(machine(n, cold), s, k) for n in (1, 2, 30) for cold in (0, 1, n) if cold <= n for s, k in ((None, 0), (.7, 0), (.2, 3))]
    for rows, smoothed, streak in cases:
        want, got = (f(rows.copy(), smoothed, streak, .5, 2) for f in (_alarms_by_pandas, streams.step_alarms))
        pd.testing.assert_frame_equal(want[0], got[0][list(want[0].columns)], check_dtype=False)
        assert got[2] == want[2] and (got[1] == want[1] or abs(got[1] - want[1]) < 1e-12)
    spent = []
    for f in (_alarms_by_pandas, streams.step_alarms):
        begun = time.process_time()
        for rows, smoothed, streak in cases * 5:
            f(rows.copy(), smoothed, streak, .5, 2)
        spent.append(time.process_time() - begun)
    assert spent[1] < spent[0] / 2, spent
