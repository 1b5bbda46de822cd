"""Drift, metrics, splits and baselines against brute force."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import baselines, drift, metrics, profile, splits


def column(spark, values, name="f"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def psi(spark, ref, live, names=("f",)):
    return {r.feature: r.psi for r in drift.psi_table(column(spark, ref), column(spark, live), list(names)).collect()}


def brute_psi(ref, live, bins=10):
    ref, live = sorted(ref), list(live)
    edges = sorted(set(pd.Series(ref).quantile([i / bins for i in range(bins + 1)])))
    total = 0.0
    for i in range(len(edges) - 1):
        last = i == len(edges) - 2
        inside = lambda v: edges[i] <= v < edges[i + 1] or (last and v == edges[-1])  # noqa: E731, B023
        e = max(sum(map(inside, ref)) / len(ref), 1e-4)
        a = max(sum(map(inside, live)) / len(live), 1e-4)
        total += (a - e) * math.log(a / e)
    return total


def test_psi_properties(spark):
    rng = random.Random(1)
    ref = [rng.gauss(0, 1) for _ in range(1000)]
    moved = [v + 1.5 for v in ref]
    assert psi(spark, ref, ref)["f"] == pytest.approx(0.0, abs=1e-12)
    assert psi(spark, ref, moved)["f"] == pytest.approx(brute_psi(ref, moved), abs=1e-9)
    assert psi(spark, ref, moved)["f"] > .5
    ties = [0.0] * 700 + ref[:300]
    assert psi(spark, ties, ref)["f"] == pytest.approx(brute_psi(ties, ref), abs=1e-9)


def test_psi_degenerate_and_binary(spark):
    assert psi(spark, [.5] * 50, [.5] * 50)["f"] is None
    assert psi(spark, [None, float("nan"), float("inf")], [1.0, 2.0])["f"] is None
    assert psi(spark, [1.0, 2.0], [None])["f"] is None
    got = psi(spark, [0.0] * 90 + [1.0] * 10, [0.0] * 50 + [1.0] * 50)["f"]
    assert got == pytest.approx((.5 - .9) * math.log(.5 / .9) + (.5 - .1) * math.log(.5 / .1))
    assert psi(spark, [0.0] * 10, [1.0] * 10)["f"] == pytest.approx(2 * (1 - 1e-4) * math.log(1e4))
    assert psi(spark, [1.0, 2.0], [1.0], ("f", "gone"))["gone"] is None


def test_system_alert_needs_more_than_a_tenth(spark):
    live = spark.createDataFrame([(b,) for b in range(100)], "bucket long")

    def alert(bad):
        rows = [(f"f{i}", .3 if i < bad else 0.0, 0.0, 0.0, 1, 1) for i in range(10)] + [("n", None, None, None, None, None)]
        table = spark.createDataFrame(rows, "feature string, psi double, reference_mean double, live_mean double, n_ref long, n_live long")
        return drift.report(table, live).first()
    assert not alert(1).system_alert and alert(2).system_alert
    assert alert(1).recommendation == "retrain" and alert(1).n_valid == 10


def test_ranking_matches_pair_counts(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 1), rng.choice([.1, .2, .2, .4, .7, .9]) if k else rng.random()) for k in (0, 1) for _ in range(300)]
    rows += [(2, 1, .5)] * 4
    df = spark.createDataFrame(rows, "k int, y int, score double")
    got = {r.k: r for r in metrics.ranking(df, ["k"]).collect()}
    assert got[2].pr_auc is None and got[2].roc_auc is None and got[2].n_pos == 4
    for k in (0, 1):
        pos = [s for g, y, s in rows if g == k and y]
        neg = [s for g, y, s in rows if g == k and not y]
        wins = sum((p > n) + .5 * (p == n) for p in pos for n in neg)
        assert got[k].roc_auc == pytest.approx(wins / len(pos) / len(neg))
        ap = before = 0.0
        for t in sorted(set(pos + neg), reverse=True):
            tp, all_ = sum(p >= t for p in pos), sum(s >= t for s in pos + neg)
            ap += (tp / len(pos) - before) * tp / all_
            before = tp / len(pos)
        assert got[k].pr_auc == pytest.approx(ap)


def test_sweep_and_choice(spark):
    df = spark.createDataFrame([(0, .1), (0, .3), (1, .4), (1, .9), (0, .95)], "y int, score double")
    swept = metrics.sweep(df, [])
    row = swept.filter(F.abs(F.col("threshold") - .4) < 1e-9).first()
    assert (row.tp, row.alarms, row.positives) == (2, 3, 2)
    assert metrics.best_threshold(swept, []).first().threshold == pytest.approx(.35)
    assert metrics.best_threshold(swept, [], .99).first().threshold == pytest.approx(.35)
    none = metrics.sweep(spark.createDataFrame([(0, .1), (0, .9)], "y int, score double"), [])
    assert metrics.best_threshold(none, []).first().threshold == .5


def test_bootstrap_brackets_the_point_estimate(spark):
    rng = random.Random(5)
    rows = [(i, int(rng.random() < .3), 0.0) for i in range(400)]
    rows = [(i, y, rng.random() * .7 + .3 * y) for i, y, _ in rows]
    df = spark.createDataFrame(rows, "id long, y int, score double")
    point = metrics.ranking(df, []).first().pr_auc
    ci = metrics.bootstrap_interval(df, [], ["id"], replicates=60).first()
    assert ci.low < point < ci.high and ci.high - ci.low < .3


def test_kendall(spark):
    def tau(values):
        return metrics.kendall_trend(spark.createDataFrame(list(enumerate(map(float, values))), "fold int, value double")).first()
    assert tau([1, 2, 3, 4]).direction == "improving" and tau([4, 3, 2, 1]).tau == -1
    assert tau([1, 3, 2, 3]).tau == pytest.approx(3 / math.sqrt(6 * 5))


def test_walk_forward_by_time_and_by_row(spark):
    df = spark.createDataFrame([(m, b) for m in range(4) for b in range(60)], "machine_id long, bucket long")
    for by in ("bucket", "row"):
        out = splits.walk_forward(df, folds=5, gap=2, by=by).toPandas()
        for f, part in out.groupby("fold"):
            key = part["bucket"] if by == "bucket" else part["machine_id"] * 60 + part["bucket"]
            train, test = key[part.role == "train"], key[part.role == "test"]
            assert train.max() < test.min() - 2
            assert test.nunique() == (10 if by == "bucket" else 40)


def test_split_is_anchored_at_the_first_bucket(spark):
    df = spark.createDataFrame([(b,) for b in range(1_000_000, 1_000_101)], "bucket long")
    got = {r.split: r["count"] for r in splits.chronological(df).groupBy("split").count().collect()}
    assert got == {"train": 61, "val": 20, "test": 20}


def test_baselines_equal_pandas(spark):
    rows = [(m, 2 * b, ((b * 31 + m * 7) % 23) / 10, 1.5) for m in (1, 2) for b in range(60)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows],
                               "machine_id long, bucket long, total_cpu double, p95 double, spike_in_15m double,"
                               "spike_in_30m double, spike_in_45m double, severity_in_60m double")
    got = baselines.score_all(df).toPandas().sort_values(["machine_id", "bucket"], ignore_index=True)
    for _, g in got.groupby("machine_id"):
        x = g["total_cpu"]
        over = (x > 1.5).astype(float)
        assert (g["static_thresh"] - over.shift(1).rolling(4, min_periods=1).mean().fillna(0)).abs().max() < 1e-12
        mu = x.ewm(span=12, adjust=False).mean().shift(1)
        var = (x - mu).pow(2).ewm(span=12, adjust=False).mean().shift(1)
        z = ((x - mu) / var.pow(.5).clip(lower=1e-9)).clip(lower=0).fillna(0)
        assert (g["ewma_zscore"] - z).abs().max() < 1e-9
        rz = ((x - x.rolling(24, min_periods=4).mean().shift(1))
              / x.rolling(24, min_periods=4).std().shift(1).clip(lower=1e-9)).clip(lower=0).fillna(0)
        assert (g["rolling_zscore"] - rz).abs().max() < 1e-9
    assert set(baselines.SCORERS) <= set(got.columns)


def test_run_lengths_cross_chunks(spark, monkeypatch):
    hits = [i % 97 != 0 for i in range(9000)]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(hits)], "machine_id long, bucket long, h boolean")
    got = [r.n for r in profile.run_lengths(df, F.col("h"), "n").orderBy("bucket").collect()]
    want, run = [], 0
    for h in hits:
        run = run + 1 if h else 0
        want.append(run)
    assert got == want


def test_profile_of_a_flat_machine(spark):
    df = spark.createDataFrame([(1, b, .5) for b in range(30)] + [(2, 3, .2)], "machine_id long, bucket long, total_cpu double")
    got = {r.machine_id: r for r in profile.node_profile(df, S.SLOTS_PER_DAY).collect()}
    assert got[1].acf_lag1 == 0.0 and got[1].spike_rate == 0.0 and got[1].mean_ep_len == 0.0 and got[1].biz_ratio == 1.0
    assert got[2].acf_lag1 is None and got[2].n_buckets == 1
