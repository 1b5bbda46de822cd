"""Attribution, walk-forward fits, calibration, search and bundles against plain versions."""

import threading
from functools import partial

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.session import materialise
from tidewatch.operators import bundle, metrics, models, splits


class Additive:
    """A model of three classes whose probabilities are sums of known effects."""

    def transform(self, df):
        mod, sev = 0.1 + 0.02 * F.col("a") + 0.01 * F.col("b"), 0.05 + 0.03 * F.col("a")
        return df.withColumn("probability", array_to_vector(F.array(1 - mod - sev, mod, sev)))


def test_contributions_are_the_effects_of_an_additive_model(spark):
    rows = spark.createDataFrame([(1, 3.0, 4.0, 7.0), (2, 1.0, 2.0, 9.0), (3, 1.0, 2.0, 5.0)], "machine_id long, a double, b double, c double")
    train = spark.createDataFrame([(1, float(x), 2.0, 0.0) for x in (0, 1, 5)], "machine_id long, a double, b double, c double")  # medians 1, 2, 0
    names, got = ["a", "b", "c"], {}
    for r in models.contributions(Additive(), rows, models.medians_of(train, names), names).collect():
        got.setdefault((r.machine_id, r.feature), {})[r["class"]] = r.contribution
    assert got[1, "a"] == pytest.approx({0: -0.1, 1: 0.04, 2: 0.06}) and got[1, "b"] == pytest.approx({0: -0.02, 1: 0.02, 2: 0.0})
    assert all(v == pytest.approx(0) for m in (2, 3) for f in "abc" for v in got[m, f].values()) and got[1, "c"] == pytest.approx({0: 0, 1: 0, 2: 0})
    top = models.top_contributions(spark.createDataFrame([(m, c, f, x) for (m, f), by in got.items() for c, x in by.items()], "machine_id long, class int, feature string, contribution double"), 2)
    assert {(r.machine_id, r.place): (r.feature, round(r.share, 6)) for r in top.collect()} == {
        (1, 1): ("a", 0.833333), (1, 2): ("b", 0.166667), (2, 1): ("a", 0.333333), (2, 2): ("b", 0.333333), (3, 1): ("a", 0.333333), (3, 2): ("b", 0.333333)}


def test_occlusion_is_the_mean_size_of_contributions(spark):
    rows = spark.createDataFrame([(1, 3.0, 4.0), (2, -1.0, 2.0)], "machine_id long, a double, b double")
    train = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r.feature: r.attribution for r in models.occlusion(Additive(), rows, train, ["a", "b"]).collect()} == pytest.approx({"a": 0.04, "b": 0.01})


def history(spark, positive):
    """60 buckets of 4 machines; ``positive(bucket, machine)`` is the label, the only feature tells it but for machine 3."""
    rows = [(m, b, positive(b, m), float(positive(b, m)) if m < 3 else 0.5) for m in range(4) for b in range(60)]
    return spark.createDataFrame(rows, "machine_id long, bucket long, y int, x double")


def test_walk_forward_fits_and_skips(spark):
    folds = splits.walk_forward(history(spark, lambda b, m: int(b >= 12 and (b + m) % 3 == 0)), gap=2)
    fits = []

    def fit(train):
        fits.append(train.count())
        return models.fit_binary(train, "y", ["x"], trees=2, depth=2, min_positive=1)

    got = {r.fold: r for r in models.cross_validate(folds, "y", (0, 1), fit).collect()}
    assert len(got) == 5 and len(fits) == 4 and got[1].status == "skipped" and got[1].reason == "no positive training rows" and got[1].macro_pr_auc is None
    for f in (2, 3, 4, 5):
        assert got[f].status == "fitted" and got[f].reason is None and got[f].train_n == 4 * (10 * f - 2) and got[f].val_n == 40
        assert got[f].train_0 + got[f].train_1 == got[f].train_n and got[f].val_spike_rate == pytest.approx(got[f].val_1 / 40)
        assert got[f].macro_pr_auc > 0.7 and 0 < got[f].alarm_threshold < 1
    summary = {r.measure: r for r in metrics.fold_summary(spark.createDataFrame(list(got.values())), models.FOLD_MEASURES).collect()}
    assert summary["macro_pr_auc"].mean == pytest.approx(sum(got[f].macro_pr_auc for f in (2, 3, 4, 5)) / 4)


def test_a_fold_without_a_class_says_which(spark):
    folds = splits.walk_forward(history(spark, lambda b, m: 0 if b % 4 else 2 if b > 30 else 1), gap=2)
    got = {r.fold: r.reason for r in models.fold_plan(folds, "y", (0, 1, 2)).collect()}
    assert got == {1: "no training rows of class 2", 2: "no training rows of class 2", 3: "no training rows of class 2", 4: None, 5: None}


def plain_isotonic(points):
    """Blocks of (lowest score, highest score, mean) of a pool-adjacent-violators fit; equal scores are one point."""
    sums = {}
    for score, y in points:
        n, total = sums.get(score, (0, 0))
        sums[score] = n + 1, total + y
    blocks = []
    for score in sorted(sums):
        n, total = sums[score]
        blocks.append([score, score, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + total, blocks[-1][3] + n]
    return [(low, high, total / n) for low, high, total, n in blocks]


def test_calibrators_are_the_plain_fit_on_all_scores(spark):
    import random
    rng = random.Random(8)
    rows = [(s := rng.choice([rng.random(), rng.randrange(20) / 20, 0.5 + rng.random() * 1e-7]), int(rng.random() < s)) for _ in range(4000)]
    fit = models.fit_calibrators(spark.createDataFrame(rows, "p double, y int").repartition(7), "y", ["q", "p"][1:] * 2)[1]
    scored = {r.p: r["_cal_1"] for r in fit.setFeaturesCol("p").transform(spark.createDataFrame(rows, "p double, y int")).collect()}
    blocks = plain_isotonic(rows)
    assert len(blocks) > 10
    for low, high, mean in blocks:
        assert scored[low] == pytest.approx(mean, abs=1e-9) and scored[high] == pytest.approx(mean, abs=1e-9)


def horizons(spark):
    """Rows of 40 buckets and 6 machines with one telling feature, one of noise, and the labels of every horizon."""
    rows = [(m, b, float((b + m) % 4), float((7 * b + 3 * m) % 5), int((b + m) % 4 == 3), int((b + m) % 4 >= 2), max(0, (b + m) % 4 - 1))
            for m in range(6) for b in range(40)]
    return spark.createDataFrame(rows, "machine_id long, bucket long, x double, noise double, spike_in_15m int, spike_in_30m int, severity_in_60m int")


def test_bundle_comes_back_whole_and_optional_models_may_be_absent(spark, tmp_path):
    rows, names = horizons(spark), ["x", "noise"]
    fits = {"15m": models.fit_binary(rows, "spike_in_15m", names, trees=2, depth=2), bundle.SEVERITY: models.fit_severity(rows, features=names, trees=3, depth=3)}
    raw = models.class_probabilities(fits[bundle.SEVERITY], rows, bundle.CLASSES)
    limits = spark.createDataFrame([(1, 2.0, 3.0)], "machine_id long, threshold_p95 double, threshold_p99 double")
    made = bundle.Bundle(fits, limits, {"15m": 0.4, "60m": 0.3}, models.fit_calibrators(raw, "severity_in_60m", bundle.CLASSES), names)
    root = str(tmp_path / "bundles")
    assert bundle.versions(spark, root) == []
    bundle.save(made, root, "2024-01")
    (tmp_path / "bundles" / "2024-02" / "models").mkdir(parents=True)  # a write that did not end
    got = bundle.load(spark, root, features=names)
    assert got.version == "2024-01" and got.alarms == made.alarms and got.features == names and got.thresholds.collect() == limits.collect()
    assert set(got.models) == set(fits) and len(got.calibrators) == 3
    columns = ["machine_id", "bucket", *bundle.OUTPUTS.values(), *bundle.CLASSES]
    before, after = (sorted(tuple(r) for r in bundle.probabilities(b, rows).select(*columns).collect()) for b in (made, got))
    assert before == after and all(r[3] is None and r[4] is None and r[5] is None and abs(sum(r[6:]) - 1) < 1e-9 for r in after)
    plain = bundle.probabilities(bundle.Bundle({}, limits, {}), rows).select(*columns).first()
    assert all(v is None for v in plain[2:])
    with pytest.raises(ValueError, match="already there"):
        bundle.save(made, root, "2024-01")
    with pytest.raises(ValueError, match="feature list"):
        bundle.load(spark, root, features=["noise", "x"])
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, root, "2024-02", names)
    bundle.save(bundle.Bundle({}, limits, {"15m": 0.9}, features=names), root, "2024-03")
    assert bundle.load(spark, root, features=names).alarms == {"15m": 0.9} and bundle.load(spark, root, "2024-01", names).alarms["15m"] == 0.4


def test_backtest_says_why_a_model_is_skipped(spark):
    rows = horizons(spark).withColumn("spike_in_45m", F.lit(0))
    fit = models.fit_binary(rows, "spike_in_15m", ["x", "noise"], trees=2, depth=2)
    made = bundle.Bundle({"15m": fit, "30m": fit, "45m": fit}, rows, {}, features=["x", "noise"])
    sparse = rows.withColumn("spike_in_30m", F.when(F.col("bucket") < 5, F.col("spike_in_30m")))
    got = {r.model: r for r in bundle.backtest(made, sparse, rows, min_rows=100).collect()}
    assert got["30m"].reason == "fewer than 100 rows to sweep" and got["45m"].reason == "test labels of one class" and got["45m"].n_pos == 0
    fine = got["15m"]
    assert fine.status == "evaluated" and fine.pr_auc == pytest.approx(1) and fine.alarm_f1 == pytest.approx(1) and fine.n_test == 240
    assert fine.pos_rate == pytest.approx(0.25) and fine.alarm_rate == pytest.approx(0.25)


@pytest.mark.parametrize("label, classes", [("spike_in_15m", (0, 1)), ("severity_in_60m", (0, 1, 2))])
def test_halving_keeps_the_better_half_and_refits_the_winner(spark, label, classes):
    rows = horizons(spark)
    grid = [dict(trees=1, depth=1), dict(trees=2, depth=3), dict(trees=2, depth=2)]
    table, winner, model = models.halving(rows, label, grid, ["x", "noise"], classes=classes, min_positive=3)
    rungs = {}
    for r in table.collect():
        rungs.setdefault(r.rung, []).append(r)
    assert [len(rungs[r]) for r in (0, 1, 2)] == [3, 2, 1] and [rungs[r][0].train_n for r in (0, 1, 2)] == [30, 60, 120]
    assert all(r.tune_n == 120 for r in rungs[0]) and grid[rungs[2][0].trial] == winner and rungs[2][0].kept
    for r in (0, 1):
        kept, gone = [t.score for t in rungs[r] if t.kept], [t.score for t in rungs[r] if not t.kept]
        assert {t.trial for t in rungs[r] if t.kept} == {t.trial for t in rungs[r + 1]} and min(kept) >= max(gone)
    assert model.transform(rows).filter(F.col("prediction") == F.col(label)).count() > 200


def test_halving_without_positive_rows_keeps_every_trial_of_a_rung(spark):
    rows = horizons(spark).withColumn("late", F.when((F.col("bucket") < 15) | (F.col("bucket") >= 20), F.col("spike_in_15m")).otherwise(0))
    table, _, _ = models.halving(rows, "late", [dict(trees=1, depth=1), dict(trees=1, depth=2)], ["x", "noise"], shares=(0.2, 1.0), min_positive=3, refit=False)
    first = [r for r in table.collect() if r.rung == 0]
    assert len(first) == 2 and all(r.kept and r.score is None and r.train_pos == 0 for r in first)


def test_rows_that_stop_a_fit_are_not_learnt_and_shorten_it(spark):
    rows = horizons(spark)
    turned = rows.withColumn("spike_in_15m", 1 - F.col("spike_in_15m"))
    whole = models.fit_binary(rows, "spike_in_15m", ["x", "noise"], trees=12, depth=2)
    short = models.fit_stopped(rows, turned, "spike_in_15m", ["x", "noise"], trees=12, depth=2)
    assert short.stages[-1].getNumTrees < whole.stages[-1].getNumTrees == 12
    assert models.positive_probability(short, rows, "p").filter((F.col("p") > 0.5) == (F.col("spike_in_15m") == 1)).count() == 240


def test_recalibration_is_swept_fitted_judged_and_saved(spark, tmp_path):
    rows, names = horizons(spark).withColumn("spike_in_45m", F.lit(0)), ["x", "noise"]
    fit, severity = models.fit_binary(rows, "spike_in_15m", names, trees=2, depth=2), models.fit_severity(rows, features=names, trees=3, depth=3)
    limits = spark.createDataFrame([(1, 2.0, 3.0)], "machine_id long, threshold_p95 double, threshold_p99 double")
    made = bundle.Bundle({"15m": fit, "30m": fit, "45m": fit, bundle.SEVERITY: severity}, limits, {"15m": 0.01, "30m": 0.77, "45m": 0.33, "60m": 0.01}, features=names)
    sparse = rows.withColumn("spike_in_30m", F.when(F.col("bucket") < 5, F.col("spike_in_30m")))
    report, fitted = bundle.recalibrate(made, sparse, rows, min_calibrate=200, replicates=50)
    got = {(r.model, r["class"]): r for r in report.collect()}
    assert set(got) == {("15m", None), ("30m", None), ("45m", None), ("60m", None), ("severity", None), ("severity", 0), ("severity", 1), ("severity", 2)}
    assert got["30m", None].reason == "fewer than 100 rows to sweep" and got["45m", None].reason == "test labels of one class"
    # x tells the label of every class, so a fitted model ranks and calibrates without fault
    for key in (("15m", None), ("60m", None), ("severity", 0), ("severity", 1), ("severity", 2)):
        r = got[key]
        assert r.status == "recalibrated" and r.pr_auc == pytest.approx(1) and r.roc_auc == pytest.approx(1) and r.pr_auc_low == pytest.approx(1) == r.pr_auc_high
    assert got["15m", None].alarm_f1 == pytest.approx(1) == got["severity", None].alarm_f1 and got["severity", None].pr_auc == pytest.approx(1)
    assert got["severity", 1].n_pos == 60 and got["severity", None].n_pos == 120
    assert fitted.alarms["30m"] == 0.77 and fitted.alarms["45m"] == 0.33 and fitted.alarms["15m"] == got["15m", None].alarm_threshold != 0.01
    assert fitted.alarms["60m"] == got["60m", None].alarm_threshold and len(fitted.calibrators) == 3 and not made.calibrators
    sure = bundle.probabilities(fitted, rows).select("severity_in_60m", *bundle.CLASSES).collect()
    assert all(r[1 + r.severity_in_60m] == pytest.approx(1) for r in sure)
    bundle.save(fitted, str(tmp_path / "b"), "fleet-2")
    assert bundle.load(spark, str(tmp_path / "b"), features=names).alarms == fitted.alarms
    report, kept = bundle.recalibrate(made, sparse, rows, replicates=50)  # 240 rows are too few for calibrators
    assert {r.reason for r in report.filter("model = 'severity'").collect()} == {"fewer than 1000 rows to calibrate"}
    assert kept.calibrators == [] and kept.alarms["60m"] == 0.01
    none, same = bundle.recalibrate(bundle.Bundle({}, limits, {"15m": 0.2}), rows, rows)
    assert none.count() == 0 and same.alarms == {"15m": 0.2}


def test_a_fold_reads_its_own_rows_only(spark):
    rows = spark.range(40).selectExpr("id", "cast(id % 4 as int) as fold", "if(id % 8 < 4, 'train', 'test') as role")
    stored = materialise(rows, "folds", by=("fold", "role"))
    assert stored.schema.names == rows.schema.names and sorted(stored.collect()) == sorted(rows.collect())
    part = stored.filter("fold = 1 and role = 'train'")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and sorted(r.id for r in part.collect()) == [1, 9, 17, 25, 33]


def test_models_of_a_bundle_are_fitted_side_by_side():
    met = threading.Barrier(2, timeout=20)  # breaks unless two fits run at a time

    def fit(name):
        met.wait()
        return name.upper()

    assert models.side_by_side({n: partial(fit, n) for n in "abcd"}, at_once=2) == {n: n.upper() for n in "abcd"}
