"""Ranking, threshold and calibration metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import flag
from tidewatch.operators.ordered import collapse, quantiles, running_totals
from tidewatch.operators.resample import replicated_precision

SWEEP = [0.05 + i * 0.05 for i in range(19)]          # fixed operating points
REPORT_SWEEP = [round(0.10 + i * 0.05, 2) for i in range(18)]
CALIBRATION_EDGES = [i * 0.1 for i in range(1, 10)]


def ranking(df: DataFrame, keys: list[str], y: str = "y", score: str = "score",
            weight: Column | None = None) -> DataFrame:
    """Average precision and area under the ROC curve per group; null for a single class.

    Equal scores count as one step.  Groups are few and large, so rows are
    collapsed per distinct score and accumulated band by band.
    """
    w = weight if weight is not None else F.lit(1)
    steps = running_totals(collapse(df, keys, score, pos=F.sum(F.col(y) * w), total=F.sum(w)),
                           keys, score, ["pos", "total"], descending=True)
    pos, total = F.col("pos"), F.col("total")
    tp, seen = F.col("through_pos"), F.col("through_total")
    p, n = F.col("all_pos"), F.col("all_total")
    both = (F.max(p) > 0) & (F.max(n) > F.max(p))
    ap = F.sum(F.when(seen > 0, pos / p * tp / seen).otherwise(0.0))
    auc = F.sum((total - pos) * (tp - pos / 2.0)) / (F.max(p) * (F.max(n) - F.max(p)))
    # weighted groups may have no positive mass at all, so divisions are guarded
    safe = steps.withColumn("all_pos", F.when(p > 0, p))
    return safe.groupBy(*keys).agg(
        F.max(n).alias("n_rows"), F.coalesce(F.max("all_pos"), F.lit(0)).alias("n_pos"),
        F.when(both, ap).alias("pr_auc"), F.when(both, auc).alias("roc_auc"))


def ranking_of_labels(df: DataFrame, keys: list[str], labels: dict[str, Column], score: str = "score") -> DataFrame:
    """``ranking`` of one score against several 0/1 labels (null: not labelled), one row per group and label.

    The labels' sums are columns of the collapsed scores, so rows are not multiplied by the labels.
    """
    ys = df.select(*keys, score, *[y.cast("int").alias(f"_y{i}") for i, y in enumerate(labels.values())])
    measures = {f"pos{i}": F.coalesce(F.sum(f"_y{i}"), F.lit(0)) for i in range(len(labels))} | {f"total{i}": F.count(f"_y{i}") for i in range(len(labels))}
    steps = running_totals(collapse(ys, keys, score, **measures), keys, score, list(measures), descending=True)
    found = []
    for i, label in enumerate(labels):
        pos, total, tp, seen, p, n = (F.col(f"{a}{b}{i}") for a in ("", "through_", "all_") for b in ("pos", "total"))
        p, n = F.max(p), F.max(n)
        share = F.sum(F.when((seen > 0) & (F.col(f"all_pos{i}") > 0), pos / F.nullif(F.col(f"all_pos{i}"), F.lit(0)) * tp / seen).otherwise(0.0))
        area = F.sum((total - pos) * (tp - pos / 2.0)) / F.nullif(p * (n - p), F.lit(0))
        both = (p > 0) & (n > p)
        found.append(F.struct(F.lit(label).alias("label"), n.alias("n_rows"), p.alias("n_pos"),
                              F.when(both, share).alias("pr_auc"), F.when(both, area).alias("roc_auc")))
    wide = steps.groupBy(*keys).agg(F.array(*found).alias("_all"))
    return wide.select(*keys, F.inline("_all")).filter(F.col("n_rows") > 0)


def one_vs_rest(df: DataFrame, keys: list[str], label: str, scores: list[str]) -> DataFrame:
    """Ranking metrics of each class against the others; ``scores`` has one column per class."""
    parts = [F.struct(F.lit(k).alias("class"), (F.col(label) == k).cast("int").alias("y"), F.col(s).alias("score"))
             for k, s in enumerate(scores)]
    long = df.select(*keys, F.explode(F.array(*parts)).alias("c")).select(*keys, "c.*")
    return ranking(long, [*keys, "class"])


def macro(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """Plain mean over the classes that occur."""
    return per_class.groupBy(*keys).agg(F.avg("pr_auc").alias("macro_pr_auc"), F.avg("roc_auc").alias("macro_roc_auc"))


def confusion(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, keys: list[str], y: str, pred: str, classes=(0, 1, 2)) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    table = confusion(df, keys, y, pred)
    sums = table.groupBy(*keys).agg(*[
        agg for k in classes for agg in (
            F.sum(F.when((F.col(y) == k) & (F.col(pred) == k), F.col("n")).otherwise(0)).alias(f"tp{k}"),
            F.sum(F.when(F.col(pred) == k, F.col("n")).otherwise(0)).alias(f"pp{k}"),
            F.sum(F.when(F.col(y) == k, F.col("n")).otherwise(0)).alias(f"ap{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"pp{k}").alias("pp"),
                              F.col(f"ap{k}").alias("support")) for k in classes])
    return with_rates(sums.select(*keys, F.inline(rows)), "tp", "pp", "support")


def with_rates(df: DataFrame, tp: str, alarms: str, positives: str) -> DataFrame:
    t, a, p = F.col(tp), F.col(alarms), F.col(positives)
    return df.withColumns({
        "precision": F.when(a > 0, t / a).otherwise(0.0),
        "recall": F.when(p > 0, t / p).otherwise(0.0),
        "f1": F.when(a + p > 0, 2.0 * t / (a + p)).otherwise(0.0)})


def f1_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Macro and support-weighted F1 over classes that occur or are predicted."""
    used = report.filter((F.col("support") > 0) | (F.col("pp") > 0))
    return used.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"),
                                   (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def sweep(df: DataFrame, keys: list[str], y: str = "y", score: str = "score",
          thresholds: list[float] | None = None, slots: int = S.SLOTS_PER_DAY) -> DataFrame:
    """Alarm quality at each threshold.  Scores are binned once; thresholds fan out over bins only."""
    cuts = thresholds or SWEEP
    passed = sum((flag(F.col(score) >= F.lit(t)) for t in cuts), F.lit(0.0))
    bins = df.groupBy(*keys, passed.alias("_passed")).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    points = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])
    fanned = bins.select(*keys, "_passed", "_pos", "_n", F.inline(points))
    on = F.col("_passed") >= F.col("step")
    table = fanned.groupBy(*keys, "threshold").agg(
        F.sum(F.when(on, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("_n")).otherwise(0)).alias("alarms"),
        F.sum("_pos").alias("positives"), F.sum("_n").alias("n_rows"))
    return with_rates(table, "tp", "alarms", "positives").withColumn(
        "alarms_per_day", F.col("alarms") / F.greatest("n_rows", F.lit(1)) * slots)


def best_threshold(swept: DataFrame, keys: list[str], min_precision: float = 0.0) -> DataFrame:
    """Smallest threshold with the best F1 (0.5 if none is positive).

    With ``min_precision``: the first one with the highest recall among those
    that meet it, else the F1 choice.
    """
    t = F.col("threshold")
    by_f1 = F.max_by("threshold", F.when(F.col("f1") > 0, F.struct(F.col("f1"), -t)))
    picked = F.coalesce(by_f1, F.lit(0.5))
    if min_precision > 0:
        meets = F.when(F.col("precision") >= min_precision, F.struct(F.col("recall"), -t))
        picked = F.coalesce(F.max_by("threshold", meets), picked)
    return swept.groupBy(*keys).agg(picked.alias("threshold"))


def calibration(df: DataFrame, keys: list[str], y: str, raw: str, cal: str) -> DataFrame:
    """Brier score before and after calibration and the expected calibration error after."""
    place = sum((flag(F.col(cal) >= F.lit(e)) for e in CALIBRATION_EDGES), F.lit(0.0))
    bins = df.groupBy(*keys, place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"), F.sum(cal).alias("_p"),
        F.sum(F.pow(F.col(y) - F.col(raw), 2)).alias("_br"), F.sum(F.pow(F.col(y) - F.col(cal), 2)).alias("_bc"))
    n = F.sum("_n")
    return bins.groupBy(*keys).agg((F.sum("_br") / n).alias("brier_raw"), (F.sum("_bc") / n).alias("brier_cal"),
                                   (F.sum(F.abs(F.col("_y") - F.col("_p"))) / n).alias("ece_cal"))


def renormalise(df: DataFrame, probs: list[str]) -> DataFrame:
    """Clip calibrated class scores to [0, 1] and make them sum to one; all-zero rows become uniform."""
    clipped = {p: F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) for p in probs}
    total = sum(clipped.values(), F.lit(0.0))
    return df.withColumns({p: F.when(total > 0, c / total).otherwise(F.lit(1.0 / len(probs))) for p, c in clipped.items()})


def bootstrap_interval(df: DataFrame, keys: list[str], id_columns: list[str], y: str = "y", score: str = "score",
                       replicates: int = 1000, seed: int = 42, coverage: float = 0.95) -> DataFrame:
    """Percentile interval of average precision over the replicates of ``resample.replicated_precision`` that have both classes."""
    each = replicated_precision(df, keys, id_columns, y, score, replicates, seed).filter(F.col("pr_auc").isNotNull())
    tail = (1.0 - coverage) / 2.0
    return quantiles(each, keys, "pr_auc", {"low": tail, "high": 1.0 - tail})


def fold_summary(folds: DataFrame, measures: list[str]) -> DataFrame:
    """Mean and population deviation of each measure over folds, missing values skipped."""
    long = folds.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "measure", "value")
    clean = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return clean.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def kendall_trend(folds: DataFrame, order: str = "fold", value: str = "value") -> DataFrame:
    """Kendall's tau-b of a score over the fold number.  One value per fold, a handful in all."""
    series = folds.filter(F.col(value).isNotNull()).agg(
        F.array_sort(F.collect_list(F.struct(order, value))).alias("s")).select(
        F.transform("s", lambda r: r[value].cast("double")).alias("v"))
    pair_signs = F.flatten(F.transform("v", lambda a, i: F.transform(
        F.slice(F.col("v"), i + 2, F.greatest(F.size("v") - i - 1, F.lit(0))), lambda b: F.signum(b - a))))
    total = F.aggregate("signs", F.lit(0.0), lambda acc, x: acc + x)
    ties = F.size(F.filter("signs", lambda x: x == 0))
    n = F.size("signs").cast("double")
    tau = F.when(F.col("n0") > F.col("ties"), F.col("total") / F.sqrt(F.col("n0") * (F.col("n0") - F.col("ties"))))
    return (series.filter(F.size("v") >= 3).withColumn("signs", pair_signs)
            .select(total.alias("total"), n.alias("n0"), ties.alias("ties"))
            .select(tau.alias("tau"))
            .withColumn("direction", F.when(F.col("tau") < -0.3, "declining").when(F.col("tau") > 0.3, "improving")
                        .otherwise("stable")))


def random_level(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """What a random score achieves: the mean of the class rates."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return per.withColumn("_rate", F.col("_n") / total).groupBy(*keys).agg(F.avg("_rate").alias("random_pr_auc"))


def class_rates(df: DataFrame, keys: list[str], label: str, classes=(0, 1, 2)) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(flag(F.col(label) == k)).alias(f"rate_{k}") for k in classes],
                                 F.avg(flag(F.col(label) > 0)).alias("positive_rate"))


def fold_class_counts(df: DataFrame, keys: list[str], label: str, classes=(0, 1, 2)) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(label) == k).alias(f"n_{k}") for k in classes])
