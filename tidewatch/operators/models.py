"""Training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import metrics
from tidewatch.operators.ordered import ordered_rows, quantiles

MIN_POSITIVE = 10


# --- data sets and guards -------------------------------------------------------------

def cascade_rows(df: DataFrame, label: str = "severity_in_60m") -> DataFrame:
    """Second-stage rows: spikes only, severe or not."""
    return df.filter(F.col(label) > 0).withColumn("severe", (F.col(label) == 2).cast("int"))


def guard(train: DataFrame, label: str, classes: tuple[int, ...], min_positive: int = MIN_POSITIVE) -> dict[int, int]:
    """Class counts; raises if a class is absent or positives are too few."""
    row = metrics.fold_class_counts(train, [], label, classes).first()
    counts = {k: row[f"n_{k}"] for k in classes}
    if sum(n for k, n in counts.items() if k > 0) < min_positive:
        raise ValueError(f"fewer than {min_positive} positive rows: {counts}")
    if any(n == 0 for n in counts.values()):
        raise ValueError(f"a class has no rows: {counts}")
    return counts


def balanced(df: DataFrame, label: str, counts: dict[int, int]) -> DataFrame:
    """Weight n/(classes*n_k) per row; for two classes the positive one gets n_neg/n_pos."""
    if set(counts) == {0, 1}:
        w = F.when(F.col(label) == 1, counts[0] / counts[1]).otherwise(1.0)
    else:
        n, w = sum(counts.values()), F.lit(1.0)
        for k, c in counts.items():
            w = F.when(F.col(label) == k, n / (len(counts) * c)).otherwise(w)
    return df.withColumn("_weight", w)


# --- fitting -----------------------------------------------------------------------------

def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error")


def fit_binary(train: DataFrame, label: str, features: list[str] | None = None, *, trees: int = 20, depth: int = 4,
               step: float = 0.2, seed: int = 42, validation: str | None = None, min_positive: int = MIN_POSITIVE) -> PipelineModel:
    """Boosted trees with weighted positives; ``validation`` names a boolean column that marks rows which only stop the fit early."""
    counts = guard(train.filter(~F.col(validation)) if validation else train, label, (0, 1), min_positive)
    tree = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth,
                         stepSize=step, seed=seed, subsamplingRate=0.8,
                         **({"validationIndicatorCol": validation} if validation else {}))
    return Pipeline(stages=[_assembler(features or S.MODEL_FEATURES), tree]).fit(balanced(train, label, counts))


def fit_stopped(train: DataFrame, val: DataFrame, label: str, features: list[str] | None = None, **options) -> PipelineModel:
    """``fit_binary`` on ``train`` with at most ``trees`` trees: no more once ``val`` gains nothing by them."""
    names = [*(features or S.MODEL_FEATURES), label]
    marked = lambda df, stops: df.select(*names, F.lit(stops).alias("_stops"))
    return fit_binary(marked(train, False).unionByName(marked(val, True)), label, features, validation="_stops", **options)


def fit_severity(train: DataFrame, label: str = "severity_in_60m", features: list[str] | None = None, *,
                 trees: int = 40, depth: int = 8, seed: int = 42, min_positive: int = MIN_POSITIVE) -> PipelineModel:
    """Three-class forest with balanced class weights."""
    counts = guard(train, label, (0, 1, 2), min_positive)
    forest = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", numTrees=trees,
                                    maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembler(features or S.MODEL_FEATURES), forest]).fit(balanced(train, label, counts))


def positive_probability(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(output, vector_to_array("probability")[1]).drop(
        "_x", "rawPrediction", "probability", "prediction")


def class_probabilities(model: PipelineModel, df: DataFrame, outputs: list[str]) -> DataFrame:
    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return scored.withColumns({o: F.col("_p")[i] for i, o in enumerate(outputs)}).drop(
        "_x", "_p", "rawPrediction", "probability", "prediction")


def side_by_side(fits: dict[str, Callable[[], PipelineModel]], at_once: int = 3) -> dict[str, PipelineModel]:
    """The models by name, ``at_once`` of them fitted at a time: the short stages of one use the cores that another leaves."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(fits, pool.map(lambda fit: fit(), fits.values())))


def search(train: DataFrame, label: str, grid: list[dict], features: list[str] | None = None) -> DataFrame:
    """Average precision of each parameter set on the later half of the training time: one rung of ``halving``."""
    table, _, _ = halving(train, label, grid, features, shares=(1.0,), refit=False)
    at = {i: F.lit(i) == F.col("trial") for i in range(len(grid))}
    named = {k: F.coalesce(*[F.when(at[i], F.lit(p.get(k))) for i, p in enumerate(grid)]) for k in dict.fromkeys(k for p in grid for k in p)}
    return table.select("trial", *[c.alias(k) for k, c in named.items()], F.col("score").alias("pr_auc"))


RUNG = "rung int, share double, trial int, train_n long, train_pos long, tune_n long, tune_pos long, score double, kept boolean"


def halving(train: DataFrame, label: str, grid: list[dict], features: list[str] | None = None, *, classes: tuple[int, ...] = (0, 1),
            shares: tuple[float, ...] = (0.25, 0.5, 1.0), refit: bool = True, side_by_side: int = 3, min_positive: int = MIN_POSITIVE,
            ) -> tuple[DataFrame, dict, PipelineModel | None]:
    """Successive halving over time: the rungs (``RUNG``), the best parameter set, and that set fitted on all of ``train``.

    The earlier half of the training time fits, the later half judges.  A rung fits the trials left on the newest ``share`` of the
    fitting time and keeps the better half (ties: the earlier trial), so most trials cost a part of a whole fit; the last rung keeps one.
    Trials of a rung run side by side.  Two classes are judged by average precision, more by its mean over the classes.  A trial
    without a score (judged rows of one class) comes last; a rung whose rows cannot be fitted has null scores and keeps every trial.
    """
    from tidewatch.operators.splits import inner_tuning
    from tidewatch.session import materialise
    spark, binary = train.sparkSession, classes == (0, 1)
    names = [f"p_{k}" for k in classes]
    parts = materialise(inner_tuning(train).select("bucket", label, *(features or S.MODEL_FEATURES), "inner_split"), "search")
    fit, tune = parts.filter("inner_split = 'fit'"), parts.filter("inner_split = 'tune'")
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("pos"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi"),
                                *[F.count_if(F.col(label) == k).alias(f"n_{k}") for k in classes]).first()
    extent, judged = counted(fit), counted(tune)

    def fitted(rows: DataFrame, params: dict) -> PipelineModel:
        made = fit_binary if binary else fit_severity
        return made(rows, label, features, min_positive=min_positive, **params)

    def score(rows: DataFrame, params: dict) -> float | None:
        model = fitted(rows, params)
        if binary:
            held = positive_probability(model, tune, "score").select(F.col(label).cast("int").alias("y"), "score")
            return metrics.ranking(held, []).first().pr_auc
        return metrics.macro(metrics.one_vs_rest(class_probabilities(model, tune, names), [], label, names), []).first().macro_pr_auc

    left, table = list(range(len(grid))), []
    for rung, share in enumerate(shares if extent.n and judged.n else ()):
        rows = fit.filter(F.col("bucket") > extent.hi - int((extent.hi - extent.lo + 1) * share))
        size = counted(rows)
        ready = size.pos >= min_positive and all(size[f"n_{k}"] for k in classes)
        with ThreadPoolExecutor(side_by_side) as pool:
            found = list(pool.map(lambda i: score(rows, grid[i]) if ready else None, left))
        order = sorted(zip(left, found), key=lambda p: (p[1] is None, -(p[1] or 0.0), p[0]))
        keep = 1 if rung == len(shares) - 1 else len(left) if not ready else (len(left) + 1) // 2
        best = {i for i, _ in order[:keep]}
        table += [(rung, share, i, size.n, size.pos, judged.n, judged.pos, s, i in best) for i, s in zip(left, found)]
        left = [i for i in left if i in best]
    winner = grid[left[0]]
    return spark.createDataFrame(table, RUNG), winner, fitted(train, winner) if refit else None


# --- walk-forward validation --------------------------------------------------------------------

def fold_plan(folds: DataFrame, label: str, classes: tuple[int, ...]) -> DataFrame:
    """One row per fold of ``splits.walk_forward``: rows and rows of each class in either role, and why it cannot be fitted (``reason``).

    A fold is skipped if its training rows hold no positive one or lack a class, or if it has no row to validate on.
    """
    of = lambda role, cond=F.lit(True): F.count_if((F.col("role") == role) & cond)
    counts = folds.groupBy("fold").agg(
        of("train").alias("train_n"), of("test").alias("val_n"),
        *[of("train", F.col(label) == k).alias(f"train_{k}") for k in classes], *[of("test", F.col(label) == k).alias(f"val_{k}") for k in classes])
    positives = sum((F.col(f"train_{k}") for k in classes if k), F.lit(0))
    missing = F.filter(F.array(*[F.when(F.col(f"train_{k}") == 0, str(k)) for k in classes]), lambda c: c.isNotNull())
    reason = (F.when(positives == 0, "no positive training rows").when(F.size(missing) > 0, F.concat(F.lit("no training rows of class "), F.array_join(missing, ", ")))
              .when(F.col("val_n") == 0, "no validation rows"))
    rate = lambda role: F.try_divide(sum((F.col(f"{role}_{k}") for k in classes if k), F.lit(0)), F.col(f"{role}_n"))
    return counts.withColumns({"train_spike_rate": rate("train"), "val_spike_rate": rate("val"), "reason": reason})


def fold_scores(model: Transformer, val: DataFrame, label: str, classes: tuple[int, ...]) -> dict[str, float | None]:
    """Quality of one fold's model on its validation rows, at the alarm threshold chosen there.

    With three classes a row whose largest probability is no spike's still counts as severe if that class reaches the threshold; a fold
    without severe rows takes 0.5.
    """
    from tidewatch.session import materialise
    names = [f"p_{k}" for k in classes]
    rows = materialise(class_probabilities(model, val, names).select(label, *names), "fold")
    top = len(classes) - 1
    alarm = rows.select((F.col(label) == top).cast("int").alias("y"), F.col(names[top]).alias("score"))
    known = rows.filter(F.col(label) == top).limit(1).count() > 0
    threshold = metrics.best_threshold(metrics.sweep(alarm, []), []).first()["threshold"] if known else 0.5
    largest = F.array_position(F.array(*names), F.greatest(*names)).cast("int") - 1
    guess = F.when(F.col(names[top]) >= threshold, top).otherwise(largest if top > 1 else 0)
    report = metrics.class_report(rows.withColumn("_guess", guess), [], label, "_guess", classes)
    f1 = metrics.f1_summary(report, []).first()
    quality = metrics.macro(metrics.one_vs_rest(rows, [], label, names), []).first() if top > 1 else metrics.ranking(alarm, []).first()
    first = ("macro_pr_auc", "macro_roc_auc") if top > 1 else ("pr_auc", "roc_auc")
    return {"alarm_threshold": threshold, "macro_pr_auc": quality[first[0]], "macro_roc_auc": quality[first[1]], "macro_f1": f1["macro_f1"], "weighted_f1": f1["weighted_f1"]}


FOLD_MEASURES = ["macro_pr_auc", "macro_roc_auc", "macro_f1", "weighted_f1"]


def cross_validate(folds: DataFrame, label: str, classes: tuple[int, ...], fit: Callable[[DataFrame], Transformer], side_by_side: int = 3) -> DataFrame:
    """One row per fold: the plan's counts, ``status`` fitted or skipped with its reason, and ``FOLD_MEASURES`` at ``alarm_threshold``.

    ``folds`` (rows of ``splits.walk_forward``, labelled) should be a table stored by fold and role: a fold reads its rows several times. The counts of all folds
    come from one aggregation; only folds that can be fitted are, ``side_by_side`` of them at a time.
    """
    spark = folds.sparkSession
    plan = [r.asDict() for r in fold_plan(folds, label, classes).orderBy("fold").collect()]  # one row a fold

    def one(row: dict) -> dict:
        if row["reason"]:
            return row | {"status": "skipped"}
        part = lambda role: folds.filter((F.col("fold") == row["fold"]) & (F.col("role") == role)).drop("fold", "role")
        return row | {"status": "fitted"} | fold_scores(fit(part("train")), part("test"), label, classes)

    with ThreadPoolExecutor(side_by_side) as pool:
        done = list(pool.map(one, plan))
    names = [*(f"{role}_{k}" for role in ("train", "val") for k in classes)]
    schema = ("fold int, status string, reason string, train_n long, val_n long, " + "".join(f"{n} long, " for n in names)
              + "train_spike_rate double, val_spike_rate double, alarm_threshold double, " + ", ".join(f"{m} double" for m in FOLD_MEASURES))
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in done], schema)


# --- importance --------------------------------------------------------------------------

def gain_importance(model: PipelineModel, features: list[str] | None = None) -> DataFrame:
    """One row per feature with the trees' own importance."""
    from pyspark.sql import SparkSession
    names = features or S.MODEL_FEATURES
    weights = model.stages[-1].featureImportances.toArray()
    pairs = [F.struct(F.lit(n).alias("feature"), F.lit(float(w)).alias("gain")) for n, w in zip(names, weights)]
    return SparkSession.active().range(1).select(F.inline(F.array(*pairs)))


def normalised_gain(gain: DataFrame) -> DataFrame:
    total = gain.agg(F.sum("gain").alias("t")).scalar()
    return gain.select("feature", F.when(total > 0, F.col("gain") / total).otherwise(0.0).alias("gain_share"))


def medians_of(train: DataFrame, names: list[str]) -> Column:
    """Map of each feature's median over the training rows, as a scalar subquery."""
    medians = quantiles(train.select(*[F.col(f).cast("double").alias(f) for f in names])
                        .unpivot([], names, "feature", "value"), ["feature"], "value", {"m": 0.5}, few_groups=True)
    return medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("m")).scalar()


def occluded(model: Transformer, rows: DataFrame, medians: Column, names: list[str]) -> DataFrame:
    """Rows once per feature, with class probabilities ``_before`` and, that feature at its median, ``_after``.

    Rows fan out to one variant per feature (a fixed number) inside their partition, so the model scores them all in one
    pass and nothing is shuffled.
    """
    work = ("_x", "rawPrediction", "probability", "prediction")
    base = model.transform(rows).withColumn("_before", vector_to_array("probability")).drop(*work)
    variants = (base.withColumn("_m", medians)
                .withColumn("_off", F.explode(F.array(*[F.lit(f) for f in names])))
                .withColumns({f: F.when(F.col("_off") == f, F.col("_m")[f]).otherwise(F.col(f).cast("double"))
                              for f in names}))
    return model.transform(variants).withColumn("_after", vector_to_array("probability")).drop("_m", *work)


def occlusion(model: Transformer, rows: DataFrame, train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Mean change of the probability when one feature is set to its training median."""
    names = features or S.MODEL_FEATURES
    change = F.abs(F.col("_after")[1] - F.col("_before")[1])
    return (occluded(model, rows, medians_of(train, names), names)
            .groupBy(F.col("_off").alias("feature")).agg(F.avg(change).alias("attribution")))


def contributions(model: Transformer, rows: DataFrame, medians: Column, features: list[str] | None = None, keys: tuple[str, ...] = ("machine_id",)) -> DataFrame:
    """``keys, class, feature, contribution``: what a feature's value adds to each class probability of a row, against its training median."""
    names = features or S.MODEL_FEATURES
    change = F.transform(F.arrays_zip("_before", "_after"), lambda p: p["_before"] - p["_after"])
    return (occluded(model, rows, medians, names).select(*keys, F.col("_off").alias("feature"), F.posexplode(change).alias("class", "contribution"))
            .select(*keys, "class", "feature", "contribution"))


def top_contributions(contributions: DataFrame, k: int = 3) -> DataFrame:
    """Largest features per machine by the sum of absolute class contributions, as shares."""
    per = contributions.groupBy("machine_id", "feature").agg(F.sum(F.abs("contribution")).alias("_c"))
    whole = Window.partitionBy("machine_id")
    share = F.when(F.sum("_c").over(whole) > 0, F.col("_c") / F.sum("_c").over(whole)) \
        .otherwise(1.0 / F.count(F.lit(1)).over(whole))
    place = F.row_number().over(Window.partitionBy("machine_id").orderBy(F.round("share", 9).desc(), "feature"))
    return (per.withColumn("share", share).withColumn("place", place)
            .filter(F.col("place") <= k).select("machine_id", "place", "feature", "share"))


# --- calibration -------------------------------------------------------------------------

def fit_calibrators(val: DataFrame, label: str, probs: list[str], grid: int | None = None) -> list[IsotonicRegressionModel]:
    """One isotonic fit per class against the rest, the classes side by side.

    Equal scores are summed first, which leaves the fit as it is; adjacent violators are pooled within ranges of scores by tasks and
    the pooled blocks of all ranges then merged, so the driver gets blocks, not rows. ``grid`` pools scores between 0 and 1 in
    so many bands of equal width beforehand: a coarser fit for where even the blocks are too many.
    """
    def one(k: int, p: str) -> IsotonicRegressionModel:
        y = (F.col(label) == k).cast("double")
        at = F.col(p) if grid is None else F.floor(F.col(p) * grid)
        points = (ordered_rows(val, [], p).groupBy(at.alias("_at"))
                  .agg(F.avg(p).alias("s"), F.avg(y).alias("y"), F.count(F.lit(1)).cast("double").alias("w")).drop("_at"))
        if grid is None:  # the mean of equal numbers may differ from them in the last digit
            points = ordered_rows(val, [], p).groupBy(F.col(p).cast("double").alias("s")).agg(F.avg(y).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        return IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w", predictionCol=f"_cal_{k}").fit(points)

    with ThreadPoolExecutor(len(probs)) as pool:
        return list(pool.map(one, range(len(probs)), probs))


def apply_calibrators(fits: list[IsotonicRegressionModel], df: DataFrame, probs: list[str]) -> DataFrame:
    """Calibrated, clipped and renormalised class probabilities (``cal_<i>``)."""
    out = df
    for k, (fit, p) in enumerate(zip(fits, probs)):
        out = fit.setFeaturesCol(p).transform(out)
    names = [f"_cal_{k}" for k in range(len(probs))]
    return metrics.renormalise(out, names).withColumnsRenamed({n: n[1:] for n in names})


# --- registry ------------------------------------------------------------------------------

def save(model: PipelineModel, path: str, features: list[str] | None = None) -> str:
    """Model plus its ordered feature list."""
    from pyspark.sql import SparkSession
    model.write().overwrite().save(f"{path}/model")
    names = features or S.MODEL_FEATURES
    rows = SparkSession.active().range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "feature"))
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/features")
    return path


def load(spark, path: str, features: list[str] | None = None) -> PipelineModel:
    """Load a model; its stored feature list must be the expected one, in order."""
    rows = spark.read.schema("position int, feature string").json(f"{path}/features")
    stored = rows.agg(F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("all")).select("all.feature").first().feature
    if stored != list(features or S.MODEL_FEATURES):
        raise ValueError("stored feature list differs from the expected one")
    return PipelineModel.load(f"{path}/model")
