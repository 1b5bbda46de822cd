"""A versioned folder of everything that scoring needs, read as a whole.

``<root>/<version>/`` holds models, calibrators, machine thresholds and the feature list.  The manifest is written last, so a
version is either complete or not there; readers take the newest complete one unless told which.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import metrics, models
from tidewatch.session import materialise
from tidewatch.sources.sinks import is_complete

SEVERITY, CASCADE = "severity", "cascade"
CLASSES = ["p_no", "p_mod", "p_sev"]
OUTPUTS = {"15m": "p15", "30m": "p30", "45m": "p45", CASCADE: "p_ovr"}
LABELS = {"15m": "spike_in_15m", "30m": "spike_in_30m", "45m": "spike_in_45m", SEVERITY: "severity_in_60m", CASCADE: "severe"}
_MANIFEST = "kind string, name string, position int, value double"


@dataclass
class Bundle:
    """Models by name (``OUTPUTS`` and ``SEVERITY``), any of which may be absent; calibrators are those of the severity model."""
    models: dict[str, PipelineModel]
    thresholds: DataFrame
    alarms: dict[str, float]
    calibrators: list[IsotonicRegressionModel] = field(default_factory=list)
    features: list[str] = field(default_factory=lambda: list(S.MODEL_FEATURES))
    version: str | None = None


def save(bundle: Bundle, root: str, version: str) -> str:
    """Write a version, which must be new; versions are ordered as texts."""
    spark = bundle.thresholds.sparkSession
    path = f"{root.rstrip('/')}/{version}"
    if is_complete(spark, f"{path}/manifest"):
        raise ValueError(f"version {version} is already there")
    unknown = set(bundle.models) - set(LABELS)
    if unknown:
        raise ValueError(f"no such models: {sorted(unknown)}")
    for name, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    for k, fit in enumerate(bundle.calibrators):
        fit.write().overwrite().save(f"{path}/calibrators/{k}")
    bundle.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    entries = ([("model", n, 0, None) for n in bundle.models] + [("calibrator", SEVERITY, k, None) for k in range(len(bundle.calibrators))]
               + [("alarm", n, 0, float(v)) for n, v in bundle.alarms.items()] + [("feature", n, i, None) for i, n in enumerate(bundle.features)])
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, oldest first; folders of unfinished writes are not listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()]
    return sorted(n for n in names if is_complete(spark, f"{root.rstrip('/')}/{n}/manifest"))


def load(spark: SparkSession, root: str, version: str | None = None, features: list[str] | None = None) -> Bundle:
    """The given or newest complete version; its features must be the expected ones, in order."""
    known = versions(spark, root)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no complete version {version or ''} in {root}")
    version = version or known[-1]
    path = f"{root.rstrip('/')}/{version}"
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy("kind", "position", "name").collect()  # a line per part
    names = lambda kind: [r.name for r in rows if r.kind == kind]
    stored = names("feature")
    if stored != list(features or S.MODEL_FEATURES):
        raise ValueError("stored feature list differs from the expected one")
    return Bundle(models={n: PipelineModel.load(f"{path}/models/{n}") for n in names("model")},
                  thresholds=spark.read.parquet(f"{path}/thresholds"), alarms={r.name: r.value for r in rows if r.kind == "alarm"},
                  calibrators=[IsotonicRegressionModel.load(f"{path}/calibrators/{k}") for k in range(len(names("calibrator")))],
                  features=stored, version=version)


def probabilities(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """Rows with the columns of ``OUTPUTS`` and ``CLASSES``: null where the bundle has no such model, classes calibrated if it can."""
    out = rows
    for name, column in OUTPUTS.items():
        if name in bundle.models:
            out = models.positive_probability(bundle.models[name], out, column)
        else:
            out = out.withColumn(column, F.lit(None).cast("double"))
    if SEVERITY not in bundle.models:
        return out.withColumns({c: F.lit(None).cast("double") for c in CLASSES})
    out = models.class_probabilities(bundle.models[SEVERITY], out, CLASSES)
    if not bundle.calibrators:
        return out
    calibrated = models.apply_calibrators(bundle.calibrators, out, CLASSES)
    return calibrated.drop(*CLASSES).withColumnsRenamed({f"cal_{k}": c for k, c in enumerate(CLASSES)})


# --- another fleet ----------------------------------------------------------------------------------

REPORT = ("model string, status string, reason string, n_val long, n_test long, n_pos long, pos_rate double, pr_auc double, roc_auc double, "
          "alarm_threshold double, alarm_precision double, alarm_recall double, alarm_f1 double, alarm_rate double")


def backtest(bundle: Bundle, val: DataFrame, test: DataFrame, min_rows: int = 100) -> DataFrame:
    """``REPORT``: one row per model of the bundle on rows of another fleet, which carry its labels as columns.

    The alarm threshold is swept on ``val`` and used on ``test``; ranking quality is of ``test``, for the severity model the mean over
    the classes that can be ranked, for its alarm any spike.  A model is skipped, with the reason, if it has fewer than ``min_rows``
    labelled rows to sweep (severity: none is needed), no labelled test row, or test labels of one class.
    """
    spark = val.sparkSession
    parts = {}
    for role, rows in (("val", val), ("test", test)):
        keep = [*CLASSES, *OUTPUTS.values(), *LABELS.values()]
        parts[role] = materialise(probabilities(bundle, _with_severe(rows)).select(*keep), f"backtest-{role}")
    with ThreadPoolExecutor(3) as pool:
        rows = list(pool.map(lambda name: _report(name, parts["val"], parts["test"], min_rows), [n for n in LABELS if n in bundle.models]))
    return spark.createDataFrame(rows, REPORT)


def _with_severe(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severe", F.when(F.col(LABELS[SEVERITY]) > 0, (F.col(LABELS[SEVERITY]) == 2).cast("int")))


def _report(name: str, val: DataFrame, test: DataFrame, min_rows: int) -> tuple:
    label, classes = LABELS[name], 3 if name == SEVERITY else 2
    score = 1 - F.col(CLASSES[0]) if name == SEVERITY else F.col(OUTPUTS[name])
    alarm = lambda df: df.filter(F.col(label).isNotNull()).select((F.col(label) > 0).cast("int").alias("y"), score.alias("score"))
    swept, held = alarm(val), alarm(test)
    n_val = swept.count()
    counts = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("p")).first()
    row = {"model": name, "n_val": n_val, "n_test": counts.n, "n_pos": counts.p, "pos_rate": counts.p / counts.n if counts.n else None}
    reason = (f"fewer than {min_rows} rows to sweep" if classes == 2 and n_val < min_rows else "no test rows" if not counts.n
              else "test labels of one class" if classes == 2 and counts.p in (0, counts.n) else None)
    if reason is None:
        table = materialise(metrics.sweep(swept, []), "swept")
        chosen = metrics.best_threshold(table, []).first()
        at = chosen.threshold if chosen else 0.5
        on = table.filter(F.abs(F.col("threshold") - at) < 1e-9).first()
        if classes == 2:
            quality = metrics.ranking(held, []).first()
            row |= {"pr_auc": quality.pr_auc, "roc_auc": quality.roc_auc}
        else:
            each = metrics.one_vs_rest(test.filter(F.col(label).isNotNull()), [], label, CLASSES)
            quality = metrics.macro(each, []).first()
            row |= {"pr_auc": quality.macro_pr_auc, "roc_auc": quality.macro_roc_auc}
        row |= {"alarm_threshold": at, "alarm_rate": held.agg(F.avg((F.col("score") >= at).cast("double")).alias("r")).first().r}
        row |= {f"alarm_{m}": on[m] for m in ("precision", "recall", "f1")} if on else {}
    row |= {"status": "skipped" if reason else "evaluated", "reason": reason}
    return tuple(row.get(c.split()[0]) for c in REPORT.split(", "))


# --- fitted to another fleet ------------------------------------------------------------------------

#: A row per model and, for the severity model, per class; ``ANY`` is any spike by the severity model.
ANY = "60m"
RECALIBRATION = ("model string, class int, status string, reason string, n_val long, n_test long, n_pos long, pr_auc double, pr_auc_low double, "
                 "pr_auc_high double, roc_auc double, alarm_threshold double, alarm_precision double, alarm_recall double, alarm_f1 double")
_NO_CLASS = -1


def recalibrate(bundle: Bundle, val: DataFrame, test: DataFrame, *, min_calibrate: int = 1000, min_sweep: int = 100, replicates: int = 1000,
                id_columns: tuple[str, ...] = ("machine_id", "bucket")) -> tuple[DataFrame, Bundle]:
    """``RECALIBRATION`` rows and the bundle for the other fleet, to be saved as a version of its own.

    The severity model's raw classes get new isotonic calibrators, and every model a new alarm level by the best F1, both from
    ``val``; ``test`` gives ranking quality with its bootstrap interval.  Precision, recall and F1 are those on ``val`` at the chosen
    level.  The severity row has means over the classes and the level for P(severe), ``ANY`` the level for any spike.  A model is
    skipped, with the reason, if it has too few labelled rows in ``val``, or test labels of none or only one class; it then keeps its
    calibrators and level.  All models and classes are judged in one pass of each kind.
    """
    spark = val.sparkSession
    names = [n for n in LABELS if n in bundle.models]
    keep = [*id_columns, *CLASSES, *OUTPUTS.values(), *LABELS.values()]
    raw = replace(bundle, calibrators=[])
    parts = {role: materialise(probabilities(raw, _with_severe(rows)).select(*keep), f"recalibrate-{role}") for role, rows in (("val", val), ("test", test))}
    counts = {role: rows.agg(*[F.struct(F.count(LABELS[n]).alias("n"), F.count_if(F.col(LABELS[n]) > 0).alias("p")).alias(n) for n in names] or [F.lit(0)]).first()
              for role, rows in parts.items()}
    reasons = {n: _why_not(n, counts["val"][n].n, counts["test"][n], min_calibrate if n == SEVERITY else min_sweep) for n in names}
    ready = [n for n in names if reasons[n] is None]
    fits = list(bundle.calibrators)
    if SEVERITY in ready:
        fits = models.fit_calibrators(parts["val"].filter(F.col(LABELS[SEVERITY]).isNotNull()), LABELS[SEVERITY], CLASSES)
    judged = {role: materialise(_judged(rows, ready, fits, id_columns), f"judged-{role}") for role, rows in parts.items()}
    levels, quality = _levels(judged["val"].filter(F.col("class").isin(_NO_CLASS, 2))), _quality(judged["test"], id_columns, replicates)
    rows, alarms = [], dict(bundle.alarms)
    for n in names:
        row = {"model": n, "status": "skipped" if reasons[n] else "recalibrated", "reason": reasons[n], "n_val": counts["val"][n].n,
               "n_test": counts["test"][n].n, "n_pos": counts["test"][n].p}
        if reasons[n]:
            rows.append(row)
        elif n == SEVERITY:
            each = [quality[n, k] for k in range(len(CLASSES)) if (n, k) in quality]
            ranked = [q for q in each if q["pr_auc"] is not None]
            means = {m: sum(q[m] for q in ranked) / len(ranked) for m in ("pr_auc", "roc_auc")} if ranked else {}
            rows += [row | means | levels[n, 2], row | {"model": ANY} | quality[ANY, _NO_CLASS] | levels[ANY, _NO_CLASS]]
            rows += [row | {"class": k} | quality[n, k] for k in range(len(CLASSES)) if (n, k) in quality]
            alarms[ANY] = levels[ANY, _NO_CLASS]["alarm_threshold"]
        else:
            rows.append(row | quality[n, _NO_CLASS] | levels[n, _NO_CLASS])
            alarms["severe" if n == CASCADE else n] = levels[n, _NO_CLASS]["alarm_threshold"]
    report = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in RECALIBRATION.split(", ")) for r in rows], RECALIBRATION)
    return report, replace(bundle, calibrators=fits, alarms=alarms, version=None)


def _why_not(name: str, n_val: int, held, least: int) -> str | None:
    if n_val < least:
        return f"fewer than {least} rows to {'calibrate' if name == SEVERITY else 'sweep'}"
    if not held.n:
        return "no test rows"
    return "test labels of one class" if name != SEVERITY and held.p in (0, held.n) else None


def _judged(rows: DataFrame, ready: list[str], fits: list[IsotonicRegressionModel], id_columns: tuple[str, ...]) -> DataFrame:
    """``id_columns, model, class, y, score`` for what each ready model is judged by."""
    def part(model: str, k: int, label: str, y: Column, score: Column) -> Column:
        return F.struct(F.lit(model).alias("model"), F.lit(k).alias("class"), F.when(F.col(label).isNotNull(), y.cast("int")).alias("y"), score.alias("score"))

    found = [part(n, _NO_CLASS, LABELS[n], F.col(LABELS[n]) > 0, F.col(OUTPUTS[n])) for n in ready if n != SEVERITY]
    if SEVERITY in ready:
        rows, label = models.apply_calibrators(fits, rows, CLASSES), LABELS[SEVERITY]
        found += [part(SEVERITY, k, label, F.col(label) == k, F.col(f"cal_{k}")) for k in range(len(CLASSES))]
        found.append(part(ANY, _NO_CLASS, label, F.col(label) > 0, 1 - F.col("cal_0")))
    empty = F.array().cast("array<struct<model:string,class:int,y:int,score:double>>")
    return rows.select(*id_columns, F.inline(F.array(*found) if found else empty)).filter("y is not null")


def _levels(judged: DataFrame) -> dict[tuple[str, int], dict[str, float]]:
    """Chosen alarm level of each model and what it gives; a handful of rows."""
    keys = ["model", "class"]
    table = materialise(metrics.sweep(judged, keys), "swept")
    best = metrics.best_threshold(table, keys).withColumnRenamed("threshold", "chosen")
    near = table.join(best, keys).withColumn("away", F.abs(F.col("threshold") - F.col("chosen")))
    picked = near.groupBy(*keys).agg(F.first("chosen").alias("chosen"), F.min_by(F.struct("precision", "recall", "f1"), "away").alias("at"))
    return {(r.model, r["class"]): {"alarm_threshold": r.chosen, "alarm_precision": r["at"].precision, "alarm_recall": r["at"].recall, "alarm_f1": r["at"].f1}
            for r in picked.collect()}


def _quality(judged: DataFrame, id_columns: tuple[str, ...], replicates: int) -> dict[tuple[str, int], dict[str, float]]:
    """Ranking quality of each model and class and its interval; a handful of rows."""
    keys = ["model", "class"]
    spans = metrics.bootstrap_interval(judged, keys, list(id_columns), replicates=replicates)
    out = {(r.model, r["class"]): {"n_pos": r.n_pos, "pr_auc": r.pr_auc, "roc_auc": r.roc_auc} for r in metrics.ranking(judged, keys).collect()}
    for r in spans.collect():
        out[r.model, r["class"]] |= {"pr_auc_low": r.low, "pr_auc_high": r.high}
    return out
