"""Rule-based scores that a trained model has to beat.

Row windows follow the rows as stored (no gap filling).  A scorer adds its
column to the chunked frame made by ``prepare``; ``score_all`` shares one frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import flag
from tidewatch.operators import chunks, metrics
from tidewatch.operators.splits import draw
from tidewatch.operators.thresholds import split_point
from tidewatch.session import materialise

LOOKBACK, SPAN, WINDOW, MIN_ROWS = 4, 12, 24, 4
FIT_RATIO, FIT_MIN_ROWS = 0.6, 20
SIZE, BACK = 4096, 512     # the halo is twice the reach of the span-12 mean
FLOOR = 1e-9

Scorer = Callable[[DataFrame], DataFrame]


def prepare(rows: DataFrame) -> DataFrame:
    """``rows``: machine_id, bucket, total_cpu, p95 and anything to keep."""
    return chunks.row_chunks(rows, back=BACK, size=SIZE)


def _w():
    return chunks.series_window("machine_id", "pos")


def random_score(seed: int = 42) -> Column:
    return draw(seed=seed)


def persistence() -> Column:
    return F.least(F.lit(20.0), F.col("total_cpu") / F.greatest(F.col("p95"), F.lit(FLOOR)))


def static_share() -> Column:
    """Share of the previous rows above the threshold."""
    over = flag(F.col("total_cpu") > F.col("p95"))
    return F.coalesce(F.avg(over).over(_w().rowsBetween(-LOOKBACK, -1)), F.lit(0.0))


def rolling_z() -> Column:
    frame = _w().rowsBetween(-WINDOW, -1)
    mean, std = F.avg("total_cpu").over(frame), F.stddev_samp("total_cpu").over(frame)
    z = F.greatest((F.col("total_cpu") - mean) / F.greatest(std, F.lit(FLOOR)), F.lit(0.0))
    return F.when(F.count(F.lit(1)).over(frame) >= MIN_ROWS, z).otherwise(0.0)


def with_ewma_z(frame: DataFrame, output: str = "ewma_zscore") -> DataFrame:
    """Distance from the exponential mean of the past in units of its deviation."""
    keep = 1.0 - 2.0 / (SPAN + 1)
    fit = dict(key="machine_id", order="pos", size=SIZE, back=BACK)
    mean = chunks.decayed_mean(frame, "total_cpu", keep, "_m", **fit)
    away = mean.withColumn("_mu", F.lag("_m").over(_w())).withColumn("_sq", F.pow(F.col("total_cpu") - F.col("_mu"), 2))
    spread = chunks.decayed_mean(away, "_sq", keep, "_v", **fit).withColumn("_var", F.lag("_v").over(_w()))
    z = F.greatest((F.col("total_cpu") - F.col("_mu")) / F.greatest(F.sqrt("_var"), F.lit(FLOOR)), F.lit(0.0))
    return spread.withColumn(output, F.coalesce(F.when(F.col("_var").isNotNull(), z), F.lit(0.0))) \
        .drop("_m", "_mu", "_sq", "_v", "_var")


def _steps(frame: DataFrame) -> DataFrame:
    ago = lambda k: F.lag("total_cpu", k).over(_w())
    return frame.withColumns({"_d0": F.col("total_cpu") - ago(1), "_d1": ago(1) - ago(2), "_d2": ago(2) - ago(3),
                              "_x1": ago(1)})


def fit_ar2(frame: DataFrame, cutoff: Column) -> DataFrame:
    """Least squares of each difference on the two before it: five sums per machine."""
    train = _steps(frame).filter(F.col("_own") & (F.col("bucket") <= cutoff))
    known = F.col("_d2").isNotNull()
    term = lambda a, b: F.sum(F.when(known, F.col(a) * F.col(b)))
    sums = train.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n"), term("_d1", "_d1").alias("s11"), term("_d2", "_d2").alias("s22"),
        term("_d1", "_d2").alias("s12"), term("_d1", "_d0").alias("s1y"), term("_d2", "_d0").alias("s2y"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    return (sums.filter((F.col("n") >= FIT_MIN_ROWS) & (det > 1e-12))
            .select("machine_id",
                    ((F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).alias("phi1"),
                    ((F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det).alias("phi2")))


def with_ar2(frame: DataFrame, output: str = "arima") -> DataFrame:
    """One-step forecast relative to the threshold; persistence where no fit exists.

    The fit table has one row per machine; adaptive execution picks the join.
    """
    cutoff = split_point(frame.filter("_own"), FIT_RATIO)
    fitted = _steps(frame).join(fit_ar2(frame, cutoff), "machine_id", "left")
    forecast = F.col("_x1") + F.col("phi1") * F.col("_d1") + F.col("phi2") * F.col("_d2")
    score = F.greatest(F.lit(0.0), forecast / F.greatest(F.col("p95"), F.lit(FLOOR)) - 0.5)
    return fitted.withColumn(output, F.when(F.col("phi1").isNull(), persistence())
                             .otherwise(F.coalesce(score, F.lit(0.0)))) \
        .drop("_d0", "_d1", "_d2", "_x1", "phi1", "phi2")


SCORERS: dict[str, Scorer] = {
    "random": lambda d: d.withColumn("random", random_score()),
    "persistence": lambda d: d.withColumn("persistence", persistence()),
    "static_thresh": lambda d: d.withColumn("static_thresh", static_share()),
    "ewma_zscore": with_ewma_z,
    "rolling_zscore": lambda d: d.withColumn("rolling_zscore", rolling_z()),
    "arima": with_ar2,
}


def register_scorer(name: str, scorer: Scorer) -> None:
    """A scorer adds a column called ``name`` to the prepared frame."""
    SCORERS[name] = scorer


def score_all(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All scores side by side, one row per input row."""
    chosen = names or list(SCORERS)
    frame = prepare(rows)
    if len(chosen) > 1:  # several passes read it: a cutoff, a fit and the scores
        frame = materialise(frame, "prepared")
    for n in chosen:
        frame = SCORERS[n](frame)
    return chunks.owned(frame).drop("pos", "series_rows")


def evaluate(scored: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    """Ranking metrics of each baseline against binary labels, one-vs-rest classes and severe-vs-rest."""
    sev = F.col("severity_in_60m")
    labels = {lab: F.col(lab) for lab in S.SHORT_HORIZONS} | {f"severity_class_{k}": sev == k for k in range(3)} | {"severe_vs_rest": sev == 2}
    scores = F.array(*[F.struct(F.lit(n).alias("baseline"), F.round(F.col(n), digits).alias("score")) for n in names])
    long = scored.select(*S.SHORT_HORIZONS, "severity_in_60m", F.inline(scores))
    return metrics.ranking_of_labels(long, ["baseline"], labels)
