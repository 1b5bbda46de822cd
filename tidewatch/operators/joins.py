"""Metric pivots, grids, fills, ids and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import half_even
from tidewatch.operators.ordered import amount_before

METRICS = ["total_cpu", "peak_cpu", "total_mem", "disk_io", "load1"]
RATE_METRICS = ["total_cpu", "peak_cpu", "disk_io", "load1"]


def pivot_metrics(samples: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Long samples to one row per node and time, kept where CPU is known."""
    wide = (samples.groupBy("nodename", "timestamp")
            .pivot("metric", metrics or METRICS).agg(F.first("value", ignorenulls=True)))
    return wide.filter(F.col("total_cpu").isNotNull())


def full_grid(wide: DataFrame, start: int | Column, end: int | Column, step: int, run: int = 1024) -> DataFrame:
    """Every node at every step in (start, end]; rows off the grid disappear.

    Steps are generated in runs of ``run`` per node, so no row ever carries
    the whole time range.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first = (lit(start) + step).cast("long")
    last = lit(end).cast("long")
    nodes = wide.select("nodename").distinct().withColumns({"_first": first, "_last": last})
    runs = (nodes.filter(F.col("_first") <= F.col("_last"))
            .select("nodename", "_last", F.explode(F.sequence("_first", "_last", F.lit(step * run).cast("long"))).alias("_at")))
    grid = runs.select("nodename", F.explode(F.sequence(
        "_at", F.least(F.col("_at") + step * (run - 1), F.col("_last")), F.lit(step).cast("long"))).alias("timestamp"))
    return grid.join(wide, ["nodename", "timestamp"], "left")


def fill_forward_back(df: DataFrame, columns: list[str], key: str = "nodename", order: str = "timestamp",
                      span: int = 8192 * S.BUCKET_SECONDS) -> DataFrame:
    """Last known value per key, else the next known one, else 0.

    Fills run inside time spans; the nearest known value outside a span comes
    from a table with one row per span.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / span).cast("long"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    edges = spans.groupBy(key, "_span").agg(
        *[F.max_by(c, known(c)).alias(f"_tail_{c}") for c in columns],
        *[F.min_by(c, known(c)).alias(f"_head_{c}") for c in columns])
    w = Window.partitionBy(key).orderBy("_span")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        key, "_span",
        *[F.last(f"_tail_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}") for c in columns],
        *[F.first(f"_head_{c}", ignorenulls=True).over(whole).alias(f"_first_{c}") for c in columns])
    upto = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # nothing known up to here means the next known value is the first one of the series
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_prev_{c}"), F.col(f"_first_{c}"), F.lit(0.0))
              for c in columns}
    joined = spans.join(carried, [key, "_span"], "left")
    return joined.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def fill_grid(grid: DataFrame, rates: list[str] | None = None, memory: list[str] | None = None,
              **kw) -> DataFrame:
    """Rates become 0 in gaps unless the whole column is absent; memory is carried over."""
    rates = [c for c in (rates or RATE_METRICS) if c in grid.columns]
    present = grid.agg(F.struct(*[F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False)).alias(c)
                                  for c in rates]).alias("p")).scalar()
    zeroed = grid.withColumn("_p", present).withColumns({
        c: F.coalesce(F.col(c), F.when(F.col(f"_p.{c}"), F.lit(0.0))) for c in rates}).drop("_p")
    return fill_forward_back(zeroed, memory or ["total_mem"], **kw)


def apply_fallbacks(filled: DataFrame) -> DataFrame:
    """Peak from total, disk 0, task count from load else CPU; mandatory metrics must be there."""
    base = F.coalesce("load1", "total_cpu") if "load1" in filled.columns else F.col("total_cpu")
    return (filled.withColumns({
        "peak_cpu": F.coalesce("peak_cpu", "total_cpu"),
        "peak_mem": F.col("total_mem"),
        "disk_io": F.coalesce("disk_io", F.lit(0.0)),
        "n_tasks": F.greatest(F.lit(1), half_even(base).cast("long"))})
        .na.drop(subset=["total_cpu", "total_mem"]))


def stable_ids(names: DataFrame, name: str = "nodename", start: int = 1, prefix: int | None = None) -> DataFrame:
    """Dense ids in name order, numbered by ranges of names; a null name is the first. ``prefix`` has no effect any more."""
    placed = amount_before(names.select(name).distinct(), [name], F.lit(1))
    return placed.select(name, (F.col("before") + start).cast("long").alias("machine_id"))


def resolve_items(readings: DataFrame, items: DataFrame) -> DataFrame:
    """Machine and kind of each reading; readings of unknown items are dropped."""
    return readings.join(items.select("itemid", "machine_id", "kind"), "itemid")


def feature_groups(spark) -> DataFrame:
    """The fixed taxonomy: a few dozen literal rows."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(g).alias("feature_group"))
             for g, members in S.FEATURE_GROUPS.items() for f in members]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def with_feature_group(df: DataFrame) -> DataFrame:
    """Group of each feature, "Other" if not listed.  The broadcast side is the literal taxonomy."""
    return (df.join(F.broadcast(feature_groups(df.sparkSession)), "feature", "left")
            .withColumn("feature_group", F.coalesce("feature_group", F.lit("Other"))))


def readings_with_labels(readings: DataFrame, labels: DataFrame) -> DataFrame:
    return readings.join(labels, ["machine_id", "bucket"])
