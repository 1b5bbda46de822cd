"""Exact order statistics and running totals without one task per group.

A group (a machine, a bucket, a feature, the whole table) may hold a third of
all rows, so nothing here sorts a whole group in one task.  Equal values are
first collapsed by an ordinary aggregation, then each group is cut into narrow
value bands.  A band is a pure function of the value, so a re-run task always
lands in the same band.  Only the per-band totals of a group - a bounded
number of rows - are ever scanned in order by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

BANDS_PER_E_FOLD = 2048   # relative band width of about 0.05 %


def band(value: Column, resolution: int = BANDS_PER_E_FOLD) -> Column:
    """Monotone integer image of a double, fine in relative terms."""
    zero = resolution * 800
    # infinities have the outermost bands
    size = F.when(F.abs(value) == float("inf"), F.lit(resolution * 1600)).otherwise(F.floor(F.log(F.abs(value)) * resolution) + zero)
    signed = F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))
    # never null, so a join on it infers no extra filter and both readers of a
    # collapsed table keep the same plan below and share its exchange
    return F.coalesce(signed.cast("long"), F.lit(0).cast("long"))


def ordered_rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that have a place in the order: null keys and values and NaN are left out."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.filter(known)


def collapse(df: DataFrame, keys: list[str], value: str, **measures: Column) -> DataFrame:
    """One row per distinct value and group, with the given sums, of the rows that have a place in the order."""
    sums = measures or {"rows_at": F.count(F.lit(1))}
    return ordered_rows(df, keys, value).groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])


def running_totals(collapsed: DataFrame, keys: list[str], value: str, measures: list[str],
                   descending: bool = False, totals: bool = True) -> DataFrame:
    """Add ``through_<m>`` (inclusive) and ``all_<m>`` per group in value order.

    ``collapsed`` holds one row per group and value.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = collapsed.withColumn("_band", band(F.col(value)))
    per_band = rows.groupBy(*keys, "_band").agg(*[F.sum(m).alias(m) for m in measures])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ahead = group.orderBy(direction("_band")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_band.select(
        *keys, "_band",
        *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"_ahead_{m}") for m in measures],
        *([F.sum(m).over(group).alias(f"all_{m}") for m in measures] if totals else []))
    inside = (Window.partitionBy(*keys, "_band").orderBy(direction(value))
              .rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.join(offsets, [*keys, "_band"])
    return joined.select(
        *collapsed.columns,
        *[(F.col(f"_ahead_{m}") + F.sum(m).over(inside)).alias(f"through_{m}") for m in measures],
        *([F.col(f"all_{m}") for m in measures] if totals else []))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              few_groups: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    First an integer histogram over bands, combined before it is shuffled,
    finds which bands hold the wanted ranks; then only the rows of those bands
    are collapsed and ordered.  There are at most two such bands per group and
    quantile: with no keys, or with groups the caller knows to be few, that
    bound is small enough to broadcast them, and no other row is shuffled.
    """
    rows = ordered_rows(df, keys, value).select(*keys, value).withColumn("_band", band(F.col(value)))
    per_band = rows.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_in_band"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ahead = group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    ranks = {}
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        ranks[name] = (place, F.floor(place), F.ceil(place))
    wanted = [r for _, low, high in ranks.values() for r in (low, high)]
    hit = F.lit(False)
    for rank in wanted:
        hit = hit | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in_band")))
    targets = (per_band
               .withColumn("_before", F.coalesce(F.sum("_in_band").over(ahead), F.lit(0)))
               .withColumn("_n", F.sum("_in_band").over(group))
               .filter(hit).select(*keys, "_band", "_before", "_n"))
    inside = (Window.partitionBy(*keys, "_band").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    if few_groups or not keys:
        targets = F.broadcast(targets)
    distinct = (rows.join(targets, [*keys, "_band"]).groupBy(*keys, "_band", value)
                .agg(F.count(F.lit(1)).alias("rows_at"), F.max("_before").alias("_before"), F.max("_n").alias("_n")))
    placed = (distinct
              .withColumn("_through", F.col("_before") + F.sum("rows_at").over(inside)))
    at = lambda rank: F.min(F.when(F.col("_through") > rank, F.col(value)))
    picked = placed.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(low).alias(f"_lo_{name}") for name, (_, low, _) in ranks.items()],
        *[at(high).alias(f"_hi_{name}") for name, (_, _, high) in ranks.items()])
    out = []
    for name, (place, low, _) in ranks.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        # equal neighbours may be infinite, and their difference no number
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - low)).alias(name))
    return picked.select(*keys, *out)


def average_rank(df: DataFrame, keys: list[str], value: str, output: str) -> DataFrame:
    """Percentile rank in the group with ties averaged, divided by the group size."""
    ranked = running_totals(collapse(df, keys, value), keys, value, ["rows_at"])
    share = (F.col("through_rows_at") - (F.col("rows_at") - 1) / 2.0) / F.col("all_rows_at")
    return df.join(ranked.select(*keys, value, share.alias(output)), [*keys, value], "left")


def amount_before(df: DataFrame, order: list[str], amount: Column, output: str = "before") -> DataFrame:
    """Add the sum of ``amount`` (whole numbers) over all rows that come earlier in ``order``, whose values should be unique.

    Rows are dealt to tasks by ranges of the order and written; only one sum for each range meets on the driver. Ranges are sampled
    over all of ``order``, so names that begin alike are spread as well as any.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_amount", amount).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    ahead, entries = 0, []
    for r in placed.groupBy("_range").agg(F.sum("_amount").alias("n")).orderBy("_range").collect():  # one row a range
        entries.append(f"({r['_range']}, {ahead}L)")
        ahead += r["n"]
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = spark.sql(f"SELECT * FROM VALUES {', '.join(entries or ['(-1, 0L)'])} AS t(_range, _range_base)")
    return (placed.join(F.broadcast(base), "_range").withColumn(output, F.col("_range_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
            .drop("_range", "_amount", "_range_base"))
