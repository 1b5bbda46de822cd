"""What a table must look like on entry and exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S


def missing_columns(df: DataFrame, required=S.AGG_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required=S.AGG_COLUMNS, non_empty: bool = True) -> DataFrame:
    """Raise if a column is missing or, optionally, if there is no row at all."""
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing columns: {gone}")
    if non_empty and df.limit(1).isEmpty():
        raise ValueError("no rows")
    return df


def whole_number(value: Column) -> Column:
    """A long; only text such as ``1e3`` or ``7.0`` goes through a double, which would change ids above 2**53."""
    return F.coalesce(value.try_cast("string").try_cast("long"), value.try_cast("double").try_cast("long"))


def coerce(df: DataFrame) -> DataFrame:
    """Cast the aggregate columns; text that is no number becomes null."""
    whole = ("machine_id", "bucket", "time_us", "n_tasks")
    out = []
    for c in df.columns:
        if c in whole:
            out.append(whole_number(F.col(c)).alias(c))
        elif c in S.SIGNALS:
            out.append(F.col(c).try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def coercion_losses(df: DataFrame) -> DataFrame:
    """Per column, how many values casting would lose."""
    names = [c for c in S.AGG_COLUMNS if c in df.columns]
    pairs = df.select(*[(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in names])
    counted = pairs.agg(*[F.count_if(F.col(c)).alias(c) for c in names])
    return counted.unpivot([], names, "column_name", "lost")


def coerce_strict(df: DataFrame) -> DataFrame:
    """Cast, raising on any value that is not numeric."""
    bad = coercion_losses(df).filter("lost > 0").collect()  # a row per column at most
    if bad:
        raise ValueError(f"non-numeric values: {[(r.column_name, r.lost) for r in bad]}")
    return coerce(df)


def bounds_report(df: DataFrame) -> DataFrame:
    """Percent of rows beyond the plausible bound of each column; nothing is dropped."""
    shares = []
    for name, (side, bound) in S.INPUT_BOUNDS.items():
        beyond = F.col(name) > bound if side == "above" else F.col(name) < bound
        shares.append((F.avg(F.when(beyond, 1.0).otherwise(0.0)) * 100).alias(name))
    return df.agg(*shares).unpivot([], list(S.INPUT_BOUNDS), "column_name", "percent_beyond")


def null_features(df: DataFrame, features=tuple(S.MODEL_FEATURES)) -> DataFrame:
    """One row per feature: does it hold a null or NaN anywhere?"""
    unclean = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    seen = df.agg(*[F.coalesce(F.max(unclean(c)), F.lit(False)).alias(c) for c in features])
    return seen.unpivot([], list(features), "feature", "has_null")


def low_coverage(agg: DataFrame, at_least: int = S.COVERAGE_MIN_BUCKETS) -> DataFrame:
    from tidewatch.operators.thresholds import bucket_depth
    return bucket_depth(agg).filter(F.col("n_buckets") < at_least)


def at_rest(agg: DataFrame) -> DataFrame:
    """Ordered columns and storage types of the aggregate table."""
    types = {"machine_id": "long", "bucket": "long", "time_us": "long", "n_tasks": "int"}
    return agg.select(*[F.col(c).cast(types.get(c, "float")).alias(c) for c in S.AGG_COLUMNS])
