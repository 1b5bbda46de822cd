"""Scans of landed files; schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.scalar import col
from tidewatch.sources.contracts import whole_number

MICROS_PER_HOUR = 3_600_000_000


def task_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """The nine task columns, by name, from a wider CSV with a header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f.name).cast("double").alias(f.name) for f in S.TASK_USAGE.fields])


def trace_parts(spark: SparkSession, path: str, hours: float) -> DataFrame:
    """Headerless gzip parts, columns picked by position; bad lines are skipped."""
    raw = (spark.read.schema(S.TRACE_RAW).option("mode", "DROPMALFORMED").csv(path))
    return (raw.filter(F.col("start_time") <= F.lit(float(hours * MICROS_PER_HOUR)))
            .select(*[f.name for f in S.TASK_USAGE.fields]))


def cluster_agg(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate table from CSV or Parquet by suffix, ids as long."""
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in S.CLUSTER_AGG.fields}
    typed = [whole_number(F.col(c)).alias(c) if c in kinds and kinds[c].typeName() == "long"
             and dict(raw.dtypes)[c] == "string"
             else (F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c)) for c in raw.columns]
    return raw.select(*typed)


def columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Parquet scan of just these columns."""
    return spark.read.parquet(path).select(*names)


def parse_matrix(responses: DataFrame) -> DataFrame:
    """Matrix responses to tidy ``timestamp, nodename, value``; a failed one is an error."""
    failed = F.raise_error(F.concat(F.lit("query failed: "), F.coalesce("status", F.lit("no status")),
                                    F.lit(" "), F.coalesce("error", F.lit(""))))
    series = F.when(F.col("status") == "success", F.col("data.result")).otherwise(failed)
    metric = F.col("s.metric")
    name = F.coalesce(F.nullif(metric.getItem("nodename"), F.lit("")), metric.getItem("node"), F.lit("unknown"))
    keep = [c for c in responses.columns if c not in ("status", "error", "data")]
    return (responses.select(*keep, F.explode(series).alias("s"))
            .select(*keep, name.alias("nodename"), F.explode("s.values").alias("v"))
            .select(*keep, F.floor(F.element_at("v", 1).cast("double")).cast("long").alias("timestamp"),
                    "nodename", F.element_at("v", 2).cast("double").alias("value")))


def metric_matrix(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Landed matrix responses: one JSON document per line (splittable) or per file."""
    return parse_matrix(spark.read.schema(S.METRIC_MATRIX)
                        .option("multiLine", not one_per_line).json(path))


def item_history(spark: SparkSession, path: str) -> DataFrame:
    """Item readings with numeric values; rows that do not parse are skipped."""
    raw = spark.read.schema(S.ITEM_HISTORY).json(path)
    return (raw.select("itemid", "clock", col("value").try_cast("double").alias("value"))
            .filter(F.col("value").isNotNull() & F.col("clock").isNotNull()))


def item_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ITEM_CATALOG).json(path)
