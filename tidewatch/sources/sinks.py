"""Table and report writers, and reuse of finished stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession



def write_table(df: DataFrame, path: str, keys: tuple[str, ...] = ("machine_id", "bucket"),
                mode: str = "overwrite") -> str:
    """Zstd Parquet, ranged and sorted by key so row groups prune; no machine is one task."""
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode(mode).option("compression", "zstd").parquet(path))
    return path


def write_report(df: DataFrame, path: str) -> str:
    """Small JSON report in one file; the commit protocol makes it appear whole or not at all."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a finished job left its success marker under ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], *,
                   force: bool = False, keys: tuple[str, ...] = ("machine_id", "bucket")) -> DataFrame:
    """Read a finished stage, or run and write it."""
    if force or not is_complete(spark, path):
        write_table(build(), path, keys)
    return spark.read.parquet(path)


def run_stages(spark: SparkSession, root: str, stages: list[tuple[str, Callable]], *,
               force: bool = False, from_step: int = 1) -> DataFrame:
    """Chain of stages, each fed the previous result; steps from ``from_step`` on are redone."""
    result = None
    for number, (name, step) in enumerate(stages, start=1):
        given = result
        redo = force or (from_step > 1 and number >= from_step)
        result = reuse_or_build(spark, f"{root}/{name}", lambda: step(given), force=redo)
    return result


