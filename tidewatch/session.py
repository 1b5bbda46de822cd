"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    global _local_root
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame that several branches of a plan read, and continue from the table.

    Lineage ends at files in the shared folder, so a lost executor costs a
    re-read and not a recomputation of everything before.  ``by`` names columns
    (the last ones, of few values) whose values are folders, so a branch that
    filters on them reads only its own rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table of a materialised frame that nothing reads any more; tables outside the shared folder stay."""
    spark = df.sparkSession
    root = shared_root(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root + "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
