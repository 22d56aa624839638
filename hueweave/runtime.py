"""Session helpers: shared storage for cutting lineage, and size checks for broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    Taken from ``spark.checkpoint.dir``. Only a single-process local session may
    leave it unset; a cluster without it is an error, because a machine-local
    folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hueweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Whether Spark deletes the shuffle files of a query when it ends, rather than when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, by: str | None = None, lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; with ``by``, in a folder for each value of that column (the last one then), which ``discard`` can delete alone.

    With ``lean`` the shuffle files behind the table go as soon as it is written.

    This cuts the lineage, survives the loss of any executor (files are in shared
    storage) and gives the optimizer true sizes for what follows.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if lean else kept)
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._hw_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete materialized tables that nothing to come reads, or a ``part`` of them, ``column=value``."""
    for df in tables:
        _delete(df.sparkSession, f"{df._hw_path}/{part}" if part else df._hw_path)


def release(spark: SparkSession) -> None:
    """Delete what this application has materialized."""
    _delete(spark, f"{shared_dir(spark)}/hueweave/{spark.sparkContext.applicationId}")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the counted rows are under ``limit``; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df
