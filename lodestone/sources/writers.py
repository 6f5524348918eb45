"""Sinks: idempotent parquet and CSV writes, partitioned tables, versions swapped in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Writes unless the target exists; the commit protocol leaves nothing half-written."""
    w = df.write.mode("ignore").format(fmt)
    if fmt == "csv":
        w = w.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A table bucketed and sorted by its join keys: later joins and aggregates on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def replace(df: DataFrame, path: str) -> None:
    """A new version beside the old one, then swapped in by renames."""
    spark = df.sparkSession
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)
