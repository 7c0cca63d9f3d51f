"""Tables as numbered versions: a change is written beside the version in use and takes its place when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose writing was committed, in order; listed by Hadoop's file system, so on any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole version; None before the first."""
    found = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={found[-1]}") if found else None


def write(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write the next version; df may read the current one. One writer at a time; a failed writing leaves nothing that is read."""
    found = _versions(df.sparkSession, folder)
    number = found[-1] + 1 if found else 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/v={number}")
    return number


def expire(spark: SparkSession, folder: str, keep: int = 2) -> None:
    for n in _versions(spark, folder)[:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
