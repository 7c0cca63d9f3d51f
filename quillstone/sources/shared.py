"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_found: dict[tuple[str, ...], str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one has its own."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = (spark.sparkContext.applicationId,)
    if own not in _found:
        _found[own] = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
    return _found[own]


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name there."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def once(spark: SparkSession, name: str, key: str, build) -> str:
    """The folder that build(folder) filled in this application, made at the first call; key: what it is made of."""
    at = (spark.sparkContext.applicationId, name, key)
    if at not in _found:
        build(folder := fresh(spark, name))
        _found[at] = folder
    return _found[at]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df as a table there, dealt by a key into as many buckets as shuffles have partitions: joins on the key don't shuffle it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quillstone_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", fresh(spark, "dealt")).saveAsTable(name)
    return spark.table(name)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
