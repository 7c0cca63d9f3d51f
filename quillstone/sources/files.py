"""Reading blobs, logs and key tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets whose events are of no interest.
IGNORED_BUCKETS = ("core-milvus",)
IGNORED_EVENTS = ("ILMExpiry",)
EVENT = "EventName string, Key string, Records array<struct<eventTime:string,eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:long>>>>"


def blobs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of a folder's files; content is read only if it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Paths and sizes of the blobs whose name in the folder begins with a prefix, without reading contents."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    found = blobs(spark, folder).select("path", "length", "modificationTime")
    name = F.regexp_replace(F.replace("path", F.lit(root), F.lit("")), "^/+", "")
    return found.where(F.startswith(name, F.lit(prefix.lstrip("/"))))


def fetch(wanted: DataFrame, held: DataFrame, path: str = "path") -> DataFrame:
    """Every wanted path with its content, or an error where there is none; one missing blob fails no other."""
    own = held.select(F.regexp_replace("path", "^file:/+", "/").alias(path), "content")
    return wanted.join(own, path, "left").withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("no blob at "), F.col(path))))


def audit_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Object-store webhooks as rows; works on a stream as on a table. Malformed lines give no row."""
    parsed = lines.select(F.from_json(column, EVENT).alias("e")).select(F.explode("e.Records").alias("r"))
    rows = parsed.select(F.col("r.eventName").alias("event"), F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("key"), F.col("r.s3.object.size").alias("size"), F.to_timestamp("r.eventTime").alias("at"))
    dull = F.col("bucket").isin(*IGNORED_BUCKETS)
    for e in IGNORED_EVENTS:
        dull = dull | F.contains("event", F.lit(e))
    return rows.where(~F.coalesce(dull, F.lit(False)))


def expiring(keys: DataFrame, now: Column, minutes: int = 1) -> DataFrame:
    """Keys that end within so many minutes, or have ended."""
    return keys.where(F.col("expire_at") <= now + F.expr(f"interval {minutes} minutes"))


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("delete_time").isNull())


def lookup(df: DataFrame, uids: list[str], *columns: str) -> DataFrame:
    """Some columns of some rows; both the filter and the projection reach the scan."""
    return df.where(F.col("uid").isin(*uids)).select(*(columns or df.columns))
