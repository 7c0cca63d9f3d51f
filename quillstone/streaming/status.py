"""File status as a stream: the latest state of each file, files that stopped changing, counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.catalog import first_by
from quillstone.sources.shared import exists, fresh

#: Events may be so late; after that a window's result is final.
LATENESS = "10 minutes"


def counts_by_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events of each type in each window; state older than the watermark is dropped."""
    return events.withWatermark("ts", LATENESS).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key, n_events, status, since for each key, whenever it changes; an event older than the last one changes nothing but the number.

    One row of state for each key. Rows of equal time: the larger event_id is the later one.
    """
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("since"))


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Process what is there and stop; each batch's rows are a folder of a table, written over if it is tried again. The checkpoint lets the next run go on.

    Returns the table, with the number of the batch; a stream that never had a batch gives no rows.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not exists(spark, folder):  # no batch yet
        return spark.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]))
    return spark.read.parquet(folder)


def compact(spark: SparkSession, folder: str, keys: list[str]) -> None:
    """Of each key the row of its newest batch, in the folder of the last batch; those of the batches before go.

    Between runs, not beside one. The rows are written aside first; ended halfway, it leaves older rows of a key beside the newest.
    """
    if not exists(spark, folder):
        return
    held = spark.read.parquet(folder)
    batches = sorted(r[0] for r in held.select("batch").distinct().collect())
    if len(batches) < 2:
        return
    aside = fresh(spark, "compact")
    first_by(held, keys, [F.col("batch").desc()]).drop("batch").write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").parquet(f"{folder}/batch={batches[-1]}")
    for n in batches[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
