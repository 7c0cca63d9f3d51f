"""Tables in buckets by the hash of their key, of which a change rewrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import exists, fresh

BUCKET = "bucket_"


@dataclass
class KeyedTable:
    """A table in a folder; key: its columns that name a row. One writer at a time."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    buckets: int = 64

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """rows in buckets; of a key with several rows one must have been chosen."""
        self._dealt(rows).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.folder)

    def append(self, rows: DataFrame) -> None:
        """Rows of new keys, in files beside those that are there."""
        self._dealt(rows).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.folder)

    def exists(self) -> bool:
        return exists(self.spark, self.folder)

    def drop(self) -> None:
        """The table goes with all its rows; one that isn't there is no error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        return self._held().drop(BUCKET)

    def _held(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Old rows of the touched buckets (at most as many as there are buckets) are replaced by what change makes of them.

        The new rows are written aside first, as a table can't be read while it is written over.
        """
        if not touched:
            return []
        old = self._held().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        aside = fresh(self.spark, "staged")
        self._dealt(change(old)).repartition(BUCKET).write.parquet(aside)
        new = self.spark.read.parquet(aside)
        left = {r[0] for r in new.select(BUCKET).distinct().collect()}
        new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.folder)
        for b in set(touched) - left:  # nothing was written that could take their place
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{BUCKET}={b}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return touched

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._dealt(rows.select(*self.key)).select(BUCKET).distinct().collect())

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows of keys that are there are replaced, others added; returns the buckets that were written."""

        def change(old: DataFrame) -> DataFrame:
            return old.join(rows.select(*self.key), list(self.key), "left_anti").select(*rows.columns).unionByName(rows)

        return self._rewrite(self._touched(rows), change)

    def delete(self, where: Column) -> list[int]:
        """Rows that the condition holds for go; only its columns are read to know their buckets."""
        return self._rewrite(self._where(where), lambda old: old.where(~F.coalesce(where, F.lit(False))))

    def update(self, where: Column, values: dict[str, Column]) -> list[int]:
        """Columns of the rows that the condition holds for get new values; not those of the key."""
        hit = F.coalesce(where, F.lit(False))
        # the condition is asked of the row as it was
        return self._rewrite(self._where(where), lambda old: old.withColumn("hit_", hit).withColumns({c: F.when(F.col("hit_"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("hit_"))

    def _where(self, where: Column) -> list[int]:
        return sorted(r[0] for r in self._held().where(where).select(BUCKET).distinct().collect())

    def files(self) -> dict[str, int]:
        """Paths and times of the files."""
        if not exists(self.spark, self.folder):
            return {}
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.folder)
        return {r[0]: r[1] for r in found.select("path", F.unix_micros("modificationTime")).collect()}
