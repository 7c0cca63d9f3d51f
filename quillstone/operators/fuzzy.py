"""A stored trigram index: rows that can be like a text, found by counting the trigrams they share with it.

A folder holds postings (field, trigram, id) in BUCKETS partitions by the trigram's hash, sorted there, and the rows. A
search reads the asked trigrams' partitions only, and scores the rows that share enough of them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.trigram import trigrams, word_similarity

BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams_of(text: str) -> list[str]:
    """Distinct trigrams of a text's words, padded."""
    return sorted({p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)})


def inner_grams(text: str) -> list[str]:
    """Trigrams that any row holding the text as a part must have: those without padding. None for a text of short words."""
    return sorted({w[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) - 2)})


@dataclass
class TrigramIndex:
    """The index in a folder; key names the rows, fields are the text columns."""

    spark: SparkSession
    folder: str
    fields: tuple[str, ...] = ("display_name", "id")
    key: str = "uid"

    def build(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows")
        held = self.spark.read.parquet(f"{self.folder}/rows")
        grams = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), trigrams(F.coalesce(f, F.lit(""))).alias("grams")) for f in self.fields)))
        each = held.select(F.col(self.key).alias("key"), grams.alias("p")).select("key", "p.field", F.explode("p.grams").alias("gram"))
        postings = each.withColumn("bucket", _bucket(F.col("gram")))
        # by range, so that a frequent trigram's rows are shared out
        postings.repartitionByRange("bucket", "gram", "field", "key").sortWithinPartitions("bucket", "gram", "field", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def _sharing(self, field: str, grams: list[str], least: int) -> DataFrame:
        """Keys of rows that have at least so many of the trigrams in the field."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        found = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & (F.col("field") == field))
        return found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")

    def candidates(self, text: str, least: dict[str, float], parts: tuple[str, ...] = ()) -> DataFrame | None:
        """Keys of all rows whose field can be like the text to the degree in least, or can hold it as a part; None if trigrams exclude no row.

        A similarity of t to a text of n trigrams takes t * n of them: what they are divided by is n at least. A field
        that holds the text has all of its inner trigrams.
        """
        asked, inner = grams_of(text), inner_grams(text)
        if not asked or any(t <= 0 for t in least.values()) or (parts and not inner):
            return None
        found = [self._sharing(f, asked, max(1, math.ceil(t * len(asked) - 1e-9))) for f, t in least.items()] + [self._sharing(f, inner, len(inner)) for f in parts]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()

    def matching(self, where: Column, text: str, least: dict[str, float], parts: tuple[str, ...] = ()) -> DataFrame:
        """Rows that the exact condition holds for; it is asked of candidates only."""
        few = self.candidates(text, least, parts)
        rows = self.rows()
        return (rows if few is None else rows.join(few.withColumnRenamed("key", self.key), self.key, "left_semi")).where(where)

    def search(self, text: str, field: str, least: float, k: int | None = None) -> DataFrame:
        """Rows whose field is like the text in a stretch of it, and score; the most alike first if k is given."""
        score = F.round(word_similarity(text, F.col(field)), 6)
        found = self.matching(F.lit(True), text, {field: least}).withColumn("score", score).where(F.col("score") >= least)
        return found if k is None else found.orderBy(F.col("score").desc(), self.key).limit(k)
