"""A stored sparse index: postings clustered by term, in blocks with their maxima, for BM25.

A folder holds segments, which are written once. A segment has

* `documents`: the collection's rows in order of their id, each with its number of terms and its range, which is a
  stretch of BLOCK rows;
* `postings`: for each term and range the rows that hold the term, the greatest count and the least length among them,
  in one of BUCKETS partitions by the term's hash and sorted in each of its files, so that a question reads its terms'
  row groups; a range that two tasks read has two blocks of a term, whose rows, counts and bounds add up;
* `removed` and `dropped`: ids that a later segment removed from earlier ones, and how often their terms occurred;
* `statistics`: how the numbers of rows and terms changed. It is written last; a segment without it isn't read.

A search bounds each range's best score by the maxima of its blocks, scores the most promising ranges, and reads the
postings of the others only where the bound reaches the k-th score found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.search import K1, TOP_K, B, dense, fuse, ranked, tokens
from quillstone.sources.shared import exists

#: Rows of a range are 2 ** BLOCK_BITS; partitions of the postings.
BLOCK_BITS, BUCKETS = 10, 64
#: Ranges that are scored first, to know a score that others must reach.
PROBED = 8
#: Scores are rounded to so many digits before they are compared.
DIGITS = 6


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, range, n, most, least, held: blocks of documents (range, id, dl, terms), a range's one after the other in order of id."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        ranges = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a and own and own[0].column(0)[0].as_py() != ranges[a]:
                yield range_blocks(own)
                own = []
            if b > a:
                own.append(batch.slice(a, b - a))
    if own:
        yield range_blocks(own)


def range_blocks(own: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The blocks of one range."""
    rows = pa.Table.from_batches(own).combine_chunks()
    ids, lengths = rows["id"].combine_chunks(), rows["dl"].to_numpy()
    coded = pa.concat_arrays([b.column(3).flatten() for b in own]).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
    at, counts = np.unique(at, return_counts=True)
    term, row = np.divmod(at, len(lengths))
    tf, dl = counts.astype(np.int32), lengths[row].astype(np.int32)
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    bounds = np.append(heads, len(term)).astype(np.int32)
    held = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"]))
    most, least = (np.maximum.reduceat(tf, heads), np.minimum.reduceat(dl, heads)) if len(heads) else (tf, dl)
    columns = [coded.dictionary.take(pa.array(term[heads])), pa.array(np.full(len(heads), rows["range"][0].as_py(), dtype=np.int64)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(most), pa.array(least), held]
    return pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "most", "least", "held"])


_parts: dict[tuple, DataFrame | None] = {}


@dataclass
class SparseIndex:
    """The index in a folder. id_ and text name the collection's columns."""

    spark: SparkSession
    folder: str
    id_: str = "uid"
    text: str = "text"

    def statistics(self) -> dict[int, tuple[int, int]]:
        """Changes of the numbers of rows and of terms by committed segment, a row each."""
        if not exists(self.spark, f"{self.folder}/statistics"):
            return {}
        held = self.spark.read.schema("rows long, terms long, segment int").parquet(f"{self.folder}/statistics")
        return {r["segment"]: (r["rows"], r["terms"]) for r in held.collect()}

    def segments(self) -> list[int]:
        """Committed segments."""
        return sorted(self.statistics())

    def part(self, name: str, segments: list[int] | None = None) -> DataFrame | None:
        """A part's rows of the committed segments; None if it has none. What is committed doesn't change, so its plan is kept."""
        own = self.segments() if segments is None else segments
        at = (self.spark.sparkContext.applicationId, self.folder, name, tuple(own))
        if at not in _parts:
            root = f"{self.folder}/{name}"
            paths = [p for n in own if exists(self.spark, p := f"{root}/segment={n}")]
            _parts[at] = self.spark.read.option("basePath", root).parquet(*paths) if paths else None
        return _parts[at]

    def add(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """Write a segment of new rows, and of ids that are removed from all segments before it; returns its number.

        A row whose id the index has must be among the removed ones. Null texts have no terms; an id is not null and
        comes once. One writer at a time; a failed one leaves nothing that is read, and its number is written over.
        """
        spark, number = self.spark, max(self.segments(), default=0) + 1
        place = f"segment={number}"
        ordered = rows.withColumn("dl", F.size(tokens(F.coalesce(self.text, F.lit(""))))).repartitionByRange(self.id_).sortWithinPartitions(self.id_)
        # ids of a partition follow one another, and a partition's first is a multiple of the block
        ordered.withColumn("range", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)).write.mode("overwrite").parquet(f"{self.folder}/documents/{place}")
        documents = spark.read.parquet(f"{self.folder}/documents/{place}")
        said = documents.select("range", F.col(self.id_).alias("id"), "dl", tokens(F.coalesce(self.text, F.lit(""))).alias("terms"))
        kind = said.schema["id"].dataType.simpleString()
        blocks = said.mapInArrow(blocks_of, f"term string, range long, n int, most int, least int, held array<struct<id:{kind},tf:int,dl:int>>")
        dealt = blocks.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/{place}")
        total = documents.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))
        if removed is not None and (old := self.part("documents")) is not None:
            gone = self._live(old, "id_").join(removed.select(F.col(self.id_).alias("id_")).distinct(), "id_", "left_semi")
            gone.select("id_").write.mode("overwrite").parquet(f"{self.folder}/removed/{place}")
            gone = self._live(old, "id_").join(spark.read.parquet(f"{self.folder}/removed/{place}"), "id_", "left_semi")
            terms = gone.select(F.explode(F.array_distinct(tokens(F.coalesce(self.text, F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
            terms.withColumn("bucket", bucket(F.col("term"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/dropped/{place}")
            total = total.unionByName(gone.agg((-F.count("*")).alias("rows"), F.coalesce(-F.sum("dl"), F.lit(0)).alias("terms")))
        total.agg(F.sum("rows").cast("long").alias("rows"), F.sum("terms").cast("long").alias("terms")).write.mode("overwrite").parquet(f"{self.folder}/statistics/{place}")
        return number

    def _live(self, rows: DataFrame, id_: str, segments: list[int] | None = None) -> DataFrame:
        """rows (segment and an id) without those that a later segment removed."""
        rows = rows.withColumn(id_, F.col(self.id_)) if id_ not in rows.columns else rows
        removed = self.part("removed", segments)
        if removed is None:
            return rows
        last = removed.groupBy(F.col("id_").alias("gone_")).agg(F.max("segment").alias("until_"))
        return rows.join(last, (F.col(id_) == F.col("gone_")) & (F.col("segment") < F.col("until_")), "left_anti")

    def live(self) -> DataFrame:
        """The collection's rows as they are."""
        return self._live(self.part("documents"), "id_").drop("id_", "segment", "range", "dl")

    def merged(self, folder: str) -> SparseIndex:
        """The same collection as one segment in another folder, without removed rows."""
        out = SparseIndex(self.spark, folder, self.id_, self.text)
        out.add(self.live())
        return out

    def postings_of(self, terms: dict[str, int], segments: list[int] | None = None) -> DataFrame:
        """Blocks of these terms (with their buckets); both filters reach the scan: partitions by bucket, row groups by term."""
        return self.part("postings", segments).where(F.col("bucket").isin(sorted(set(terms.values()))) & F.col("term").isin(sorted(terms)))

    def terms_of(self, question: str) -> dict[str, int]:
        """A question's distinct terms and their buckets."""
        asked = self.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(question)))).alias("term"))
        return {r[0]: r[1] for r in asked.select("term", bucket(F.col("term"))).collect()}

    def search(self, question: str, k: int = TOP_K, where: Column | None = None, prune: bool = True) -> DataFrame:
        """The k best rows for a question's distinct terms: id, score, segment, range. Statistics are the whole collection's, whatever the filter.

        where: a condition on the collection's columns. A few small jobs run at once: how often terms occur, a row a
        term; the probed ranges' names; the k-th of their scores.
        """
        none = self.spark.createDataFrame([], "id long, score double, segment int, range long").withColumnRenamed("id", self.id_)
        terms, statistics = self.terms_of(question), self.statistics()
        if not terms or not statistics:
            return none
        own = sorted(statistics)
        n, length = (sum(x) for x in zip(*statistics.values(), strict=True))
        blocks = self.postings_of(terms, own)
        found = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        if (dropped := self.part("dropped", own)) is not None:
            found = found.unionByName(dropped.where(F.col("bucket").isin(sorted(set(terms.values()))) & F.col("term").isin(sorted(terms))).select("term", (-F.col("n")).alias("n")))
        df = {t: c for t, c in found.groupBy("term").agg(F.sum("n")).collect() if c > 0}
        if not df:
            return none
        idf = F.create_map(*(F.lit(x) for t, c in sorted(df.items()) for x in (t, math.log(1 + (n - c + 0.5) / (c + 0.5)))))
        weight = lambda tf, dl: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (length / n)))
        blocks = blocks.where(F.col("term").isin(list(df))).withColumn("idf", idf[F.col("term")])

        def scored(blocks: DataFrame, ranges: list[int] | None) -> DataFrame:
            each = blocks.select("segment", "range", "term", "idf", F.inline("held")).select("segment", "range", "term", F.col("id").alias("id_"), weight(F.col("tf"), F.col("dl")).alias("share"))
            each = self._live(each, "id_", own)
            if where is not None:
                held = self.part("documents", own).where(where)
                held = held if ranges is None else held.where(F.col("range").isin(ranges))
                each = each.join(held.select("segment", "range", F.col(self.id_).alias("id_")), ["segment", "range", "id_"], "left_semi")
            shares = each.groupBy("segment", "range", "id_").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("shares"))
            total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x["share"])
            return shares.select(F.col("id_").alias(self.id_), F.round(total, DIGITS).alias("score"), "segment", "range")

        if prune:
            bounds = blocks.groupBy("segment", "range").agg(F.sum(weight(F.col("most"), F.col("least"))).alias("bound"))
            first = bounds.orderBy(F.col("bound").desc(), "segment", "range").limit(PROBED).collect()
            some = F.lit(False)
            for r in first:
                some |= (F.col("segment") == r["segment"]) & (F.col("range") == r["range"])
            best = ranked(scored(blocks.where(some), [r["range"] for r in first]), k, self.id_).agg(F.count("*"), F.min("score")).first()
            if best[0] == k:
                enough = bounds.where(F.col("bound") >= best[1] - 10.0**-DIGITS).select("segment", "range")
                blocks = blocks.join(enough, ["segment", "range"], "left_semi")
        return ranked(scored(blocks, None), k, self.id_)

    def hybrid(self, vector: list[float], question: str | None, k: int = TOP_K, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """id, columns to keep and score: a dense leg over the collection's vectors and a sparse one from the postings, k rows each, fused; dense alone if nothing is asked."""
        near = dense(self._live(self.part("documents"), "id_"), vector, k, where, self.id_).select(self.id_, *keep, "score")
        if not question:
            return near
        said = self.rows_of(self.search(question, k, where), *keep).select(self.id_, *keep, "score")
        return fuse([near, said], k, self.id_, keep)

    def rows_of(self, hits: DataFrame, *columns: str) -> DataFrame:
        """Hits (at most k rows) with columns of the collection, read from the hits' ranges only."""
        found = [tuple(r) for r in hits.select(self.id_, "score", "segment", "range").collect()]
        documents = self.part("documents")
        few = self.spark.createDataFrame(found, hits.select(self.id_, "score", "segment", "range").schema)
        own = documents.where(F.col("range").isin(sorted({r[3] for r in found}))).select(self.id_, "segment", "range", *columns)
        return own.join(F.broadcast(few), [self.id_, "segment", "range"]).select(self.id_, "score", *columns)
