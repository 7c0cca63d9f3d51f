"""A stored vector index: rows clustered by cell, searched by many query vectors at once.

Cells are those of a spherical k-means over a sample. The table is partitioned by cell, and a search joins it with the
cells that its queries visit, so that Spark prunes all other partitions when it knows them. Rows of visited cells are
scored exactly, a batch of a cell against all queries that visit it, and a task hands on the best of each query only. Each cell has its widest angle, so that an exact search can leave out cells which hold no row that is
near enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import let
from quillstone.operators.search import TOP_K, dot

#: Cells of a collection at most, and cells that a query visits of so many.
CELLS, VISITED = 1024, 250
#: Rows that cells are fitted on, and rows of these that tell how many cells to visit.
SAMPLE, TRIED = 20_000, 200
#: Share of true neighbours that the visited cells must hold, measured over the sample.
RECALL = 0.97
#: Query vectors that are scored together.
QUERIES = 1024
#: Rows of a cell's file; a cell that holds more, by the sample, has several.
FILE_ROWS = 16_384
#: Scores are rounded to six places; what is this much below the k-th can still tie with it.
TIE = 2e-6


def unit(v: Column) -> Column:
    """The vector of length 1 in double precision; null without a length or with a component that isn't finite."""
    v = v.cast("array<double>")

    def scaled(size: Column) -> Column:
        fit = (size > 0) & ~F.isnan(size) & (size < float("inf")) & ~F.exists(v, lambda x: x.isNull())
        return F.when(fit, F.transform(v, lambda x: x / size))

    return let(F.sqrt(dot(v, v)), scaled)


@dataclass
class CellIndex:
    """The index in a folder; id_ and vector name the collection's columns."""

    spark: SparkSession
    folder: str
    id_: str = "uid"
    vector: str = "embedding"

    def build(self, rows: DataFrame, k: int = TOP_K, recall: float = RECALL, seed: int = 7) -> None:
        """Fit cells on at most SAMPLE rows, deal every row to its cell and write the table; rows without a direction are left out.

        Cells: CELLS, or one for some sixteen rows of a smaller collection. How many a query visits is measured by brute
        force over the sample for the k nearest, VISITED in CELLS at least.
        """
        held = rows.withColumn("unit", unit(F.col(self.vector))).where(F.col("unit").isNotNull())
        order = F.struct(F.xxhash64(self.id_).alias("hash"), F.col(self.id_).alias("id"))
        # ids first, so that no task gets more vectors than the sample has
        last = held.select(order.alias("o")).orderBy("o").limit(SAMPLE).agg(F.max("o").alias("last"))
        tasks = self.spark.sparkContext.defaultParallelism
        sample = held.join(F.broadcast(last), order <= F.col("last")).select(self.id_, "unit").repartition(tasks, self.id_).sortWithinPartitions(self.id_).persist()
        n = sample.count()
        if not n:
            # files of no rows, which have the columns, in a cell that no query visits
            held.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rows/cell=-1")
            self.spark.createDataFrame([], "cell int, centre array<double>, angle double, visited int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")
            return
        fitted = KMeans(k=max(1, min(CELLS, n // 16)), distanceMeasure="cosine", seed=seed, maxIter=12).fit(sample.select(array_to_vector("unit").alias("features")))
        centres = np.stack([c / np.linalg.norm(c) for c in fitted.clusterCenters() if np.linalg.norm(c) > 0])
        x = np.array(sample.select("unit").toArrow()["unit"].to_pylist())
        sample.unpersist()
        visited = max(self._visited(x, centres, k, recall), -(-len(centres) * VISITED // CELLS))
        # a large cell is dealt to several files by the rows' hash
        share = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres)) / len(x)
        files = np.maximum(1, np.ceil(share * (rows.count() / FILE_ROWS))).astype(np.int32)
        shared = self.spark.sparkContext.broadcast((centres, files))  # CELLS vectors at most
        schema = T.StructType([*held.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("files_", T.IntegerType())])
        at = held.columns.index("unit")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, files = shared.value
            for b in batches:
                near = matrix(b.column(at), centres.shape[1]) @ centres.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(near.max(axis=1, initial=-1.0)), pa.array(files[cell])], names=schema.names)

        dealt = held.mapInArrow(deal, schema)
        # a number of partitions of its own, as Spark would merge small ones and write all cells in one task
        parts = max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt.repartition(parts, "cell", F.pmod(F.xxhash64(self.id_), F.col("files_"))).drop("files_").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows")
        angles = self.rows().groupBy("cell").agg(F.acos(F.least(F.lit(1.0), F.min("near"))).alias("angle"))
        named = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        named.join(angles, "cell").withColumn("visited", F.lit(visited)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")

    @staticmethod
    def _visited(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
        q = np.arange(0, len(x), max(1, len(x) // TRIED))
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[q] @ centres.T), axis=1), axis=1)
        at = np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[top], axis=1)
        return int(np.searchsorted(np.cumsum(np.bincount(at.ravel(), minlength=len(centres))) / at.size, recall)) + 1

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def cells_of(self, queries: DataFrame) -> DataFrame:
        """query_id, direction, cell, near, angle, visited: the queries (query_id, vector) with all cells, at most CELLS each, the nearest first (place from 1)."""
        cells = self.spark.read.parquet(f"{self.folder}/cells")
        all_ = cells.agg(F.collect_list(F.struct("cell", "centre", "angle", "visited")).alias("cells"))  # one row
        asked = queries.select("query_id", unit(F.col("vector")).alias("direction")).where(F.col("direction").isNotNull())
        near = lambda c: F.struct((-dot(c["centre"], F.col("direction"))).alias("far"), c["cell"].alias("cell"), c["angle"].alias("angle"), c["visited"].alias("visited"))
        ordered = asked.crossJoin(F.broadcast(all_)).select("query_id", "direction", F.posexplode(F.sort_array(F.transform("cells", near))).alias("at", "c"))
        return ordered.select("query_id", "direction", F.col("c.cell").alias("cell"), (-F.col("c.far")).alias("near"), F.col("c.angle").alias("angle"), F.col("c.visited").alias("visited"), (F.col("at") + 1).alias("place"))

    def _scored(self, visits: DataFrame, k: int, where: Column | None, keep: tuple[str, ...]) -> DataFrame:
        """The k best rows of each query among those of the cells it visits; the queries' vectors and cells go to all tasks."""
        asked = visits.where(F.col("near").isNotNull()).groupBy("query_id").agg(F.first("direction").alias("direction"), F.collect_set("cell").alias("cells")).orderBy("query_id").toArrow()
        rows = self.rows() if where is None else self.rows().where(where)
        columns = [self.id_, *keep]
        kind = visits.schema["query_id"]
        schema = T.StructType([kind, *(rows.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
        known = self.spark.read.parquet(f"{self.folder}/cells").select("cell")
        place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), self.id_)
        out = self.spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
        for at in range(0, asked.num_rows, QUERIES):
            block = asked.slice(at, QUERIES).combine_chunks()
            visiting = visitors(block["cells"].to_pylist())
            met = rows.join(F.broadcast(known.where(F.col("cell").isin(sorted(visiting)))), "cell", "left_semi")
            shared = self.spark.sparkContext.broadcast((block["query_id"].chunk(0), np.array(block["direction"].to_pylist()), visiting))

            def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, directions, visiting = shared.value
                best = np.full((len(names), k), -np.inf)
                for b in batches:
                    v, cell = matrix(b.column(1), directions.shape[1]), b.column(0).to_numpy()
                    for c in np.unique(cell).tolist():
                        own, q = np.flatnonzero(cell == c), visiting[c]
                        s = directions[q] @ v[own].T
                        best[q] = np.partition(np.hstack([best[q], s]), len(own), axis=1)[:, len(own) :]
                        i, j = np.nonzero(s >= best[q].min(axis=1)[:, None] - TIE)
                        held = b.take(pa.array(own[j]))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q[i])), *held.columns[2:], pa.array(s[i, j])], names=schema.names)

            hits = met.select("cell", "unit", *columns).mapInArrow(nearest, schema).withColumn("score", F.round("score", 6))
            out = out.unionByName(hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
        return out

    def search(self, queries: DataFrame, k: int = TOP_K, where: Column | None = None, visited: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """query_id, rank, id, score: of each query (query_id, vector; at most QUERIES of them) the k nearest rows by cosine in the cells it visits.

        A filter is applied to the rows before they are scored. Queries without a direction, or of another dimension than
        the rows, give no rows.
        """
        visits = self.cells_of(queries).where(F.col("place") <= (F.col("visited") if visited is None else F.lit(visited)))
        return self._scored(visits, k, where, keep).select("query_id", "rank", self.id_, *keep, "score")

    def exact(self, queries: DataFrame, k: int = TOP_K, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """As search, but no neighbour is missed: after the usual cells, all whose nearest possible row reaches the k-th score are visited."""
        cells = self.cells_of(queries)
        first = self._scored(cells.where(F.col("place") <= F.col("visited")), k, where, ())
        least = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        # the smallest angle between the query and a row of the cell
        gap = F.greatest(F.lit(0.0), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("near")))) - F.col("angle"))
        wanted = cells.join(least, "query_id", "left").where(F.col("least").isNull() | (F.cos(gap) >= F.col("least") - TIE))
        return self._scored(wanted, k, where, keep).select("query_id", "rank", self.id_, *keep, "score")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch, one in a row."""
    return vectors.flatten().to_numpy().reshape(len(vectors), width)


def visitors(cells: list[list[int]]) -> dict[int, np.ndarray]:
    """For each cell the places of the queries that visit it."""
    out: dict[int, list[int]] = {}
    for i, own in enumerate(cells):
        for c in own:
            out.setdefault(c, []).append(i)
    return {c: np.array(x) for c, x in out.items()}


def dense_many(index: DataFrame, queries: DataFrame, k: int = TOP_K, where: Column | None = None, id_: str = "uid", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest rows by cosine of each query (query_id, vector), all of them, without a stored index.

    Queries go to the rows in blocks of QUERIES vectors. A task scores a batch of rows against a block by one product and
    keeps a query's k best so far; what it hands on is k rows a query, whatever it has read. Rows and queries without a
    direction, or of another dimension than the other side, give no rows. Ties go to the smaller id.
    """
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_)
    rows = index if where is None else index.where(where)
    rows = rows.select(F.col(id_).alias("id"), unit(F.col(vector)).alias("v")).where(F.col("v").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    asked = [(r["query_id"], np.array(r["v"])) for r in queries.select("query_id", unit(F.col("vector")).alias("v")).where(F.col("v").isNotNull()).orderBy("query_id").collect()]
    query_kind = queries.schema["query_id"].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"query_id {query_kind}, rank int, {id_} {kind}, score double")
    for at in range(0, len(asked), QUERIES):
        block = asked[at : at + QUERIES]
        dims = sorted({len(v) for _, v in block})
        blocks = rows.sparkSession.sparkContext.broadcast([([q for q, v in block if len(v) == d], np.stack([v for _, v in block if len(v) == d])) for d in dims])

        def nearest(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype=object)) for q, _ in blocks.value]
            for b in batches:
                ids, lengths = np.array(b.column(0).to_pylist(), dtype=object), np.asarray(pa.compute.list_value_length(b.column(1)))
                for i, (q, m) in enumerate(blocks.value):
                    if len(own := np.flatnonzero(lengths == m.shape[1])):
                        v = b.column(1).take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)
                        s = np.round(m @ v.T, 6)
                        score, name = np.hstack([held[i][0], s]), np.hstack([held[i][1], np.broadcast_to(ids[own], s.shape)])
                        held[i] = best_of(score, name, k)
            for (q, _), (score, name) in zip(blocks.value, held, strict=True):
                n = score.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([x for x in q for _ in range(n)]), pa.array(name.ravel().tolist()), pa.array(score.ravel())], names=["query_id", "id", "score"])

        hits = rows.mapInArrow(nearest, f"query_id {query_kind}, id {kind}, score double").withColumnRenamed("id", id_)
        out = out.unionByName(hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", id_, "score"))
    return out


def best_of(score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, ties to the smaller name."""
    by_name = np.argsort(name, axis=1, kind="stable")
    score, name = np.take_along_axis(score, by_name, 1), np.take_along_axis(name, by_name, 1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)


