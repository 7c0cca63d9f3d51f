"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals.

Coarse centroids deal the vectors into cells; a vector's residual to its centroid is kept as one code byte for each
group of components. A query visits the cells with the largest inner products, adds up its distance table's entries
for the codes there, and the best by that estimate are ranked again by the exact inner product of whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import column

#: At most so many vectors, those with the smallest hash of their id, fit centroids and codebooks, and no more than
#: so many bytes of them. Every row is indexed.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
CODEWORDS, GROUP, ROUNDS = 256, 4, 8
#: Rows of a cell that one task takes together; a larger cell is split into blocks.
BLOCK = 2048
RERANK = 200
#: Share of true neighbours that the probed cells must hold, as measured by brute force over the sample.
RECALL, TRIED = 0.96, 256


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


@dataclass
class Index:
    """Centroids [cells, dim] and, for each group of components, its codewords."""

    centroids: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 3) -> Index:
        rng = np.random.default_rng(seed)
        c = k_means(x, cells, ROUNDS, rng)
        residual = x - c[nearest(x, c)]
        parts = [slice(i, min(i + GROUP, x.shape[1])) for i in range(0, x.shape[1], GROUP)]
        return cls(c, [k_means(np.ascontiguousarray(residual[:, p]), CODEWORDS, ROUNDS, rng) for p in parts], parts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        residual = x - self.centroids[cell]
        return cell, np.stack([nearest(np.ascontiguousarray(residual[:, p]), b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each group the inner products of queries and codewords [queries, codewords]."""
        return [q[:, p] @ b.T for p, b in zip(self.parts, self.books, strict=True)]


    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, k: int, recall: float) -> int:
        """Cells to visit so that, over the sample x, they hold that share of the k nearest by brute force.

        Among more rows the k nearest lie closer to the query and in fewer cells, so that the share is a lower one.
        """
        q = np.arange(0, len(x), max(1, len(x) // TRIED))
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(x[q] @ self.centroids.T), axis=1, kind="stable"), axis=1)
        at = np.take_along_axis(order, nearest(x, self.centroids)[top], axis=1)
        found = np.cumsum(np.bincount(at.ravel(), minlength=len(self.centroids))) / at.size
        return int(np.searchsorted(found, recall)) + 1


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=values.dtype)


def usable(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int, int]:
    """Ids and vectors as array<double>, without those that are null, zero, of another length than most, or hold a null or non-finite component; how many, and their length."""
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(column(id_).alias("id"), column(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    dim = rows.agg(F.mode(F.size("vector"), True).alias("d"), F.count("*").alias("n")).first()
    return rows.where(F.size("vector") == F.lit(dim["d"] or 0)), int(dim["n"]), int(dim["d"] or 0)


def nearest_neighbours(df: DataFrame, is_query, k: int = 20, probes: int | None = None, rerank: int = RERANK, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, its k nearest other rows.

    is_query: a Column function of the id. Nearest: largest inner product in double precision; ties to the smaller
    id. Rows with unusable vectors (see usable) take no part. Rows that repeat an id are no neighbours of one another;
    such an id asks with the smallest of its vectors (component by component), and as a neighbour it is listed once
    for each of its vectors that is near enough. Other columns are dropped; an empty table gives no rows. A query visits probes cells (by default
    as many as the recall on the sample takes), or more until they hold k other rows. A cell of any size is split into
    blocks of bounded size, each searched by itself, and each block hands on at most k rows for a query.
    """
    spark = df.sparkSession
    rows, n, dim = usable(df, id_, vector)
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    sample = matrix(rows.orderBy(F.xxhash64("id"), "id", "vector").limit(min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dim)))).select("vector").toArrow()["vector"]).copy()
    index = Index.fit(sample, min(4096, max(64, round(math.sqrt(n) / 4))))
    probes = probes or index.probes(sample, k, RECALL)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes = shared.value.encode(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "cell", "codes"])

    listed = rows.mapInArrow(assign, "id long, vector array<double>, cell int, codes binary")
    # one row for each of at most 4096 cells
    sizes = {r["cell"]: r["count"] for r in listed.groupBy("cell").count().collect()}
    held = np.array([sizes.get(c, 0) for c in range(len(index.centroids))])
    blocks = np.maximum(1, -(-held // BLOCK))
    shared_sizes = spark.sparkContext.broadcast((held, blocks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, id_of = b.column(2).to_numpy(), b.column(0).to_numpy()
            mixed = (id_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((mixed % shared_sizes.value[1][cell].astype(np.uint64)).astype(np.int32))], names=["id", "vector", "cell", "codes", "block"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = shared_sizes.value
        for b in batches:
            if not b.num_rows:
                continue
            near = matrix(b.column(1)) @ shared.value.centroids.T
            of, cells, parts = [], [], []
            for i, row in enumerate(np.argsort(-near, axis=1, kind="stable")):
                enough = int(np.searchsorted(np.cumsum(held[row]), k + 1)) + 1
                for c in row[: max(probes, enough)]:
                    if held[c]:
                        of += [i] * int(blocks[c])
                        cells += [c] * int(blocks[c])
                        parts += range(int(blocks[c]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), b.column(1).take(pa.array(of, pa.int64())), pa.array(cells, pa.int32()), pa.array(parts, pa.int32())], names=["id", "vector", "cell", "block"])

    def search(index_rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index_rows.num_rows and queries.num_rows:
            ids = index_rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(index_rows["vector"])[order]
            codes = np.frombuffer(b"".join(index_rows["codes"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            centre = shared.value.centroids[index_rows["cell"][0].as_py()]
            q_ids, q = queries["id"].to_numpy(), matrix(queries["vector"])
            # what the codes leave out of an inner product, typically: vectors this close by estimate are told apart exactly
            blur = np.sqrt(((x - shared.value.decode(index_rows["cell"][0].as_py(), codes)) ** 2).mean())
            for at in range(0, len(q), 64):
                some, own = q[at : at + 64], q_ids[at : at + 64]
                guess = np.repeat((some @ centre)[:, None], len(ids), axis=1)
                for j, t in enumerate(shared.value.tables(some)):
                    guess += t[:, codes[:, j]]
                guess[ids[None, :] == own[:, None]] = -np.inf
                if len(ids) > rerank:
                    least = np.partition(guess, len(ids) - rerank, axis=1)[:, len(ids) - rerank] - blur * np.linalg.norm(some, axis=1)
                else:
                    least = np.full(len(some), np.finfo(float).min)
                for i, (vector, id_) in enumerate(zip(some, own, strict=True)):
                    best = np.flatnonzero(guess[i] >= least[i])
                    exact = x[best] @ vector
                    top = np.lexsort((ids[best], -exact))[:k]
                    found.append((np.full(len(top), id_), ids[best[top]], exact[top]))
        joined = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    dealt = listed.mapInArrow(place, "id long, vector array<double>, cell int, codes binary, block int")
    asked = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector")).mapInArrow(visit, "id long, vector array<double>, cell int, block int")
    hits = dealt.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    place_ = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(place_)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
