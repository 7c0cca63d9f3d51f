"""Hard negatives by distributed radix selection.

An anchor's positives are its best rows of the same label; for each of them, rows of another label whose score lies
between two shares of the positive's score are its window, of which the best few are wanted. Scores are integers, so
that the last wanted score of a window is found digit by digit: blocks of rows count how many of their scores begin
with the digits known so far and go on with each next digit, the counts are added up, and the sum says which digit the
wanted score goes on with. When all digits are known, only rows at or above that score are gathered.

Rows and anchors are dealt to blocks of bounded size, and every block of anchors meets every block of rows once a pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.ann import matrix
from quillstone.llm.batches import written
from quillstone.llm.common import column, shuffle_partitions

#: Rows of a block, and bytes of its vectors, at most; fewer rows where the table would else make too few blocks to share out.
BLOCK, BLOCK_BYTES, LEAST = 4096, 4 << 20, 256
#: Anchors whose scores are held at once.
SLICE = 128
#: Bits of a digit.
DIGIT = 8


def integer_rows(df: DataFrame, id_: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int, int]:
    """id, label and x (floor(scale * component), longs) of the rows that take part, one for each id; at most how many, and their length."""
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(column(id_).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    of = rows.agg(F.mode(F.size("vector"), True).alias("dim"), F.count("*").alias("n")).first()
    rows = rows.where(F.size("vector") == F.lit(of["dim"] or 0)).select("id", "label", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))).alias("x"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("of")).select("id", "of.label", "of.x")
    return one, int(of["n"]), int(of["dim"] or 0)


def dealt(rows: DataFrame, n: int, dim: int, name: str) -> tuple[DataFrame, int]:
    """One row for each block: its number (name), kind 0, ids, labels and vectors as bytes; and how many numbers there are."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))
    blocks = max(1, -(-n // size), min(shuffle_partitions(rows.sparkSession), -(-n // LEAST)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = matrix(t["x"]).astype("<i8")
        return pa.table({name: t[name][:1], "kind": pa.array([0], pa.int32()), "ids": [t["id"].to_numpy().astype("<i8").tobytes()], "labels": [t["label"].to_numpy().astype("<i8").tobytes()], "x": [x.tobytes()]})

    number = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return written(rows.withColumn(name, number).groupBy(name).applyInArrow(pack, f"{name} int, kind int, ids binary, labels binary, x binary")), blocks


def numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i8")


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly; an error where they might not fit a long."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if most >= 1 << 63 or min(a.min(initial=0), x.min(initial=0)) == np.iinfo(np.int64).min:
        raise OverflowError("scores of these vectors don't fit a 64-bit integer")
    if most < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def meetings(rows: DataFrame, n_rows: int, asks: DataFrame, n_asks: int, work: Callable, *names: str) -> DataFrame:
    """Rows of longs under these names, which work gives for each pair of blocks.

    work takes the anchors' ids and labels, their windows, the rows' ids and labels, and each anchor's place and scores.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in left.to_pylist():
            ids, labels = numbers(block["ids"]), numbers(block["labels"])
            x = numbers(block["x"]).reshape(len(ids), -1)
            of = {k: [r for r in right.to_pylist() if r["kind"] == k] for k in (0, 1)}
            for ask in of[0]:
                a_ids, a_labels = numbers(ask["ids"]), numbers(ask["labels"])
                a = numbers(ask["x"]).reshape(len(a_ids), -1)

                def scores(a=a, x=x) -> Iterator[tuple[int, np.ndarray]]:
                    for at in range(0, len(a), SLICE):
                        for i, s in enumerate(products(a[at : at + SLICE], x)):
                            yield at + i, s

                out += work(a_ids, a_labels, numbers(of[1][0]["x"]).reshape(-1, 6) if of[1] else np.zeros((0, 6), np.int64), ids, labels, scores())
        return pa.table({name: pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k, name in enumerate(names)})

    left = rows.withColumn("anchors", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    right = asks.withColumn("rows", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    return left.groupBy("rows", "anchors").cogroup(right.groupBy("rows", "anchors")).applyInArrow(meet, ", ".join(f"{name} long" for name in names))


def best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids; ids rise."""
    if len(s) > k:
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        near = np.arange(len(s))
    return near[np.lexsort((ids[near], -s[near]))[:k]]


def own_label(k: int) -> Callable:
    """Each anchor's k best other rows of its label in a block: anchor_id, positive_id, positive_score."""

    def work(a_ids, a_labels, _, ids, labels, scores) -> list[tuple]:
        out = []
        for i, s in scores:
            same = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
            top = same[best(ids[same], s[same], k)]
            out.append((np.full(len(top), a_ids[i]), ids[top], s[top]))
        return out

    return work


#: Columns of a window as packed: anchor, positive, its least and greatest score, the digits known so far, how many rows below them are wanted.
WINDOW = ("anchor_id", "positive_id", "low", "high", "known", "left")


def in_windows(a_ids, a_labels, windows, ids, labels, scores) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each window, with the ids of its rows in a block and their places: 0 is the window's greatest score."""
    windows = windows[np.argsort(windows[:, 0], kind="stable")]
    starts, ends = np.searchsorted(windows[:, 0], a_ids), np.searchsorted(windows[:, 0], a_ids, side="right")
    for i, s in scores:
        if starts[i] < ends[i]:
            own = windows[starts[i] : ends[i]]
            some = np.flatnonzero((s >= own[:, 2].min()) & (s <= own[:, 3].max()) & (labels != a_labels[i]))
            if len(some):
                for w in own:
                    place = w[3] - s[some]
                    fit = (place >= 0) & (s[some] >= w[2])
                    if fit.any():
                        yield w, ids[some[fit]], place[fit]


def histogram(shift: int) -> Callable:
    """Of each window's rows in a block whose higher digits are the known ones: how many have each next digit.

    Digits after the one that completes the wanted number are left out: the wanted score can't have them.
    """

    def work(*block) -> list[tuple]:
        out = []
        for w, _, place in in_windows(*block):
            digit, n = np.unique((place >> shift)[place >> (shift + DIGIT) == w[4]], return_counts=True)
            upto = int(np.searchsorted(np.cumsum(n), w[5])) + 1
            digit, n = digit[:upto], n[:upto]
            out.append((np.full(len(digit), w[0]), np.full(len(digit), w[1]), digit, n))
        return out

    return work


def gather(*block) -> list[tuple]:
    """Each window's rows in a block above the last wanted score, and of those that have it as many as are still wanted."""
    out = []
    for w, ids, place in in_windows(*block):
        above, at = place < w[4], np.sort(ids[place == w[4]])[: w[5]]
        found = np.concatenate([ids[above], at])
        out.append((np.full(len(found), w[0]), np.full(len(found), w[1]), found, w[3] - np.concatenate([place[above], np.full(len(at), w[4])])))
    return out


def hard_negatives(
    df: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (is_anchor, a function of the id) and each of its `positives` best other rows of the same label: the
    k best rows of another label whose score is at least low and at most high hundredths of the positive's. A score is
    the inner product of the components floor(scale * x), as integers; ties go to the smaller id. Rows without id, label
    or vector, with a null or non-finite component, or with another number of components than most take no part. Of rows
    that repeat an id one takes part, that of the least label, then the least vector. Scores beyond 64 bits are an error.
    A positive without negatives, a label of one row and an empty table give no rows. Other columns are dropped.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    all_rows, n, dim = integer_rows(df, id_, vector, label, scale)
    if not n or not dim:
        return spark.createDataFrame([], schema)
    rows, n_rows = dealt(all_rows, n, dim, "rows")
    asking = all_rows.where(is_anchor(F.col("id")))
    anchors, n_anchors = dealt(asking, asking.count(), dim, "anchors")
    found = meetings(rows, n_rows, anchors, n_anchors, own_label(positives), "anchor_id", "positive_id", "positive_score")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    score = F.col("positive_score")
    pairs = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place")
    # floor and ceiling of whole hundredths, for scores of either sign
    pairs = pairs.withColumn("low", F.expr(f"positive_score * {low} div 100") + ((score * low % 100) > 0).cast("long")).withColumn("high", F.expr(f"positive_score * {high} div 100") - ((score * high % 100) < 0).cast("long"))
    windows = written(pairs.where(F.col("low") <= F.col("high")).withColumn("known", F.lit(0).cast("long")).withColumn("left", F.lit(k).cast("long")))

    def asked(windows: DataFrame) -> DataFrame:
        def pack(t: pa.Table) -> pa.Table:
            blob = np.stack([t[c].to_numpy() for c in WINDOW], axis=1).astype("<i8").tobytes()
            return pa.table({"anchors": t["anchors"][:1], "kind": pa.array([1], pa.int32()), "x": [blob]})

        packed = windows.withColumn("anchors", F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchors)).cast("int")).groupBy("anchors").applyInArrow(pack, "anchors int, kind int, x binary")
        return anchors.unionByName(packed, allowMissingColumns=True)

    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    for level in reversed(range(math.ceil((widest or 0).bit_length() / DIGIT))):
        counts = meetings(rows, n_rows, asked(windows), n_anchors, histogram(level * DIGIT), "anchor_id", "positive_id", "digit", "n")
        sums = counts.groupBy("anchor_id", "positive_id", "digit").agg(F.sum("n").alias("n"))
        # few rows a window: no block tells more digits than rows are wanted
        own = Window.partitionBy("anchor_id", "positive_id").orderBy("digit")
        sums = sums.withColumn("before", F.sum("n").over(own) - F.col("n")).withColumn("last", F.lead("digit").over(own).isNull())
        windows = windows.join(sums, ["anchor_id", "positive_id"]).where((F.col("before") < F.col("left")) & ((F.col("before") + F.col("n") >= F.col("left")) | F.col("last")))
        windows = written(windows.select("anchor_id", "positive_id", "positive_score", "low", "high", F.col("digit").alias("known"), (F.col("left") - F.col("before")).alias("left")))
    hits = meetings(rows, n_rows, asked(windows), n_anchors, gather, "anchor_id", "positive_id", "negative_id", "negative_score")
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(windows.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), lambda i: i % 50 == 0)


OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.id <> b.id WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY rank <= 3
"""
