"""Retrieval: exact dense search, BM25, reciprocal rank fusion, grouping by file, entity hops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25's parameters, the fusion constant, the default number of hits.
K1, B, FUSION, TOP_K = 1.2, 0.75, 60, 5
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; a CJK run is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def asked_for(k: int | None) -> int:
    """The number of hits; none or less than one: the default."""
    return k if k and k > 0 else TOP_K


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size > 0, size)


def ranked(hits: DataFrame, k: int, id_: str = "uid") -> DataFrame:
    """The k best by score, ties to the smaller id; a sort limited to k rows in each partition first."""
    return hits.orderBy(F.col("score").desc(), id_).limit(k)


def dense(index: DataFrame, vector: list[float], k: int = TOP_K, where: Column | None = None, id_: str = "uid") -> DataFrame:
    """The k nearest rows of an index by cosine, filtered before they are scored."""
    rows = index if where is None else index.where(where)
    v = F.array(*(F.lit(float(x)) for x in vector))
    scored = rows.withColumn("score", F.round(cosine(F.col("embedding").cast("array<double>"), v), 6))
    return ranked(scored.where(F.col("score").isNotNull()), k, id_)


def postings(index: DataFrame, id_: str = "uid", text: str = "text") -> DataFrame:
    """id, term, tf, dl: what a sparse index holds; partial sums are made before the shuffle."""
    rows = index.select(id_, tokens(F.col(text)).alias("terms"))
    return rows.select(id_, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy(id_, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, question: str, k: int = TOP_K, where: Column | None = None, id_: str = "uid", text: str = "text") -> DataFrame:
    """The k best rows for a question's distinct terms, with all their columns. Statistics are the whole collection's, whatever the filter.

    One pass counts rows, lengths and, for each asked term, the rows that hold it: a few numbers, as many as the
    question has terms. The second pass scores each row by itself and keeps k rows a partition. Nothing is shuffled
    but the counts.
    """
    asked = [r[0] for r in index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(question))))).collect()]
    if not asked:
        return index.withColumn("score", F.lit(0.0)).limit(0)

    def with_hits(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("terms_", tokens(F.coalesce(F.col(text), F.lit(""))))
        return rows.withColumn("dl_", F.size("terms_")).withColumn("hits_", F.filter("terms_", lambda x: x.isin(*asked))).drop("terms_")

    one = lambda term, n: F.struct(term.alias("term"), n.cast("long").alias("n"))
    counted = with_hits(index.select(text)).select(F.explode(F.concat(F.array(one(F.lit(""), F.col("dl_"))), F.transform(F.array_distinct("hits_"), lambda t: one(t, F.lit(1))))).alias("x"))
    found = {r[0]: (r[1], r[2]) for r in counted.groupBy("x.term").agg(F.count("*"), F.sum("x.n")).collect()}
    n, length = found.pop("", (0, 0))
    if not found:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    idf = F.create_map(*(F.lit(x) for t, (df, _) in sorted(found.items()) for x in (t, math.log(1 + (n - df + 0.5) / (df + 0.5)))))
    scored = with_hits(index if where is None else index.where(where)).where(F.size("hits_") > 0)
    weight = lambda tf: tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl_") / (length / n)))
    share = lambda t: idf[t] * weight(F.size(F.filter("hits_", lambda x: x == t)))
    total = F.aggregate(F.transform(F.array_sort(F.array_distinct("hits_")), share), F.lit(0.0), lambda a, x: a + x)
    return ranked(scored.withColumn("score", F.round(total, 6)).drop("hits_", "dl_"), k, id_)


def fuse(legs: list[DataFrame], k: int = TOP_K, id_: str = "uid", keep: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: each leg has at most k ranked rows; score is the sum of 1 / (60 + rank). keep: columns that a row has in every leg."""
    place = Window.orderBy(F.col("score").desc(), id_)  # over the k rows of a leg
    ranks = [leg.select(id_, *keep, "score").withColumn("rank", F.row_number().over(place)).select(id_, *keep, (1 / (FUSION + F.col("rank"))).alias("share")) for leg in legs]
    joined = ranks[0]
    for r in ranks[1:]:
        joined = joined.unionByName(r)
    return ranked(joined.groupBy(id_, *keep).agg(F.round(F.sum("share"), 6).alias("score")), k, id_)


def hybrid(index: DataFrame, vector: list[float], question: str | None, k: int = TOP_K, where: Column | None = None, id_: str = "uid", keep: tuple[str, ...] = ()) -> DataFrame:
    """Dense and BM25 legs of k rows each, fused; dense alone if the index has no text or nothing is asked."""
    near = dense(index, vector, k, where, id_)
    if not question or "text" not in index.columns:
        return near.select(id_, *keep, "score")
    return fuse([near, bm25(index, question, k, where, id_)], k, id_, keep)


def collection(spark, folder: str, schema: str) -> DataFrame:
    """A stored index; one that isn't there is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(folder) if there else spark.createDataFrame([], schema)


def first_of_each(hits: DataFrame, group: str, size: int = 1, id_: str = "uid") -> DataFrame:
    """Of ranked rows the first `size` of each group (0 or less: 1)."""
    place = Window.partitionBy(group).orderBy(F.col("score").desc(), id_)
    return hits.withColumn("in_group", F.row_number().over(place)).where(F.col("in_group") <= max(1, size)).drop("in_group")


def dense_by_group(index: DataFrame, vector: list[float], k: int, size: int, group: str = "file_uid", id_: str = "uid") -> DataFrame:
    """Native grouping: the limit counts groups, each shown by its best `size` rows."""
    v = F.array(*(F.lit(float(x)) for x in vector))
    scored = index.withColumn("score", F.round(cosine(F.col("embedding").cast("array<double>"), v), 6)).where(F.col("score").isNotNull())
    few = first_of_each(scored, group, size, id_)
    best = few.groupBy(group).agg(F.max("score").alias("best")).orderBy(F.col("best").desc(), group).limit(k).select(group)
    return few.join(F.broadcast(best), group, "left_semi")  # k rows


def entity_hop(links: DataFrame, seeds: list) -> DataFrame:
    """Files that share an entity with the seed files, without the seeds."""
    mine = links.where(F.col("file_uid").isin(*seeds)).select("entity_uid").distinct()
    return links.join(mine, "entity_uid", "left_semi").where(~F.col("file_uid").isin(*seeds)).select("file_uid").distinct()
