"""Queries over stored indexes. An index of a folder's tables is made at the first call of an application and then searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.operators.cells import CellIndex, dense_many
from quillstone.operators.fuzzy import TrigramIndex
from quillstone.operators.postings import SparseIndex
from quillstone.plans.adapters import INDEX, files, live, sparse_index, table, vector_index
from quillstone.plans.catalog import FILE_FILTER
from quillstone.plans.filters import ID_LIKE, WORD_LIKE
from quillstone.plans.records import VECTORS, vectors
from quillstone.plans.registry import query, sql_of
from quillstone.plans.search import TERMS, legs, question, word_similarity_sql
from quillstone.sources.keyed import KeyedTable
from quillstone.sources.shared import fresh, once


def cell_index(spark, sf_dir) -> CellIndex:
    return CellIndex(spark, once(spark, "cells", sf_dir, lambda folder: CellIndex(spark, folder).build(vector_index(spark, sf_dir).drop("text"), 20)))


def asked(spark, sf_dir, n=50):
    """The first n embeddings as queries."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def many(n: int, k: int, where: str = "true") -> str:
    """The k nearest rows of each of n queries, by all pairs."""
    return f"""SELECT query_id, (row_number() OVER w)::INTEGER AS rank, uid, score FROM (
  SELECT q.vec_id AS query_id, uid, round(list_cosine_similarity(idx.embedding, q.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN idx ON q.vec_id < {n} AND {where})
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, uid) QUALIFY rank <= {k}"""


@query(f"WITH {INDEX}, {TERMS} SELECT uid, score FROM bm ORDER BY score DESC, uid LIMIT 20")
def stored_bm25_topk(spark, sf_dir):
    return sparse_index(spark, sf_dir).search(question(spark, sf_dir), 20).select("uid", "score")


@query(f"WITH {INDEX}, {TERMS} SELECT b.uid, b.score, i.file_uid, i.tags[1] AS lang FROM bm b JOIN idx i USING (uid) WHERE list_has_any(i.tags, ['fr', 'de']) ORDER BY b.score DESC, b.uid LIMIT 15")
def stored_bm25_filtered(spark, sf_dir):
    """Rows of two languages; statistics stay those of the whole collection."""
    index = sparse_index(spark, sf_dir)
    hits = index.search(question(spark, sf_dir), 15, F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("de"))))
    return index.rows_of(hits, "file_uid", "tags").select("uid", "score", "file_uid", F.col("tags")[0].alias("lang"))


@query(f"""WITH {INDEX.replace("d.text", "CASE WHEN e.vec_id % 4 = 1 THEN upper(d.text) || ' ' || d.source ELSE d.text END AS text").replace("d.doc_id = e.vec_id", "d.doc_id = e.vec_id WHERE e.vec_id % 5 <> 0")}, {TERMS}
SELECT uid, score FROM bm ORDER BY score DESC, uid LIMIT 20""")
def stored_bm25_updated(spark, sf_dir):
    """An index of two thirds of the rows, to which the others are added; every fifth row is removed and every fourth written anew."""
    rows = vector_index(spark, sf_dir)
    index = SparseIndex(spark, fresh(spark, "postings"))
    index.add(rows.where("uid % 3 < 2"))
    index.add(rows.where("uid % 3 = 2"))
    anew = rows.where("uid % 4 = 1 and uid % 5 <> 0").withColumn("text", F.concat(F.upper("text"), F.lit(" "), F.col("tags")[1]))
    index.add(anew, rows.where("uid % 4 = 1 or uid % 5 = 0").select("uid"))
    return index.search(question(spark, sf_dir), 20).select("uid", "score")


@query(f"WITH {INDEX} {many(50, 10)}")
def dense_many_topk(spark, sf_dir):
    """Fifty query vectors at once over all rows."""
    return dense_many(vector_index(spark, sf_dir), asked(spark, sf_dir), 10)


@query(f"WITH {INDEX} {many(50, 10, chr(39) + 'en' + chr(39) + ' = ANY(tags)')}")
def cell_search_exact(spark, sf_dir):
    """Fifty query vectors against the stored cells, with a filter; cells that can't hold a neighbour are left out."""
    return cell_index(spark, sf_dir).exact(asked(spark, sf_dir), 10, F.array_contains("tags", "en"))


@query()
def cell_search(spark, sf_dir):
    """Fifty query vectors in the cells that they visit; a test holds the recall against dense_many_topk."""
    return cell_index(spark, sf_dir).search(asked(spark, sf_dir), 10)


@query(f"WITH {INDEX}, {TERMS}, {legs(20)} SELECT uid, f.score, file_uid FROM fused f JOIN idx USING (uid)")
def hybrid_stored(spark, sf_dir):
    """Both legs from stored indexes."""
    near = cell_index(spark, sf_dir).exact(asked(spark, sf_dir, 1), 20, keep=("file_uid",)).select("uid", "file_uid", "score")
    index = sparse_index(spark, sf_dir)
    said = index.rows_of(index.search(question(spark, sf_dir), 20), "file_uid").select("uid", "file_uid", "score")
    return S.fuse([near, said], 20, keep=("file_uid",))


def trigram_index(spark, sf_dir) -> TrigramIndex:
    return TrigramIndex(spark, once(spark, "trigrams", sf_dir, lambda folder: TrigramIndex(spark, folder).build(live(files(spark, sf_dir)).select("uid", "id", "display_name", "aliases", "process_status"))))


@query(sql_of("filter_fuzzy"))
def filter_fuzzy_indexed(spark, sf_dir):
    """As filter_fuzzy, asked of rows that share enough trigrams with the query only."""
    text = "reprt 41"
    found = trigram_index(spark, sf_dir).matching(FILE_FILTER.compile(f'q = "{text}"'), text, {"display_name": WORD_LIKE, "id": ID_LIKE}, ("display_name", "id"))
    return found.select("uid", "display_name")


@query(f"WITH p AS (SELECT p_partkey AS uid, p_name FROM part) SELECT uid, p_name, round(score, 6) AS score FROM {word_similarity_sql('smal widgt', 'p_name', 'p')} JOIN p USING (uid) WHERE round(score, 6) >= 0.45")
def fuzzy_names_indexed(spark, sf_dir):
    """Parts whose name has a stretch like a misspelt query."""
    folder = once(spark, "names", sf_dir, lambda folder: TrigramIndex(spark, folder, ("p_name",)).build(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), "p_name")))
    return TrigramIndex(spark, folder, ("p_name",)).search("smal widgt", "p_name", 0.45).select("uid", "p_name", "score")


def keyed_vectors(spark, sf_dir) -> KeyedTable:
    held = KeyedTable(spark, fresh(spark, "vectors"), ("uid",), 16)
    held.create(vectors(spark, sf_dir))
    return held


@query(f"WITH {VECTORS} SELECT uid, file_uid, CASE WHEN uid % 50 IN (3, 13) THEN 'changed' ELSE 'text ' || uid END AS text FROM vec UNION ALL SELECT -1 - uid, file_uid, 'new' FROM vec WHERE uid % 50 = 13")
def keyed_upsert(spark, sf_dir):
    """Rows written over and new ones, in a table of which only their buckets are rewritten."""
    held = keyed_vectors(spark, sf_dir)
    v = vectors(spark, sf_dir)
    held.upsert(v.where("uid % 50 in (3, 13)").withColumn("text", F.lit("changed")).unionByName(v.where("uid % 50 = 13").withColumn("uid", -1 - F.col("uid")).withColumn("text", F.lit("new"))))
    return held.read().select("uid", "file_uid", "text")


@query(f"WITH {VECTORS} SELECT uid, CASE file_uid WHEN 'f-00000003' THEN 'new|x' ELSE tags END AS tags FROM vec WHERE file_uid NOT IN ('f-00000004', 'f-00000007')")
def keyed_retag_and_delete(spark, sf_dir):
    """The vectors of one file get other tags, those of two others go."""
    held = keyed_vectors(spark, sf_dir)
    held.update(F.col("file_uid") == "f-00000003", {"tags": F.array(F.lit("new"), F.lit("x"))})
    held.delete(F.col("file_uid").isin("f-00000004", "f-00000007"))
    return held.read().select("uid", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {VECTORS} SELECT uid, file_uid FROM vec")
def insert_embeddings(spark, sf_dir):
    """A collection of the even rows, to which the odd ones are appended."""
    v = vectors(spark, sf_dir)
    held = KeyedTable(spark, fresh(spark, "vectors"), ("uid",), 16)
    held.create(v.where("uid % 2 = 0"))
    held.append(v.where("uid % 2 = 1"))
    return held.read().select("uid", "file_uid")


@query(f"WITH {VECTORS} SELECT uid, tags, 'there, gone, there' AS life FROM vec WHERE uid % 3 = 0")
def collection_life(spark, sf_dir):
    """A collection is made, dropped, and made anew of other rows; each time it is asked whether it is there."""
    held, life = keyed_vectors(spark, sf_dir), []
    for change in (lambda: None, held.drop, lambda: held.create(vectors(spark, sf_dir).where("uid % 3 = 0"))):
        change()
        life.append("there" if held.exists() else "gone")
    return held.read().select("uid", F.array_join("tags", "|").alias("tags"), F.lit(", ".join(life)).alias("life"))


@query(f"WITH {INDEX}, s AS (SELECT uid, file_uid, round(list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM idx), t AS (SELECT * FROM s ORDER BY score DESC, uid LIMIT 5) SELECT uid, file_uid, score FROM t QUALIFY row_number() OVER (PARTITION BY file_uid ORDER BY score DESC, uid) <= 1")
def search_defaults(spark, sf_dir):
    """A number of hits and a group size of zero stand for five and one."""
    near = cell_index(spark, sf_dir).exact(asked(spark, sf_dir, 1), S.asked_for(0), keep=("file_uid",))
    return S.first_of_each(near, "file_uid", 0).select("uid", "file_uid", "score")
