"""Queries from search hits to chunk rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import said_query
from quillstone.operators import results as V
from quillstone.operators import search as S
from quillstone.plans.adapters import CHUNKS, FILES, chunks, files, table
from quillstone.plans.records import VECTORS, vectors
from quillstone.plans.registry import query

#: Chunks with the places that they are cited by: every third one has a time, every third a page.
PLACED = f"""{CHUNKS}, placed AS (SELECT *, in_order * 10 AS start_pos, in_order * 10 + 9 AS end_pos, CASE WHEN in_order % 3 = 1 THEN in_order * 1000 ELSE 0 END AS from_ms, 0 AS to_ms,
  CASE WHEN in_order % 3 = 2 THEN in_order ELSE 0 END AS page, CASE WHEN in_order % 3 = 2 THEN in_order + 1 ELSE 0 END AS last_page FROM chunks)"""
HITS = "hits AS (SELECT 'c-' || vec_id || '-' || (vec_id % 4) AS uid, round(1.0::DOUBLE / (60 + vec_id), 6) AS score, CASE WHEN vec_id % 10 = 9 THEN 'converted_file' ELSE 'chunk' END AS source_table FROM embeddings WHERE vec_id < 60)"


def placed(spark, sf_dir):
    n = F.col("in_order")
    return chunks(spark, sf_dir).withColumns({
        "start_pos": n * 10, "end_pos": n * 10 + 9, "from_ms": F.when(n % 3 == 1, n * 1000).otherwise(0), "to_ms": F.lit(0),
        "page": F.when(n % 3 == 2, n).otherwise(0), "last_page": F.when(n % 3 == 2, n + 1).otherwise(0),
    })


@query(f"""WITH {FILES}, {PLACED}, {HITS} SELECT h.score, 'namespaces/ns/knowledge-bases/kb/files/' || f.id || '/chunks/' || c.uid AS name, c.chunk_type AS type, c.tokens, c.start_pos AS start, c.end_pos AS end_,
  CASE WHEN from_ms <> 0 THEN 'TIME_MS' WHEN page <> 0 THEN 'PAGE' END AS unit, CASE WHEN from_ms <> 0 THEN from_ms WHEN page <> 0 THEN page END AS first, CASE WHEN from_ms <> 0 THEN 0 WHEN page <> 0 THEN last_page END AS last, md5(c.text) AS body, 'RANKER_RRF' AS ranker
  FROM hits h JOIN placed c ON c.uid = h.uid JOIN live f ON f.uid = c.file_uid WHERE h.source_table = 'chunk' AND c.retrievable AND c.doc_id % 11 <> 5""")
def search_results(spark, sf_dir):
    """Hits as chunk rows: other sources, chunks that aren't retrievable, deleted files and missing blobs are skipped after the ranking."""
    i = F.col("vec_id")
    hits = table(spark, sf_dir, "embeddings").where("vec_id < 60").select(F.concat_ws("-", F.lit("c"), i, i % 4).alias("source_uid"), F.round(1 / (60 + i), 6).alias("score"), F.when(i % 10 == 9, "converted_file").otherwise("chunk").alias("source_table"))
    held = placed(spark, sf_dir)
    blobs = held.select("uid", F.when(F.col("doc_id") % 11 != 5, F.col("text")).alias("content"))
    out = V.hydrated(hits, held, files(spark, sf_dir), blobs, "ns", "kb")
    return out.select("score", "name", "type", "tokens", F.col("markdown_reference.start").alias("start"), F.col("markdown_reference.end").alias("end_"), F.col("reference.unit").alias("unit"), F.col("reference.start").alias("first"), F.col("reference.end").alias("last"), F.md5("body").alias("body"), "ranker")


@query(f"WITH {VECTORS} SELECT uid FROM vec WHERE file_uid IN ('f-00000003', 'f-00000006', 'f-00000012') AND file_type = 'TYPE_PDF' AND content_type = 'document' AND tags IN ('label-0', 'label-1', 'label-2', 'label-3')")
def vector_scalar_filter(spark, sf_dir):
    index = vectors(spark, sf_dir)
    where = V.hit_filter(index, ["f-00000003", "f-00000006", "f-00000012", V.NIL], "TYPE_PDF", V.media_type("TYPE_DOCUMENT"), tags=["label-0", "label-1", "label-2", "label-3"])
    return index.where(where).select("uid")


@query(f"WITH {VECTORS} SELECT uid FROM vec WHERE file_uid IN ('f-00000003', 'f-00000006')")
def vector_filter_by_name(spark, sf_dir):
    """An index without the files' uids is filtered by their names."""
    index = vectors(spark, sf_dir).withColumnRenamed("file_uid", "file_name")
    return index.where(V.hit_filter(index, ["uid-3", "uid-6"], file_names=["f-00000003", "f-00000006"])).select("uid")


@query(f"WITH {VECTORS} SELECT uid FROM vec WHERE content_type = 'image'")
def nil_uids_are_no_filter(spark, sf_dir):
    index = vectors(spark, sf_dir)
    return index.where(V.hit_filter(index, [V.NIL, V.NIL], content_type="image")).select("uid")


@query(f"WITH {CHUNKS} SELECT uid, kb_uid FROM chunks WHERE chunk_type = 'TYPE_SUMMARY' AND file_uid IN ('f-00000003', 'f-00000006', 'f-00000010')")
def chunk_type_filter(spark, sf_dir):
    index = chunks(spark, sf_dir)
    where = V.hit_filter(index, ["f-00000003", "f-00000006", "f-00000010"], content_type=V.media_type("TYPE_UNSPECIFIED"), chunk=V.chunk_type("TYPE_SUMMARY"))
    return index.where(where).select("uid", "kb_uid")


@query(f"WITH {FILES}, {VECTORS} SELECT v.uid FROM vec v JOIN files f ON f.uid = v.file_uid WHERE f.doc_id IN (1, 2)")
def search_known_files(spark, sf_dir):
    """Ids of files, one of which isn't known: the search is narrowed to the others."""
    ids = [f"file-{x}" for x in ("6b86b273", "d4735e3a", "00000000")]
    index = vectors(spark, sf_dir)
    return index.where(V.hit_filter(index, V.known_files(files(spark, sf_dir), ids))).select("uid")


@query(f"WITH {CHUNKS} SELECT uid, in_order, md5(text) AS body FROM chunks WHERE file_uid = 'f-00000004'")
def chunks_with_bodies(spark, sf_dir):
    held = chunks(spark, sf_dir)
    return V.bodies(held, held.select("uid", F.col("text").alias("content")), "f-00000004").select("uid", "in_order", F.md5("body").alias("body"))


@query("SELECT e.vec_id AS uid, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings e ORDER BY score DESC, uid LIMIT 15")
def dense_only_when_nothing_is_asked(spark, sf_dir):
    """Without a question, or an index without text, the dense leg alone."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")
    v = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"]]
    return S.hybrid(index, v, "words that no text can answer", 15)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'host ' || page_id WHEN 1 THEN NULL ELSE 'x' END AS said FROM pages")
def filter_said_query(spark, sf_dir):
    filter_ = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('tags : "a" AND q="host '), F.col("page_id").cast("string"), F.lit('"'))).when(F.col("page_id") % 3 == 1, F.lit('seq = "no"')).otherwise(F.lit('q  =  "x" AND id = "y"'))
    return table(spark, sf_dir, "pages").select("page_id", said_query(filter_).alias("said"))
