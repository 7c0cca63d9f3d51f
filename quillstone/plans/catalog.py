"""Queries over listings, filters, permissions, counts and joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillstone.operators import catalog as C
from quillstone.plans.adapters import CHUNKS, FILES, KBS, chunks, files, knowledge_bases, live, table
from quillstone.plans.filters import Clause, Filter, permitted
from quillstone.plans.registry import query
from quillstone.plans.search import TRI, word_similarity_sql

#: What a listing of files may be filtered by, besides q.
LIST_FILTER = Filter({"uid": "string", "id": "string", "process_status": "string", "tags": "array"})
#: All of a file's columns, for the queries of the filter language itself; a listing takes LIST_FILTER.
FILE_FILTER = Filter({"uid": "string", "id": "string", "display_name": "string", "process_status": "string", "tags": "array", "size": "number", "update_time": "time", "usage_metadata": "json", "kb_uid": "string", "visibility": "string"})


@query(f"WITH {FILES} SELECT uid, process_status FROM live WHERE process_status IN ('FILE_PROCESS_STATUS_FAILED', 'FILE_PROCESS_STATUS_NOTSTARTED') AND list_contains(tags, 'src5') AND uid <> 'f-00000005'")
def list_filter_fields(spark, sf_dir):
    """A listing's filter: other fields than uid, id, q, process_status and tags are errors."""
    where = LIST_FILTER.compile('(processStatus = "FILE_PROCESS_STATUS_FAILED" OR process_status = "FILE_PROCESS_STATUS_NOTSTARTED") AND tags : "src5" AND uid != "f-00000005"')
    return live_files(spark, sf_dir).where(where).select("uid", "process_status")


def live_files(spark, sf_dir):
    return live(files(spark, sf_dir))


def filtered(spark, sf_dir, text):
    return live_files(spark, sf_dir).where(FILE_FILTER.compile(text)).select("uid", "process_status", "size")


def filter_sql(where: str) -> str:
    return f"WITH {FILES} SELECT uid, process_status, size FROM live WHERE {where}"


@query(f"WITH {FILES} SELECT uid, update_time, display_name FROM live ORDER BY update_time DESC, uid DESC LIMIT 11")
def list_page_first(spark, sf_dir):
    return C.page(live_files(spark, sf_dir)).select("uid", "update_time", "display_name")


@query(f"WITH {FILES} SELECT uid, update_time FROM live WHERE (update_time, uid) <= (TIMESTAMP '2024-02-03 10:00:00', 'f-00000500') ORDER BY update_time DESC, uid DESC LIMIT 26")
def list_page_next(spark, sf_dir):
    return C.page(live_files(spark, sf_dir), 25, (datetime(2024, 2, 3, 10), "f-00000500")).select("uid", "update_time")


@query(f"WITH {FILES} SELECT uid, create_time FROM live WHERE process_status = 'FILE_PROCESS_STATUS_COMPLETED' AND (create_time, uid) <= (TIMESTAMP '2024-01-01 08:00:00', 'f-00000480') ORDER BY create_time DESC, uid DESC LIMIT 21")
def list_page_admin(spark, sf_dir):
    where = F.col("process_status") == "FILE_PROCESS_STATUS_COMPLETED"
    return C.page(live_files(spark, sf_dir), 20, (datetime(2024, 1, 1, 8), "f-00000480"), where, time="create_time").select("uid", "create_time")


@query(f"WITH {FILES} SELECT uid, id FROM live WHERE uid > 'f-00000100' ORDER BY uid LIMIT 50")
def keyset_forward(spark, sf_dir):
    return C.forward(live_files(spark, sf_dir), 50, "f-00000100").select("uid", "id")


@query(filter_sql("process_status = 'FILE_PROCESS_STATUS_FAILED' AND size > 2000"))
def filter_eq_and(spark, sf_dir):
    return filtered(spark, sf_dir, 'processStatus = "FILE_PROCESS_STATUS_FAILED" AND size > 2000')


@query(filter_sql("size > 5000 AND (process_status = 'FILE_PROCESS_STATUS_FAILED' OR list_contains(tags, 'fr'))"))
def filter_or_precedence(spark, sf_dir):
    return filtered(spark, sf_dir, 'size > 5000 AND processStatus = "FILE_PROCESS_STATUS_FAILED" OR tags : "fr"')


@query(filter_sql("NOT (size >= 1000 OR list_contains(tags, 'en'))"))
def filter_not(spark, sf_dir):
    return filtered(spark, sf_dir, 'NOT (size >= 1000 OR tags : "en")')


@query(filter_sql("list_contains(tags, 'src7')"))
def filter_has_tag(spark, sf_dir):
    return filtered(spark, sf_dir, 'tags : "src7"')


@query(filter_sql("update_time >= TIMESTAMP '2024-02-04 12:00:00' AND size <> 0"))
def filter_timestamp(spark, sf_dir):
    return filtered(spark, sf_dir, 'updateTime >= timestamp("2024-02-04T12:00:00Z") AND size != 0')


@query(filter_sql("id = 'alias-42' OR list_contains(aliases, 'alias-42')"))
def filter_id_or_alias(spark, sf_dir):
    return filtered(spark, sf_dir, 'id = "alias-42"')


@query(filter_sql("(doc_id::VARCHAR = '17')"))
def filter_json_select(spark, sf_dir):
    return live_files(spark, sf_dir).withColumn("usage_metadata", F.format_string('{"n":"%d"}', "doc_id")).where(FILE_FILTER.compile('usageMetadata.n = "17"')).select("uid", "process_status", "size")


_ID, _SAID = TRI.format("id"), TRI.format("'reprt 41'")


@query(f"WITH {FILES} SELECT uid, display_name FROM live LEFT JOIN {word_similarity_sql('reprt 41', 'display_name', 'live')} USING (uid) WHERE score >= 0.3 OR contains(lower(display_name), 'reprt 41') OR contains(id, 'reprt 41') OR len(list_intersect({_ID}, {_SAID}))::DOUBLE / len(list_distinct(list_concat({_ID}, {_SAID}))) > 0.2")
def filter_fuzzy(spark, sf_dir):
    """Files whose name or id is like a misspelt query in a stretch of it."""
    return live_files(spark, sf_dir).where(FILE_FILTER.compile('q = "reprt 41"')).select("uid", "display_name")


@query(f"WITH {FILES} SELECT uid FROM live WHERE list_has_any(tags, ['src1', 'src2']) OR uid IN ('f-00000010', 'f-00000011') OR (len(list_filter(tags, lambda t: t LIKE 'src1%')) = 0 AND visibility = 'VISIBILITY_WORKSPACE')")
def permission_cascade_direct_orphan(spark, sf_dir):
    clauses = [Clause(tags_overlap=("src1", "src2")), Clause(uids=("f-00000010", "f-00000011")), Clause(tags_like_none=("src1%",), visibility=("VISIBILITY_WORKSPACE",)), Clause()]
    return live_files(spark, sf_dir).where(permitted(clauses)).select("uid")


@query(f"WITH {FILES} SELECT uid, id FROM live WHERE uid IN ('f-00000001', 'alias-5', 'file-6b86b273') OR id IN ('f-00000001', 'alias-5', 'file-6b86b273') OR list_has_any(aliases, ['f-00000001', 'alias-5', 'file-6b86b273'])")
def lookup_any_name(spark, sf_dir):
    return C.by_any_name(live_files(spark, sf_dir), ["f-00000001", "alias-5", "file-6b86b273"]).select("uid", "id")


@query(f"WITH {CHUNKS} SELECT kb_uid, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY kb_uid")
def tokens_by_kb(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("kb_uid").agg(F.sum("tokens").alias("tokens"))


@query(f"WITH {CHUNKS} SELECT file_uid, chunk_type, count(*) AS n FROM chunks GROUP BY ALL")
def chunks_by_source(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("file_uid", "chunk_type").agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT uid, size + doc_id AS total FROM live")
def json_token_totals(spark, sf_dir):
    return live_files(spark, sf_dir).select("uid", C.token_total().alias("total"))


@query(f"WITH {FILES} SELECT kb_uid, process_status, count(*) AS n, count(*) FILTER (delete_time IS NOT NULL) AS n_deleted FROM files GROUP BY ALL")
def files_by_status(spark, sf_dir):
    return files(spark, sf_dir).groupBy("kb_uid", "process_status").agg(F.count("*").alias("n"), F.count("delete_time").alias("n_deleted"))


@query(f"WITH {FILES}, v AS (SELECT vec_id AS doc_id, 1 AS one FROM embeddings) SELECT uid, CASE WHEN count(one) = 0 THEN -1 ELSE count(one) END AS n_vectors FROM live LEFT JOIN v USING (doc_id) GROUP BY uid")
def vectors_per_file(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return C.counted(live_files(spark, sf_dir).select("uid", "doc_id"), vectors, ["doc_id"], "n_vectors", -1).select("uid", "n_vectors")


@query(f"WITH {KBS} SELECT coalesce(update_status, '') AS update_status, count(*) AS n, count(*) FILTER (update_status IN ('UPDATING', 'SWAPPING', 'VALIDATING', 'SYNCING')) AS in_progress FROM kbs GROUP BY 1")
def update_status_summary(spark, sf_dir):
    running = F.col("update_status").isin("UPDATING", "SWAPPING", "VALIDATING", "SYNCING")
    return knowledge_bases(spark, sf_dir).groupBy(F.coalesce("update_status", F.lit("")).alias("update_status")).agg(F.count("*").alias("n"), F.count_if(running).alias("in_progress"))


@query("SELECT l_orderkey % 100 AS k, name, sum(v)::BIGINT AS total FROM (SELECT l_orderkey, 'audio' AS name, l_linenumber AS v FROM lineitem UNION ALL SELECT l_orderkey, 'video', l_suppkey FROM lineitem) GROUP BY ALL")
def modality_sums(spark, sf_dir):
    usage = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), F.create_map(F.lit("audio"), F.col("l_linenumber").cast("long"), F.lit("video"), F.col("l_suppkey")).alias("pairs"))
    return C.sums_by(usage, "k", "pairs")


@query(f"WITH {FILES}, {CHUNKS}, {KBS} SELECT k.uid, k.display_name, k.system_uid, (SELECT count(*) FROM live f WHERE f.kb_uid = k.uid) AS n_files, coalesce((SELECT sum(tokens) FROM chunks c WHERE c.kb_uid = k.uid), 0)::BIGINT AS tokens FROM kbs k WHERE NOT staging")
def kb_list_enriched(spark, sf_dir):
    kbs = knowledge_bases(spark, sf_dir).where("not staging").select(F.col("uid").alias("kb_uid"), "display_name", "system_uid")
    tokens = chunks(spark, sf_dir).groupBy("kb_uid").agg(F.sum("tokens").alias("tokens"))
    out = C.counted(kbs, live_files(spark, sf_dir), ["kb_uid"], "n_files").join(tokens, "kb_uid", "left")
    return out.select(F.col("kb_uid").alias("uid"), "display_name", "system_uid", "n_files", F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("SELECT o_orderkey AS file_uid, coalesce(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR), '') AS kb_uids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def file_kb_ids_map(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_uid"), F.col("l_suppkey").cast("string").alias("kb"))
    held = links.groupBy("file_uid").agg(F.array_sort(F.collect_set("kb")).alias("kbs"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_uid")).join(held, "file_uid", "left").select("file_uid", F.array_join(F.coalesce("kbs", F.array().cast("array<string>")), ",").alias("kb_uids"))


@query(f"WITH {FILES}, {CHUNKS} SELECT f.uid, CASE WHEN process_status = 'FILE_PROCESS_STATUS_COMPLETED' THEN count(c.uid) END AS n_chunks, CASE WHEN process_status = 'FILE_PROCESS_STATUS_COMPLETED' THEN coalesce(sum(tokens), 0)::BIGINT END AS tokens FROM live f LEFT JOIN chunks c ON c.file_uid = f.uid GROUP BY f.uid, process_status")
def file_list_enriched(spark, sf_dir):
    own = chunks(spark, sf_dir).groupBy("file_uid").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    done = F.col("process_status") == "FILE_PROCESS_STATUS_COMPLETED"
    out = live_files(spark, sf_dir).join(own, F.col("uid") == F.col("file_uid"), "left")
    return out.select("uid", F.when(done, F.coalesce("n", F.lit(0))).alias("n_chunks"), F.when(done, F.coalesce("t", F.lit(0))).alias("tokens"))


@query(f"WITH {FILES}, {CHUNKS} SELECT count(*) AS n, count(DISTINCT c.file_uid) AS n_files FROM chunks c JOIN live f ON f.uid = c.file_uid WHERE f.kb_uid = 'src3'")
def count_kb_chunks(spark, sf_dir):
    own = live_files(spark, sf_dir).where("kb_uid = 'src3'").select("uid")
    return chunks(spark, sf_dir).join(own, F.col("file_uid") == own["uid"], "left_semi").agg(F.count("*").alias("n"), F.countDistinct("file_uid").alias("n_files"))


@query(f"WITH {CHUNKS} SELECT uid, row_number() OVER (PARTITION BY file_uid ORDER BY CASE chunk_type WHEN 'TYPE_CONTENT' THEN 1 WHEN 'TYPE_SUMMARY' THEN 2 ELSE 3 END, in_order) AS place FROM chunks")
def chunk_order(spark, sf_dir):
    priority = F.when(F.col("chunk_type") == "TYPE_CONTENT", 1).when(F.col("chunk_type") == "TYPE_SUMMARY", 2).otherwise(3)
    return C.numbered(chunks(spark, sf_dir), ["file_uid"], [priority, F.col("in_order")], "place").select("uid", "place")
