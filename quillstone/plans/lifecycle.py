"""Queries over integrity and lifecycle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import lifecycle as L
from quillstone.operators import updates as U
from quillstone.operators import workflow as W
from quillstone.operators.catalog import first_by
from quillstone.plans.adapters import CHUNKS, FILES, KBS, chunks, files, knowledge_bases, live, table
from quillstone.plans.registry import query
from quillstone.sources.shared import fresh

NOW = "2024-02-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def sides(spark, sf_dir):
    f = live(files(spark, sf_dir))
    vectors = chunks(spark, sf_dir).where("retrievable").select("file_uid")
    converted = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("f-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("file_uid"))
    return f, chunks(spark, sf_dir).select("file_uid"), vectors, converted


SIDES = f"""{FILES}, {CHUNKS}, nc AS (SELECT file_uid, count(*) AS n_chunks, count(*) FILTER (retrievable) AS n_ret FROM chunks GROUP BY 1),
nv AS (SELECT 'f-' || lpad(doc_id::VARCHAR, 8, '0') AS file_uid, count(*) AS n_conv FROM labels WHERE quality = 1 GROUP BY 1),
probe AS (SELECT uid, kb_uid, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN coalesce(n_ret, 0) = 0 THEN -1 ELSE n_ret END AS n_vectors, coalesce(n_conv, 0) AS n_conv, process_status FROM live LEFT JOIN nc ON nc.file_uid = uid LEFT JOIN nv ON nv.file_uid = uid),
state AS (SELECT *, CASE WHEN process_status <> 'FILE_PROCESS_STATUS_COMPLETED' THEN 'NOT_COMPLETED' WHEN n_chunks = 0 THEN 'EMPTY_PG' WHEN kb_uid IS NULL THEN 'FILE_NOT_FOUND' WHEN n_vectors < 0 OR n_vectors <> n_chunks THEN 'MISSING_MILVUS' WHEN n_conv = 0 THEN 'MISSING_CONVERTED_FILE' ELSE 'HEALTHY' END AS state FROM probe)"""


@query(f"WITH {SIDES} SELECT uid, n_chunks, n_vectors, n_conv AS n_converted, state, CASE state WHEN 'HEALTHY' THEN 'NONE' WHEN 'FILE_NOT_FOUND' THEN 'SKIP' WHEN 'NOT_COMPLETED' THEN 'DEFER' ELSE 'REPROCESS' END AS action FROM state")
def integrity_probe(spark, sf_dir):
    return L.integrity(*sides(spark, sf_dir))


ASKED = "asked AS (SELECT 'f-' || lpad((doc_id * 2)::VARCHAR, 8, '0') AS uid FROM documents)"


@query(f"WITH {SIDES}, {ASKED} SELECT a.uid, CASE WHEN s.uid IS NULL THEN 'FILE_NOT_FOUND' ELSE state END AS state, CASE WHEN s.uid IS NULL OR state = 'FILE_NOT_FOUND' THEN 'SKIP' WHEN state = 'HEALTHY' THEN 'NONE' WHEN state = 'NOT_COMPLETED' THEN 'DEFER' ELSE 'REPROCESS' END AS action FROM asked a LEFT JOIN state s USING (uid)")
def integrity_of_asked(spark, sf_dir):
    """Every second file and as many uids that no file has; deleted files aren't found either."""
    asked = table(spark, sf_dir, "documents").select(F.concat(F.lit("f-"), F.lpad((F.col("doc_id") * 2).cast("string"), 8, "0")).alias("uid"))
    return L.integrity(*sides(spark, sf_dir), asked).select("uid", "state", "action")


@query(f"WITH {SIDES} SELECT uid FROM state WHERE state = 'MISSING_MILVUS' AND n_chunks > 0 AND n_conv > 0")
def embed_only_path(spark, sf_dir):
    return L.integrity(*sides(spark, sf_dir)).where(L.embed_only()).select("uid")


RECON = f"{FILES}, p AS (SELECT display_name, uid FROM live WHERE visibility = 'VISIBILITY_PRIVATE'), s AS (SELECT display_name, uid, create_time FROM files WHERE process_status <> 'FILE_PROCESS_STATUS_FAILED' UNION ALL SELECT display_name, uid || '-copy', create_time + INTERVAL 1 DAY FROM files WHERE process_status = 'FILE_PROCESS_STATUS_COMPLETED')"


@query(f"WITH {RECON} SELECT display_name, uid, 'ADD' AS todo FROM p WHERE display_name NOT IN (SELECT display_name FROM s) UNION ALL SELECT display_name, uid, 'REMOVE' FROM s WHERE display_name NOT IN (SELECT display_name FROM p) UNION ALL SELECT display_name, uid, 'DUPLICATE' FROM (SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY create_time, uid) AS rn FROM s WHERE display_name IN (SELECT display_name FROM p)) WHERE rn > 1")
def kb_reconcile(spark, sf_dir):
    f = files(spark, sf_dir)
    production = live(f).where("visibility = 'VISIBILITY_PRIVATE'").select("display_name", "uid")
    columns = f.where("process_status <> 'FILE_PROCESS_STATUS_FAILED'").select("display_name", "uid", "create_time")
    copies = f.where("process_status = 'FILE_PROCESS_STATUS_COMPLETED'").select("display_name", F.concat("uid", F.lit("-copy")).alias("uid"), (F.col("create_time") + F.expr("interval 1 day")).alias("create_time"))
    return L.reconcile(production, columns.unionByName(copies))


@query(f"WITH {FILES}, {CHUNKS}, c AS (SELECT kb_uid, count(*) AS files, count(*) FILTER (delete_time IS NULL) AS staging_files, count(*) FILTER (size > 500) AS converted, count(*) FILTER (size > 400 AND delete_time IS NULL) AS staging_converted FROM files GROUP BY 1), h AS (SELECT kb_uid, count(*) AS chunks, count(*) FILTER (chunk_type = 'TYPE_CONTENT') AS staging_chunks, count(*) FILTER (retrievable) AS staging_embeddings FROM chunks GROUP BY 1) SELECT kb_uid, array_to_string(list_filter([CASE WHEN staging_files > 0 AND files <> staging_files THEN 'file count differs' END, CASE WHEN staging_converted < converted THEN 'converted files are missing' END, CASE WHEN chunks > 0 AND staging_chunks = 0 THEN 'no chunks' END, CASE WHEN staging_embeddings <> staging_chunks THEN 'embeddings and chunks differ' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c JOIN h USING (kb_uid)")
def kb_validate(spark, sf_dir):
    there = F.col("delete_time").isNull()
    f = files(spark, sf_dir).groupBy("kb_uid").agg(F.count("*").alias("files"), F.count_if(there).alias("staging_files"), F.count_if(F.col("size") > 500).alias("converted"), F.count_if((F.col("size") > 400) & there).alias("staging_converted"))
    c = chunks(spark, sf_dir).groupBy("kb_uid").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "TYPE_CONTENT").alias("staging_chunks"), F.count_if("retrievable").alias("staging_embeddings"))
    return L.validate(f.join(c, "kb_uid")).select("kb_uid", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {KBS} SELECT k.uid, CASE WHEN update_status IN ('UPDATING', 'SWAPPING', 'VALIDATING', 'SYNCING') THEN (SELECT min(uid) FROM kbs s WHERE s.parent_kb_uid = k.uid AND list_contains(s.tags, 'staging')) END AS target FROM kbs k")
def dual_target(spark, sf_dir):
    return L.target(knowledge_bases(spark, sf_dir))


@query(f"WITH {KBS} SELECT uid, parent_kb_uid IS NULL OR rollback_retention_until IS NULL OR rollback_retention_until < TIMESTAMP '{NOW}' AS expired FROM kbs")
def retention_expired(spark, sf_dir):
    return L.retention_over(knowledge_bases(spark, sf_dir), now())


@query(f"WITH {KBS} SELECT uid FROM kbs WHERE NOT staging AND (update_status IS NULL OR update_status IN ('', 'COMPLETED')) AND list_has_any(tags, ['team-0', 'team-1'])")
def update_eligible(spark, sf_dir):
    return L.eligible(knowledge_bases(spark, sf_dir), ["team-0", "team-1"]).select("uid")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 400 > 0 AND o_orderdate + to_days((o_custkey % 400)::INTEGER) + INTERVAL 24 HOUR < TIMESTAMP '{NOW}'")
def expired_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("create_time"), (F.col("o_custkey") % 400).cast("int").alias("expire_days"))
    return L.expired_objects(rows, now()).select("o_orderkey", F.col("create_time").alias("o_orderdate"))


@query(f"WITH {FILES} SELECT uid FROM live WHERE process_status NOT IN ('FILE_PROCESS_STATUS_COMPLETED', 'FILE_PROCESS_STATUS_FAILED') AND update_time < TIMESTAMP '2024-02-03' - INTERVAL 15 MINUTE AND uid NOT IN (SELECT 'f-' || lpad(vec_id::VARCHAR, 8, '0') FROM embeddings)")
def orphan_sweep(spark, sf_dir):
    running = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f-"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("uid"))
    return L.orphans(live(files(spark, sf_dir)), running, F.lit("2024-02-03 00:00:00").cast("timestamp")).select("uid")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_status(spark, sf_dir):
    return first_by(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "ts")


@query("WITH s AS (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 0) AS c FROM events), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r) SELECT user_id, arg_min(event_id, (ts, event_id)) AS since FROM n WHERE k = 3 GROUP BY 1")
def count_stability(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    polls = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order))
    runs = L.stable(polls, "user_id", "n", "event_type", 3).withColumnRenamed("since", "n")
    return runs.join(polls, ["user_id", "n"]).select("user_id", F.col("event_id").alias("since"))


@query(f"WITH {KBS} SELECT k.uid, s.uid AS staging_uid FROM kbs k JOIN kbs s ON s.parent_kb_uid = k.uid AND list_contains(s.tags, 'staging')")
def staging_lookup(spark, sf_dir):
    kbs = knowledge_bases(spark, sf_dir)
    s = kbs.where(F.array_contains("tags", "staging")).select(F.col("uid").alias("staging_uid"), F.col("parent_kb_uid").alias("uid"))
    return kbs.select("uid").join(s, "uid")


@query(f"WITH {KBS} SELECT k.uid, s.uid AS rollback_uid FROM kbs k JOIN (SELECT uid || '-old' AS uid, uid AS parent FROM kbs WHERE NOT staging AND usage % 20 = 0) s ON s.parent = k.uid")
def rollback_lookup(spark, sf_dir):
    kbs = knowledge_bases(spark, sf_dir)
    old = kbs.where("not staging and usage % 20 = 0").withColumns({"parent_kb_uid": F.col("uid"), "uid": F.concat("uid", F.lit("-old")), "tags": F.array(F.lit("rollback"))})
    every = kbs.unionByName(old)
    s = every.where(F.array_contains("tags", "rollback")).select(F.col("uid").alias("rollback_uid"), F.col("parent_kb_uid").alias("uid"))
    return every.select("uid").join(s, "uid")


@query(f"WITH {KBS} SELECT uid FROM kbs WHERE NOT staging AND (update_status IS NULL OR update_status IN ('', 'COMPLETED')) AND id IN ('kb-' || substr(sha256('src0'), 1, 8), 'kb-' || substr(sha256('src6'), 1, 8), 'kb-' || substr(sha256('src2'), 1, 8))")
def update_eligible_ids(spark, sf_dir):
    """Bases that can be updated, of those with the given ids."""
    import hashlib

    ids = ["kb-" + hashlib.sha256(x.encode()).hexdigest()[:8] for x in ("src0", "src6", "src2")]
    return L.eligible(knowledge_bases(spark, sf_dir), [], ids).select("uid")


@query(f"WITH {KBS} SELECT uid, CASE WHEN uid = 'src1' THEN 'FAILED' WHEN uid = 'src2' THEN 'SWAPPING' ELSE update_status END AS update_status, CASE WHEN uid IN ('src1', 'src2') THEN 'w-' || uid ELSE '' END AS workflow, CASE WHEN uid = 'src1' THEN 'no room' ELSE '' END AS error, CASE WHEN uid IN ('src1', 'src2') THEN TIMESTAMP '{NOW}' END AS started, CASE WHEN uid = 'src1' THEN TIMESTAMP '{NOW}' + INTERVAL 1 HOUR END AS ended, CASE WHEN uid = 'src1' THEN 'sys-9' ELSE '' END AS previous FROM kbs")
def update_status_write(spark, sf_dir):
    """Two updates begin; one fails, one comes to the swap."""
    none = F.lit(None).cast("timestamp")
    kbs = knowledge_bases(spark, sf_dir).withColumns({"update_started_at": none, "update_completed_at": none, "update_workflow_id": F.lit(""), "update_error_message": F.lit(""), "previous_system_uid": F.lit("")})
    kbs = U.status_written(U.status_written(kbs, "src1", "UPDATING", now(), "w-src1", previous_system="sys-9"), "src2", "UPDATING", now(), "w-src2")
    kbs = U.status_written(U.status_written(kbs, "src1", "FAILED", now() + F.expr("interval 1 hour"), error="no room"), "src2", "SWAPPING", now())
    return kbs.select("uid", "update_status", F.col("update_workflow_id").alias("workflow"), F.col("update_error_message").alias("error"), F.col("update_started_at").alias("started"), F.col("update_completed_at").alias("ended"), F.col("previous_system_uid").alias("previous"))


def catalog(spark, sf_dir):
    """Bases and their chunks; every second chunk of src1 has a copy on its staging side."""
    held = chunks(spark, sf_dir).select("uid", "kb_uid", "in_order")
    copies = held.where("kb_uid = 'src1' and in_order % 2 = 0").withColumns({"kb_uid": F.lit("src1-new"), "uid": F.concat("uid", F.lit("+"))})
    kbs = knowledge_bases(spark, sf_dir).select("uid", "update_status", "staging", "tags", "parent_kb_uid", "rollback_retention_until").withColumn("update_status", F.when(F.col("uid") != "src1", F.col("update_status")))
    return {"kbs": kbs, "chunks": held.unionByName(copies)}


def shown(c):
    kbs = c["kbs"].select(F.lit("kb").alias("kind"), "uid", F.coalesce("update_status", F.lit("")).alias("state"))
    return kbs.unionByName(c["chunks"].select(F.lit("chunk").alias("kind"), "uid", F.col("kb_uid").alias("state")))


OLD_CHUNKS = f"{CHUNKS}, {KBS}, both_ AS (SELECT uid, kb_uid, false AS new FROM chunks UNION ALL SELECT uid || '+', 'src1', true FROM chunks WHERE kb_uid = 'src1' AND in_order % 2 = 0), st AS (SELECT uid, CASE WHEN uid <> 'src1' THEN coalesce(update_status, '') END AS s FROM kbs)"


@query(f"WITH {OLD_CHUNKS} SELECT 'kb' AS kind, uid, coalesce(s, 'COMPLETED') AS state FROM st UNION ALL SELECT 'kb', 'src1-old', '' UNION ALL SELECT 'chunk', uid, CASE WHEN kb_uid = 'src1' AND NOT new THEN 'src1-old' ELSE kb_uid END FROM both_")
def update_swap(spark, sf_dir):
    """An update from its beginning to the swap: staging's chunks are the base's, its own are kept on the rollback side."""
    begun = U.begin(catalog(spark, sf_dir), "src1", "src1-new")
    return shown(U.swap_in(begun, "src1", "src1-new", "src1-old", now()))


@query(f"WITH {OLD_CHUNKS} SELECT 'kb' AS kind, uid, coalesce(s, 'ROLLED_BACK') AS state FROM st UNION ALL SELECT 'chunk', uid, kb_uid FROM both_ WHERE NOT new")
def update_rollback(spark, sf_dir):
    """After a swap the rollback side takes the base's place again; what staging brought is gone."""
    begun = U.begin(catalog(spark, sf_dir), "src1", "src1-new")
    return shown(U.roll_back(U.swap_in(begun, "src1", "src1-new", "src1-old", now()), "src1", "src1-old"))


@query(f"WITH {OLD_CHUNKS} SELECT 'kb' AS kind, uid, coalesce(s, 'ABORTED') AS state FROM st UNION ALL SELECT 'chunk', uid, kb_uid FROM both_ WHERE NOT new")
def update_abort(spark, sf_dir):
    return shown(U.abort(U.begin(catalog(spark, sf_dir), "src1", "src1-new"), "src1", "src1-new"))


@query(f"WITH {OLD_CHUNKS} SELECT 'kb' AS kind, uid, coalesce(s, 'COMPLETED') AS state FROM st UNION ALL SELECT 'chunk', uid, kb_uid FROM both_ WHERE kb_uid <> 'src1' OR new")
def update_purge(spark, sf_dir):
    """After the retention the rollback side goes with its chunks."""
    begun = U.begin(catalog(spark, sf_dir), "src1", "src1-new")
    return shown(U.purge(U.swap_in(begun, "src1", "src1-new", "src1-old", now()), now() + F.expr("interval 1 day")))


def processed(new):
    """Two chunks with their vectors and a converted file of each file."""
    each = new.select(F.col("uid").alias("file_uid"), "kb_uid")
    two = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n"))
    return {"chunks": two, "embeddings": two, "converted": each}


@query(f"""WITH {FILES}, {KBS}, src AS (SELECT uid, kb_uid, display_name, delete_time IS NOT NULL AS was, doc_id % 3 = 0 AND kb_uid = 'src1' AS late FROM files UNION ALL SELECT 'f-new', 'src1', 'fresh', false, false),
clones AS (SELECT uid || '+' AS uid, 'src1' AS kb_uid FROM src WHERE kb_uid = 'src1' AND NOT was AND NOT late),
all_ AS (SELECT uid, CASE WHEN kb_uid = 'src1' THEN 'src1-rollback' ELSE kb_uid END AS kb_uid, NOT was AND NOT late AS live, CASE WHEN was OR uid = 'f-new' THEN 0 ELSE 2 END AS chunks FROM src UNION ALL SELECT uid, kb_uid, true, 2 FROM clones)
SELECT a.kb_uid, count(*) AS files, count(*) FILTER (live) AS live, sum(chunks)::BIGINT AS chunks, coalesce(any_value(CASE WHEN k.uid = 'src1' THEN 'COMPLETED' ELSE k.update_status END), '') AS status FROM all_ a LEFT JOIN kbs k ON k.uid = a.kb_uid GROUP BY 1""")
def update_workflow(spark, sf_dir):
    """An update of one base, ended after the first copies were made and called again; files were deleted and one was added meanwhile."""
    run = W.Run(spark, fresh(spark, "update"))
    held = files(spark, sf_dir).select("uid", "kb_uid", "display_name", "create_time", "delete_time", "doc_id")
    kbs = knowledge_bases(spark, sf_dir).select("uid", F.when(F.col("uid") != "src1", F.col("update_status")).alias("update_status"), "staging", "tags", "parent_kb_uid", "rollback_retention_until")
    run.start({"kbs": kbs, "files": held} | processed(live(held)))
    W.update(run, "src1", processed, now(), "REPROCESSED")
    changed = run.tables()["files"].withColumn("delete_time", F.when((F.col("kb_uid") == "src1") & (F.col("doc_id") % 3 == 0), F.coalesce("delete_time", now())).otherwise(F.col("delete_time")))
    new = changed.limit(1).select(F.lit("f-new").alias("uid"), F.lit("src1").alias("kb_uid"), F.lit("fresh").alias("display_name"), "create_time", F.lit(None).cast("timestamp").alias("delete_time"), F.lit(-1).cast("long").alias("doc_id"))
    run.commit("REPROCESSED", {"files": changed.unionByName(new)})
    W.update(run, "src1", processed, now())
    c = run.tables()
    sums = c["files"].groupBy("kb_uid").agg(F.count("*").alias("files"), F.count_if(F.col("delete_time").isNull()).alias("live"))
    sums = sums.join(c["chunks"].groupBy("kb_uid").agg(F.count("*").alias("chunks")), "kb_uid", "left")
    return sums.join(c["kbs"].select(F.col("uid").alias("kb_uid"), F.coalesce("update_status", F.lit("")).alias("status")), "kb_uid", "left").select("kb_uid", "files", "live", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("status", F.lit("")).alias("status"))
