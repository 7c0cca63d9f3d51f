"""Queries over the life of files, vectors, converted files, tags, systems and knowledge bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import catalog as C
from quillstone.operators import merges as M
from quillstone.operators import records as R
from quillstone.plans.adapters import CHUNKS, FILES, KBS, LINKS, chunks, entities, entity_files, files, knowledge_bases, live, table
from quillstone.plans.registry import query

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def owned(spark, sf_dir):
    """Files, their links to bases, and the bases' usage; every tenth file is linked to a second base."""
    f = files(spark, sf_dir)
    links = f.select(F.col("uid").alias("file_uid"), "kb_uid").unionByName(f.where("doc_id % 10 = 0").select(F.col("uid").alias("file_uid"), F.lit("src1").alias("kb_uid"))).distinct()
    return f, links, knowledge_bases(spark, sf_dir).select("uid", "usage", "system_uid", "display_name", "update_time")


OWNED = f"{FILES}, {KBS}, own AS (SELECT uid AS file_uid, kb_uid FROM files UNION SELECT uid, 'src1' FROM files WHERE doc_id % 10 = 0)"

FRESH = "fresh AS (SELECT * FROM (SELECT kb_uid, content_sha256, min(uid) AS uid, arg_min(size, uid) AS size FROM files WHERE doc_id % 2 = 1 GROUP BY 1, 2) n WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.kb_uid = n.kb_uid AND h.content_sha256 = n.content_sha256))"
HELD = f"{OWNED}, held AS (SELECT o.kb_uid, f.content_sha256 FROM own o JOIN live f ON f.uid = o.file_uid WHERE f.doc_id % 2 = 0)"


def halves(spark, sf_dir):
    f, links, kbs = owned(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    return f.where(even), links.join(f.where(even).select(F.col("uid").alias("file_uid")), "file_uid", "left_semi"), kbs, f.where(~even)


@query(f"WITH {HELD}, {FRESH} SELECT uid, kb_uid, size FROM fresh")
def content_dedup_on_insert(spark, sf_dir):
    """New files whose content their base doesn't have yet, the first of each content."""
    old, links, _, new = halves(spark, sf_dir)
    held = links.join(live(old).select(F.col("uid").alias("file_uid"), "content_sha256"), "file_uid")
    return R.fresh_contents(held, new, [F.col("uid")]).select("uid", "kb_uid", "size")


@query(f"WITH {HELD}, {FRESH} SELECT 'file' AS kind, uid AS name, NULL::BIGINT AS n FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT 'file', uid, NULL FROM fresh UNION ALL SELECT 'kb', uid, usage + coalesce((SELECT sum(size) FROM fresh f WHERE f.kb_uid = k.uid), 0)::BIGINT FROM kbs k UNION ALL SELECT 'link ' || kb_uid, file_uid, NULL FROM own WHERE file_uid IN (SELECT uid FROM files WHERE doc_id % 2 = 0) UNION ALL SELECT 'link ' || kb_uid, uid, NULL FROM fresh")
def create_files(spark, sf_dir):
    """Files, links and usage after new files have come in."""
    old, links, kbs, new = halves(spark, sf_dir)
    f, made, k = R.create_files(old, links, kbs, new, [F.col("uid")])
    none = F.lit(None).cast("long").alias("n")
    out = f.select(F.lit("file").alias("kind"), F.col("uid").alias("name"), none).unionByName(k.select(F.lit("kb").alias("kind"), F.col("uid").alias("name"), F.col("usage").alias("n")))
    return out.unionByName(made.select(F.concat(F.lit("link "), F.col("kb_uid")).alias("kind"), F.col("file_uid").alias("name"), none))


@query(f"WITH {OWNED} SELECT uid, usage FROM kbs")
def create_files_admin(spark, sf_dir):
    """An administrator's files change no usage."""
    old, links, kbs, new = halves(spark, sf_dir)
    return R.create_files(old, links, kbs, new, [F.col("uid")], dedup=False)[2].select("uid", "usage")


@query(f"WITH {OWNED} SELECT uid, usage - coalesce((SELECT sum(size) FROM files f JOIN own o ON o.file_uid = f.uid WHERE o.kb_uid = k.uid AND f.uid = 'f-00000010'), 0)::BIGINT AS usage, (SELECT count(*) FROM files WHERE delete_time IS NOT NULL OR uid = 'f-00000010') AS deleted FROM kbs k")
def delete_file_and_usage(spark, sf_dir):
    f, links, kbs = owned(spark, sf_dir)
    f, kbs = R.delete_file(f, links, kbs, "f-00000010", now())
    return kbs.crossJoin(f.agg(F.count("delete_time").alias("deleted"))).select("uid", "usage", "deleted")


META = """meta AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '{"status_message":"failed","pages":' || doc_id || ',"by":{"ok":true,"steps":[1,"two",null]},"ratio":0.5}' WHEN 1 THEN '{"other":"' || doc_id || '"}' WHEN 2 THEN '[' || doc_id || ']' END AS held FROM files),
stamped AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN held WHEN json_type(held) = 'ARRAY' THEN substr(held, 1, length(held) - 1) || ',{"status_message":""}]' ELSE json_merge_patch(coalesce(held, '{}'), '{"status_message":""}') END AS new FROM meta)"""


@query(f"""WITH {FILES}, {META} SELECT uid, CASE WHEN doc_id % 3 = 0 THEN 'FILE_PROCESS_STATUS_PROCESSING' ELSE process_status END AS process_status, CASE WHEN doc_id % 3 = 0 THEN 'me' ELSE 'nobody' END AS requester_uid,
  new ->> '$.status_message' AS message, new -> '$.pages' AS pages, new -> '$.by' AS by_, new -> '$.ratio' AS ratio, new ->> '$.other' AS other, CASE WHEN json_type(new) = 'ARRAY' THEN new END AS list FROM stamped""")
def status_stamp(spark, sf_dir):
    """Files that begin to be processed: status, requester, and the message in their metadata; numbers, lists and objects there stay what they are."""
    held = (
        F.when(F.col("doc_id") % 4 == 0, F.format_string('{"status_message":"failed","pages":%d,"by":{"ok":true,"steps":[1,"two",null]},"ratio":0.5}', "doc_id"))
        .when(F.col("doc_id") % 4 == 1, F.format_string('{"other":"%d"}', "doc_id"))
        .when(F.col("doc_id") % 4 == 2, F.format_string("[%d]", "doc_id"))
    )
    f = files(spark, sf_dir).select("uid", "process_status", F.lit("nobody").alias("requester_uid"), held.alias("extra_meta_data"), "doc_id")
    out = R.begin_processing(f, f.where("doc_id % 3 = 0"), "me")
    part = lambda name, of: F.get_json_object("extra_meta_data", f"$.{of}").alias(name)
    return out.select("uid", "process_status", "requester_uid", part("message", "status_message"), part("pages", "pages"), part("by_", "by"), part("ratio", "ratio"), part("other", "other"), F.when(F.col("extra_meta_data").startswith("["), F.col("extra_meta_data")).alias("list"))


#: Parts as systems: with a whole configuration, with parts of one, and with none.
CONFIGS = """sysc AS (SELECT 'u-' || p_partkey AS uid, 'id-' || p_partkey AS id, CASE WHEN p_partkey = 5 THEN 'openai' ELSE 'slug-' || p_partkey END AS slug, p_partkey % 11 = 7 AS gone, p_partkey % 6 AS k, p_partkey FROM part),
conf AS (SELECT *, CASE k WHEN 0 THEN 'gemini' WHEN 1 THEN 'fam-' || p_partkey WHEN 2 THEN '' ELSE 'openai' END AS model_family, CASE k WHEN 0 THEN 3072 WHEN 1 THEN 0 WHEN 2 THEN 768 ELSE 1536 END AS dimensionality FROM sysc WHERE NOT gone)"""


def systems_with_config(spark, sf_dir):
    n = F.col("p_partkey")
    config = (
        F.when(n % 6 == 0, F.lit('{"rag":{"embedding":{"model_family":"gemini","dimensionality":3072}}}'))
        .when(n % 6 == 1, F.format_string('{"rag":{"embedding":{"model_family":"fam-%d","dimensionality":"many"}}}', n))
        .when(n % 6 == 2, F.lit('{"rag":{"embedding":{"model_family":7,"dimensionality":768}}}'))
        .when(n % 6 == 3, F.lit('{"rag":{"embedding":[]}}'))
        .when(n % 6 == 4, F.lit('{"rag":3}'))
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("u-"), n.cast("string")).alias("uid"), F.concat(F.lit("id-"), n.cast("string")).alias("id"), F.when(n == 5, "openai").otherwise(F.concat(F.lit("slug-"), n.cast("string"))).alias("slug"), F.col("p_name").alias("display_name"),
        config.alias("config"), F.lit("old").alias("description"), F.lit(False).alias("is_default"), F.lit(None).cast("timestamp").alias("create_time"), F.lit(None).cast("timestamp").alias("update_time"), F.when(n % 11 == 7, now()).alias("delete_time"), n.alias("n"),
    )


@query(f"WITH {CONFIGS} SELECT l_orderkey, l_linenumber, coalesce(c.model_family, f.model_family, 'openai') AS model_family, coalesce(c.dimensionality, f.dimensionality, 1536)::BIGINT AS dimensionality FROM lineitem LEFT JOIN conf c ON c.id = 'id-' || CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END LEFT JOIN (SELECT * FROM conf WHERE slug = 'openai') f ON true")
def system_configs(spark, sf_dir):
    """What each line's system embeds with: its own configuration, that of the fallback, or the fixed one."""
    number = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("id-"), number.cast("string")).alias("system_id"))
    return R.configs_of(asked, systems_with_config(spark, sf_dir)).select("l_orderkey", "l_linenumber", "model_family", "dimensionality")


@query(f"""WITH {CONFIGS} SELECT uid, id, CASE WHEN NOT gone AND p_partkey % 4 = 0 THEN 'new text' ELSE 'old' END AS description, CASE WHEN p_partkey = 9 THEN 'my-system-2' ELSE slug END AS slug, CASE WHEN NOT gone AND p_partkey % 4 = 0 THEN TIMESTAMP '{NOW}' END AS update_time FROM sysc
UNION ALL SELECT 'c-' || s_suppkey, 'sys-' || substr(sha256('c-' || s_suppkey), 1, 8), lower(regexp_replace(s_name, '[^a-zA-Z0-9-]', '', 'g')), lower(regexp_replace(regexp_replace(regexp_replace(s_name, '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')), TIMESTAMP '{NOW}' FROM supplier""")
def system_changes(spark, sf_dir):
    """Systems whose descriptions change, one that is renamed, and new ones, named by suppliers."""
    held = systems_with_config(spark, sf_dir)
    changes = held.where("n % 4 = 0 and delete_time is null").select("id", F.lit("new text").alias("description"), F.lit(None).cast("string").alias("config"))
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c-"), F.col("s_suppkey").cast("string")).alias("uid"), F.col("s_name").alias("display_name"), F.lit("{}").alias("config"), F.lower(F.regexp_replace("s_name", "[^a-zA-Z0-9-]", "")).alias("description"))
    out = R.update_systems(held.drop("n"), changes, now())
    return R.create_systems(R.rename_system(out, "id-9", "My System (2)"), made, now()).select("uid", "id", "description", "slug", "update_time")


@query(f"WITH {KBS} SELECT uid, CASE WHEN usage % 30 = 0 THEN uid WHEN usage % 30 = 10 THEN uid ELSE 'col-' || usage END AS collection FROM kbs")
def active_collection(spark, sf_dir):
    """Bases with a collection of their own, with the nil one, and with none."""
    set_ = F.when(F.col("usage") % 30 == 0, "00000000-0000-0000-0000-000000000000").when(F.col("usage") % 30 != 10, F.concat(F.lit("col-"), F.col("usage").cast("string")))
    return R.active_collections(knowledge_bases(spark, sf_dir).withColumn("active_collection_uid", set_))


@query("WITH new AS (SELECT l_partkey AS entity_uid, l_orderkey + l_linenumber % 3 AS file_uid FROM lineitem) SELECT entity_uid, file_uid FROM (SELECT DISTINCT l_partkey AS entity_uid, l_orderkey AS file_uid FROM lineitem UNION SELECT * FROM new)")
def link_entities_once(spark, sf_dir):
    """Links of entities to files, some of which are there already and some of which come twice."""
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_uid"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("file_uid"))
    return M.insert_ignore(entity_files(spark, sf_dir), new, ["entity_uid", "file_uid"], [F.col("entity_uid")])


@query(f"WITH {FILES} SELECT uid, CASE WHEN doc_id % 3 = 0 THEN 'TYPE_PDF' WHEN doc_id % 3 = 1 THEN 'TYPE_TEXT' ELSE 'FILE_X' END AS file_type, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE lang || '-report-' || doc_id END AS slug FROM files JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def migration_backfills(spark, sf_dir):
    """Names of types without the table's prefix, and slugs of names where there are none."""
    i = F.col("doc_id")
    held = files(spark, sf_dir).select("uid", F.replace("display_name", F.lit(" "), F.lit("  ")).alias("display_name"), F.when(i % 3 == 0, "FILE_TYPE_PDF").when(i % 3 == 1, "TYPE_TEXT").otherwise("FILE_X").alias("file_type"), F.when(i % 2 == 0, "kept").when(i % 4 == 1, "").alias("slug"))
    return R.backfilled(held).select("uid", "file_type", "slug")


@query(f"""WITH {FILES}, l AS (SELECT uid, display_name, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS kb, doc_id FROM (SELECT uid, delete_time, doc_id, 'name ' || (doc_id // 2) AS display_name FROM files))
SELECT f.uid, f.delete_time IS NOT NULL OR f.doc_id IN (10, 30, 11, 31) AS deleted FROM files f""")
def delete_with_twin(spark, sf_dir):
    """Files of base a and, by their names, those of base b, which takes part in a's changes."""
    i = F.col("doc_id")
    f = files(spark, sf_dir).withColumn("display_name", F.concat(F.lit("name "), F.floor(i / 2).cast("string")))
    links = f.select(F.col("uid").alias("file_uid"), F.when(i % 2 == 0, "a").otherwise("b").alias("kb_uid"))
    targets = spark.createDataFrame([("a", "b"), ("b", None)], "uid string, target string")
    return R.delete_with_twins(f, links, targets, ["f-00000010", "f-00000030"], now()).select("uid", F.col("delete_time").isNotNull().alias("deleted"))


@query(f"WITH {CHUNKS} SELECT uid, CASE WHEN uid = 'c-3-0' THEN false ELSE retrievable END AS retrievable FROM chunks")
def update_one_row(spark, sf_dir):
    return R.update_row(chunks(spark, sf_dir), "uid", "c-3-0", "retrievable", False).select("uid", "retrievable")


@query("SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.m ELSE c_comment END AS usage FROM (SELECT c_custkey, c_mktsegment AS c_comment FROM customer) LEFT JOIN (SELECT o_custkey AS k, CASE WHEN count(*) % 2 = 0 THEN count(*)::VARCHAR END AS m FROM orders GROUP BY 1) o ON o.k = c_custkey")
def replace_usage_metadata(spark, sf_dir):
    """New usage metadata take the place of the old, nulls too."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("usage"))
    return R.replace_column(old, n.select("c_custkey", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).alias("usage")), "c_custkey", "usage")


def converted(spark, sf_dir):
    """Labels as converted files: one for each, by quality its content or its summary."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("v-"), i.cast("string")).alias("uid"), F.concat(F.lit("f-"), F.lpad(i.cast("string"), 8, "0")).alias("file_uid"), F.lit("kb").alias("knowledge_base_uid"),
        F.concat(F.lit("path/"), i.cast("string")).alias("storage_path"), F.lit("text/markdown").alias("content_type"), F.when(F.col("quality") == 1, "CONTENT").otherwise("SUMMARY").alias("converted_type"),
    )


CONVERTED = "converted AS (SELECT 'v-' || doc_id AS uid, 'f-' || lpad(doc_id::VARCHAR, 8, '0') AS file_uid, 'path/' || doc_id AS storage_path, CASE WHEN quality = 1 THEN 'CONTENT' ELSE 'SUMMARY' END AS converted_type FROM labels)"


@query(f"WITH {FILES}, {CONVERTED} SELECT file_uid, converted_type, uid FROM converted UNION ALL SELECT uid, 'CONTENT', 'n-' || doc_id FROM files WHERE uid NOT IN (SELECT file_uid FROM converted WHERE converted_type = 'CONTENT')")
def converted_get_or_create(spark, sf_dir):
    new = files(spark, sf_dir).select(F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("uid"), F.col("uid").alias("file_uid"), F.lit("kb").alias("knowledge_base_uid"), F.lit("p").alias("storage_path"), F.lit("text/markdown").alias("content_type"), F.lit("CONTENT").alias("converted_type"))
    return R.converted_get_or_create(converted(spark, sf_dir), new.unionByName(new), [F.col("uid")]).select("file_uid", "converted_type", "uid")


@query(f"WITH {FILES}, {CONVERTED} SELECT f.uid, storage_path FROM live f JOIN converted c ON c.file_uid = f.uid WHERE converted_type = 'CONTENT'")
def content_of_files(spark, sf_dir):
    """Files with the path of their converted content; those without one are skipped."""
    own = converted(spark, sf_dir).where("converted_type = 'CONTENT'").select(F.col("file_uid").alias("uid"), "storage_path")
    return live(files(spark, sf_dir)).select("uid").join(own, "uid")


@query(f"WITH {FILES}, {CONVERTED}, {CHUNKS} SELECT uid FROM chunks WHERE 'v-' || doc_id NOT IN (SELECT uid FROM converted WHERE converted_type = 'SUMMARY' AND file_uid IN (SELECT uid FROM files WHERE kb_uid = 'src3'))")
def delete_old_converted(spark, sf_dir):
    """Chunks that are left when a base's old summaries go."""
    own = chunks(spark, sf_dir).select("uid", F.concat(F.lit("v-"), F.col("doc_id").cast("string")).alias("source_uid"))
    wanted = files(spark, sf_dir).where("kb_uid = 'src3'").select(F.col("uid").alias("file_uid"))
    return R.delete_converted(converted(spark, sf_dir), own, wanted, ["SUMMARY"])[1].select("uid")


VECTORS = "vec AS (SELECT vec_id AS uid, 'f-' || lpad((vec_id % 50)::VARCHAR, 8, '0') AS file_uid, 'label-' || label AS tags, CASE WHEN vec_id % 3 = 0 THEN 'TYPE_PDF' ELSE 'TYPE_TEXT' END AS file_type, CASE WHEN vec_id % 2 = 0 THEN 'document' ELSE 'image' END AS content_type FROM embeddings)"


def vectors(spark, sf_dir):
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("uid"), F.concat(F.lit("f-"), F.lpad((i % 50).cast("string"), 8, "0")).alias("file_uid"), F.array(F.concat(F.lit("label-"), F.col("label").cast("string"))).alias("tags"),
        F.when(i % 3 == 0, "TYPE_PDF").otherwise("TYPE_TEXT").alias("file_type"), F.when(i % 2 == 0, "document").otherwise("image").alias("content_type"), F.concat(F.lit("text "), i.cast("string")).alias("text"),
    )


@query(f"WITH {VECTORS} SELECT uid, CASE file_uid WHEN 'f-00000003' THEN 'new|x' WHEN 'f-00000004' THEN '' ELSE tags END AS tags FROM vec")
def retag_vectors(spark, sf_dir):
    changed = spark.createDataFrame([("f-00000003", ["new", "x"]), ("f-00000004", [])], "file_uid string, tags array<string>")
    return R.retag(vectors(spark, sf_dir), changed).select("uid", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {VECTORS} SELECT uid FROM vec WHERE file_uid NOT IN ('f-00000003', 'f-00000007')")
def delete_vectors_by_file(spark, sf_dir):
    return R.without_files(vectors(spark, sf_dir), spark.createDataFrame([("f-00000003",), ("f-00000007",)], "file_uid string")).select("uid")


@query(f"WITH {VECTORS} SELECT uid, 'text ' || uid AS text FROM vec WHERE uid % 4 <> 0 UNION ALL SELECT uid, substr(repeat('é', 50000), 1, 32767) FROM vec WHERE uid % 4 = 0 UNION ALL SELECT -1 - uid, 'new' FROM vec WHERE uid % 40 = 0")
def upsert_vectors(spark, sf_dir):
    """Changed vectors whose texts are too long for the index, and new ones."""
    v = vectors(spark, sf_dir)
    new = v.where("uid % 4 = 0").withColumn("text", F.repeat(F.lit("é"), F.lit(50_000))).unionByName(v.where("uid % 40 = 0").withColumn("uid", -1 - F.col("uid")).withColumn("text", F.lit("new")))
    return R.upsert_vectors(v, new).select("uid", "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 500)")
def purge_batch(spark, sf_dir):
    """One batch of a purge: at most 500 of the expired objects go, the oldest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_orderdate")
    left = R.delete_some(rows, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), [F.col("o_orderdate"), F.col("uid")], 500)
    return left.select(F.col("uid").alias("o_orderkey"))


@query(f"WITH {FILES} SELECT uid, process_status FROM live WHERE process_status IN ('FILE_PROCESS_STATUS_FAILED', 'FILE_PROCESS_STATUS_NOTSTARTED')")
def reprocess_rule(spark, sf_dir):
    return live(files(spark, sf_dir)).where(R.reprocessable(F.col("process_status"))).select("uid", "process_status")


@query(f"WITH {OWNED} SELECT uid, CASE WHEN delete_time IS NULL AND uid IN (SELECT file_uid FROM own WHERE kb_uid = 'src1') THEN 'FILE_PROCESS_STATUS_NOTSTARTED' ELSE process_status END AS process_status FROM files")
def reset_embeddings(spark, sf_dir):
    f, links, _ = owned(spark, sf_dir)
    return R.reset(f, links, "src1").select("uid", "process_status")


@query(f"WITH {FILES} SELECT uid FROM live WHERE process_status = 'FILE_PROCESS_STATUS_COMPLETED' AND doc_id % 3 = 0")
def patch_only_path(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 3 == 0, '{"x-instill-patch":"true"}').when(F.col("doc_id") % 3 == 1, '{"x-instill-patch":"false"}')
    return live(files(spark, sf_dir)).where(R.patch_only(extra, F.col("process_status"))).select("uid")


@query(f"WITH {FILES}, {CONVERTED} SELECT uid FROM live WHERE doc_id % 4 <> 1 AND uid IN (SELECT file_uid FROM converted WHERE converted_type = 'SUMMARY')")
def alias_backfill(spark, sf_dir):
    """Files whose aliases are to be put in: every fourth one has them."""
    summary = converted(spark, sf_dir).where("converted_type = 'SUMMARY'").select(F.col("file_uid").alias("uid"), "storage_path")
    f = live(files(spark, sf_dir)).join(summary, "uid", "left")
    first = F.when(F.col("doc_id") % 4 == 1, "Rooster (cock)").when(F.col("doc_id") % 4 == 2, "Rooster(cock); Hen")
    return f.where(R.alias_backfill(first, F.col("storage_path"))).select("uid")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, event_id, ts + INTERVAL 2 HOUR AS busy, true AS let FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, s.event_id, CASE WHEN s.ts >= w.busy THEN s.ts + INTERVAL 2 HOUR ELSE w.busy END, s.ts >= w.busy FROM w JOIN s ON s.user_id = w.user_id AND s.k = w.k + 1)
SELECT user_id AS file_uid, event_id::VARCHAR AS uid FROM w WHERE let""")
def one_running_workflow(spark, sf_dir):
    """Events as starts of two hours each: one that comes while another runs isn't let in."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_uid"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("uid"), F.col("ts").cast("timestamp").alias("at"))
    return R.one_running(e.withColumn("until", F.col("at") + F.expr("interval 2 hours"))).select("file_uid", F.col("uid").cast("long").cast("string").alias("uid"))


@query("SELECT l_orderkey, sum(l_linenumber)::BIGINT AS promptTokenCount, sum(l_suppkey)::BIGINT AS candidatesTokenCount, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE floor(l_quantity) END)::BIGINT AS totalTokenCount, 0::BIGINT AS cachedContentTokenCount, count(*) AS callCount FROM lineitem GROUP BY 1")
def batch_usage(spark, sf_dir):
    """Usage of an order's lines, a batch each; some lack a counter or have one that can't be read."""
    usage = F.when(F.col("l_linenumber") == 1, F.format_string('{"promptTokenCount":%d,"candidatesTokenCount":%d,"totalTokenCount":"many","callCount":1}', "l_linenumber", "l_suppkey")).otherwise(F.format_string('{"promptTokenCount":%d,"candidatesTokenCount":%d,"totalTokenCount":%s,"callCount":1}', "l_linenumber", "l_suppkey", F.col("l_quantity").cast("string")))
    return R.batch_usage(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), usage.alias("u")), "l_orderkey", "u")


TAGS = "tag AS (SELECT 'repositories/' || s_nationkey || '/tags/' || s_suppkey AS name, 'sha-' || (s_suppkey % 4) AS digest FROM supplier)"


def repository_tags(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("repositories/"), F.col("s_nationkey").cast("string"), F.lit("/tags/"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("sha-"), (F.col("s_suppkey") % 4).cast("string")).alias("digest"))


@query(f"WITH {TAGS} SELECT name, digest FROM (SELECT name, CASE WHEN name LIKE '%/tags/5' THEN 'sha-new' ELSE digest END AS digest FROM tag UNION ALL SELECT 'repositories/x/tags/1', 'sha-1') WHERE NOT (name LIKE 'repositories/7/tags/%' AND digest = 'sha-1')")
def repository_tag_changes(spark, sf_dir):
    """Tags are put, some anew, and those of one repository that stand for a digest go."""
    old = repository_tags(spark, sf_dir)
    new = old.where(F.endswith("name", F.lit("/tags/5"))).withColumn("digest", F.lit("sha-new")).unionByName(spark.createDataFrame([("repositories/x/tags/1", "sha-1")], "name string, digest string"))
    return R.drop_digest(R.put_tag(old, new), "7", "sha-1").select("name", "digest")


def systems(spark, sf_dir):
    i = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("sys-"), i.cast("string")).alias("uid"), F.concat(F.lit("id-"), F.lower("r_name")).alias("id"), F.when(i == 0, "openai").when(i == 1, "gemini").otherwise(F.lower("r_name")).alias("slug"), (i >= 2).alias("is_default"), F.when(i == 2, now()).alias("delete_time"))


SYSTEMS = f"sys AS (SELECT 'sys-' || r_regionkey AS uid, 'id-' || lower(r_name) AS id, CASE r_regionkey WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' ELSE lower(r_name) END AS slug, r_regionkey >= 2 AS is_default, CASE WHEN r_regionkey = 2 THEN TIMESTAMP '{NOW}' END AS delete_time FROM region)"


@query(f"WITH {SYSTEMS} SELECT 'set' AS kind, uid FROM (SELECT uid FROM sys WHERE is_default AND delete_time IS NULL ORDER BY uid LIMIT 1) UNION ALL SELECT 'unset', uid FROM sys WHERE slug = 'openai'")
def default_system(spark, sf_dir):
    """The default system; where none is set, the one with the fallback's slug."""
    s = systems(spark, sf_dir)
    none = R.default_system(s.withColumn("is_default", F.lit(False)))
    return R.default_system(s).select(F.lit("set").alias("kind"), "uid").unionByName(none.select(F.lit("unset").alias("kind"), "uid"))


@query(f"WITH {SYSTEMS} SELECT row_number() OVER (ORDER BY id) AS place, id, slug FROM sys WHERE delete_time IS NULL AND slug <> 'europe'")
def system_list(spark, sf_dir):
    """Systems in order of their id, after one has been deleted."""
    s = R.drop_system(systems(spark, sf_dir).withColumn("is_default", F.lit(False)), "europe", now())
    # a handful of rows, numbered to show their order
    return C.numbered(live(s).withColumn("one", F.lit(1)), ["one"], [F.col("id")], "place").select("place", "id", "slug")


@query(f"WITH {KBS}, {SYSTEMS} SELECT k.uid, k.display_name, s.id AS system_id, s.slug FROM kbs k JOIN sys s ON s.uid = k.system_uid")
def kb_with_system(spark, sf_dir):
    s = systems(spark, sf_dir).select(F.col("uid").alias("system_uid"), F.col("id").alias("system_id"), "slug")
    return knowledge_bases(spark, sf_dir).join(s, "system_uid").select("uid", "display_name", "system_id", "slug")


@query(f"WITH {KBS}, {SYSTEMS} SELECT k.uid, coalesce(s.id, '') AS system_id FROM (SELECT uid, CASE WHEN usage % 30 = 0 THEN 'gone' ELSE system_uid END AS system_uid FROM kbs) k LEFT JOIN sys s ON s.uid = k.system_uid")
def system_ids(spark, sf_dir):
    """Ids of the bases' systems; of a system that isn't there the empty one."""
    s = systems(spark, sf_dir).select(F.col("uid").alias("system_uid"), F.col("id").alias("system_id"))
    kbs = knowledge_bases(spark, sf_dir).select("uid", F.when(F.col("usage") % 30 == 0, "gone").otherwise(F.col("system_uid")).alias("system_uid"))
    return kbs.join(s, "system_uid", "left").select("uid", F.coalesce("system_id", F.lit("")).alias("system_id"))


@query(f"WITH {KBS} SELECT row_number() OVER (ORDER BY update_time DESC, uid DESC) AS place, uid FROM kbs WHERE NOT staging ORDER BY update_time DESC, uid DESC LIMIT 10")
def kb_list(spark, sf_dir):
    """The bases that changed last."""
    few = knowledge_bases(spark, sf_dir).where("not staging").orderBy(F.col("update_time").desc(), F.col("uid").desc()).limit(10)
    return C.numbered(few.withColumn("one", F.lit(1)), ["one"], [F.col("update_time").desc(), F.col("uid").desc()], "place").select("place", "uid")


@query(f"WITH {LINKS} SELECT row_number() OVER (ORDER BY name, uid) AS place, uid, name FROM entities WHERE uid IN (SELECT entity_uid FROM links WHERE file_uid = 7)")
def entities_by_name(spark, sf_dir):
    """A file's entities in order of their names."""
    own = entity_files(spark, sf_dir).where("file_uid = 7")
    found = entities(spark, sf_dir).join(own, F.col("uid") == F.col("entity_uid"), "left_semi").withColumn("one", F.lit(1))
    return C.numbered(found, ["one"], [F.col("name"), F.col("uid")], "place").select("place", "uid", "name")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_by_key(spark, sf_dir):
    return C.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH {KBS} SELECT uid, uid || '-slug' AS slug FROM kbs UNION ALL SELECT 'new', 'src1-slug-2'")
def create_kb(spark, sf_dir):
    """A base whose slug is free in its owner's scope."""
    old = knowledge_bases(spark, sf_dir).select("uid", F.lit("me").alias("owner"), F.concat("uid", F.lit("-slug")).alias("slug"), F.lit(None).cast("timestamp").alias("delete_time"))
    new = spark.createDataFrame([("new", "me", "src1-slug-2", None)], "uid string, owner string, slug string, delete_time timestamp")
    return R.create_base(old, new).select("uid", "slug")


@query(f"WITH {OWNED} SELECT 'file' AS kind, uid AS name FROM files WHERE uid IN (SELECT file_uid FROM own WHERE kb_uid <> 'src1') OR uid NOT IN (SELECT file_uid FROM own) UNION ALL SELECT 'link ' || kb_uid, file_uid FROM own WHERE kb_uid <> 'src1'")
def cleanup_kb(spark, sf_dir):
    """What is left when a base goes: files that another base links stay."""
    f, links, _ = owned(spark, sf_dir)
    out = R.clean_base({"files": f.select("uid"), "links": links}, "src1")
    return out["files"].select(F.lit("file").alias("kind"), F.col("uid").alias("name")).unionByName(out["links"].select(F.concat(F.lit("link "), F.col("kb_uid")).alias("kind"), F.col("file_uid").alias("name")))


@query(f"WITH {FILES} SELECT uid, uid || ':' AS ids, doc_id % 3 <> 0 AS reserved FROM files WHERE doc_id % 3 = 2 UNION ALL SELECT uid, uid || ':col-' || doc_id || ',col-x', true FROM files WHERE doc_id % 3 = 1 UNION ALL SELECT uid, uid || ':', false FROM files WHERE doc_id % 3 = 0")
def reserved_tags(spark, sf_dir):
    """Collections that tags name, and whether a tag is the system's."""
    i = F.col("doc_id").cast("string")
    tags = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("plain"), F.lit("an agent:collection:z"))).when(F.col("doc_id") % 3 == 1, F.array(F.concat(F.lit("agent:collection:col-"), i), F.lit("agent:collection:"), F.lit("agent:collection:col-x"))).otherwise(F.array(F.lit("instill-own")))
    return files(spark, sf_dir).select("uid", F.concat("uid", F.lit(":"), F.array_join(R.collection_ids(tags), ",")).alias("ids"), R.reserved(tags).alias("reserved"))


@query(f"WITH {FILES} SELECT kb_uid, count(*) AS n FROM live WHERE process_status = 'FILE_PROCESS_STATUS_NOTSTARTED' AND uid NOT IN (SELECT 'f-' || lpad(vec_id::VARCHAR, 8, '0') FROM embeddings WHERE vec_id % 8 = 0) GROUP BY 1")
def count_not_started(spark, sf_dir):
    """Files that wait, without those on a list."""
    known = table(spark, sf_dir, "embeddings").where("vec_id % 8 = 0").select(F.concat(F.lit("f-"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("uid"))
    waiting = live(files(spark, sf_dir)).where("process_status = 'FILE_PROCESS_STATUS_NOTSTARTED'")
    return C.without(waiting, known, "uid").groupBy("kb_uid").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, {CONVERTED} SELECT kb_uid, (SELECT count(*) FROM converted c JOIN live g ON g.uid = c.file_uid WHERE g.kb_uid = f.kb_uid) AS n_converted, (SELECT count(*) FROM embeddings e JOIN live g ON g.doc_id = e.vec_id WHERE g.kb_uid = f.kb_uid) AS n_embeddings FROM live f GROUP BY kb_uid")
def count_kb_converted(spark, sf_dir):
    """Converted files and embeddings of each base's files that aren't deleted."""
    f = live(files(spark, sf_dir)).select("uid", "kb_uid", "doc_id")
    of = lambda rows, on, name: rows.join(f, on).groupBy("kb_uid").agg(F.count("*").alias(name))
    c = of(converted(spark, sf_dir).select(F.col("file_uid").alias("uid")), "uid", "n_converted")
    e = of(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "n_embeddings")
    out = f.select("kb_uid").distinct().join(c, "kb_uid", "left").join(e, "kb_uid", "left")
    return out.select("kb_uid", F.coalesce("n_converted", F.lit(0)).alias("n_converted"), F.coalesce("n_embeddings", F.lit(0)).alias("n_embeddings"))


@query(f"WITH {FILES} SELECT count(*) AS total FROM live WHERE size > 5000 AND list_contains(tags, 'en')")
def page_total(spark, sf_dir):
    """How many rows all pages of a filtered listing have together."""
    return live(files(spark, sf_dir)).where((F.col("size") > 5000) & F.array_contains("tags", "en")).agg(F.count("*").alias("total"))


@query(f"WITH {KBS} SELECT c.uid AS collection, (SELECT count(*) FROM kbs k WHERE NOT k.staging AND coalesce(CASE WHEN k.usage % 20 = 0 THEN 'shared' END, k.uid) = c.uid) > 0 AS in_use FROM (SELECT uid FROM kbs UNION ALL SELECT 'shared') c")
def collection_in_use(spark, sf_dir):
    """A base's active collection is its own unless another is named; staging bases count as deleted here."""
    kbs = knowledge_bases(spark, sf_dir)
    active = kbs.where("not staging").select(F.coalesce(F.when(F.col("usage") % 20 == 0, "shared"), F.col("uid")).alias("collection"))
    every = kbs.select(F.col("uid").alias("collection")).unionByName(spark.createDataFrame([("shared",)], "collection string"))
    return C.counted(every, active, ["collection"], "n").select("collection", (F.col("n") > 0).alias("in_use"))


@query(f"WITH {FILES} SELECT uid, process_status FROM live WHERE process_status IN ('FILE_PROCESS_STATUS_FAILED', 'FILE_PROCESS_STATUS_PROCESSING')")
def multi_status(spark, sf_dir):
    return live(files(spark, sf_dir)).where(C.any_status("FILE_PROCESS_STATUS_FAILED, FILE_PROCESS_STATUS_PROCESSING,")).select("uid", "process_status")


@query(f"WITH {FILES}, {CONVERTED} SELECT uid, kb_uid FROM live WHERE process_status = 'FILE_PROCESS_STATUS_COMPLETED' AND doc_id % 5 IN (1, 3) AND uid NOT IN (SELECT file_uid FROM converted WHERE converted_type = 'SUMMARY') ORDER BY uid LIMIT 100")
def missing_thumbnails(spark, sf_dir):
    """Done files of a type that can be shown and that have no thumbnail yet, a batch by uid; summaries stand for thumbnails."""
    from quillstone.functions.text import file_type, thumbnailable

    name = F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("pdf", "PNG", "mp3", "mov", "svg"))), (F.col("doc_id") % 5 + 1).cast("int")))
    done = live(files(spark, sf_dir)).where((F.col("process_status") == "FILE_PROCESS_STATUS_COMPLETED") & thumbnailable(file_type(name)))
    have = converted(spark, sf_dir).where("converted_type = 'SUMMARY'").select(F.col("file_uid").alias("uid"))
    return C.forward(C.without(done, have, "uid"), 100).select("uid", "kb_uid")
