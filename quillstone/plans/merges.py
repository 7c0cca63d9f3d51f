"""Queries over table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import merges as M
from quillstone.operators.catalog import first_by, numbered
from quillstone.plans.adapters import FILES, KBS, LINKS, entities, entity_files, files, knowledge_bases, table
from quillstone.plans.registry import query


@query(f"WITH {FILES} SELECT kb_uid, content_sha256, min(uid) AS uid FROM files GROUP BY 1, 2")
def dedup_by_sha_keep_oldest(spark, sf_dir):
    return first_by(files(spark, sf_dir), ["kb_uid", "content_sha256"], [F.col("create_time"), F.col("uid")]).select("kb_uid", "content_sha256", "uid")


@query("SELECT o_orderkey, o_custkey, CASE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) WHEN 1 THEN 'content' WHEN 2 THEN 'summary' ELSE 'other' END AS kind FROM orders")
def first_second_by_time(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("o_orderkey", "o_custkey", F.when(F.col("rn") == 1, "content").when(F.col("rn") == 2, "summary").otherwise("other").alias("kind"))


@query("SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2")
def keep_newest_per_type(spark, sf_dir):
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderpriority", "o_orderkey")


OLD = "old_ AS (SELECT p_brand AS kb_uid, p_name AS name, min(p_type) AS entity_type, [min(p_name)] AS aliases FROM part WHERE p_size <= 30 GROUP BY 1, 2)"
NEW = "new_ AS (SELECT p_brand AS kb_uid, p_name AS name, CASE WHEN min(p_size) > 40 THEN '' ELSE max(p_type) END AS entity_type, ['alias ' || min(p_size)] AS aliases FROM part WHERE p_size > 20 GROUP BY 1, 2)"


def entity_sides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = [F.col("p_brand").alias("kb_uid"), F.col("p_name").alias("name")]
    old = part.where("p_size <= 30").groupBy(*keys).agg(F.min("p_type").alias("entity_type"), F.array(F.min("p_name")).alias("aliases"))
    new = part.where("p_size > 20").groupBy(*keys).agg(F.when(F.min("p_size") > 40, "").otherwise(F.max("p_type")).alias("entity_type"), F.array(F.concat(F.lit("alias "), F.min("p_size").cast("string"))).alias("aliases"))
    return old, new


@query(f"WITH {OLD}, {NEW} SELECT coalesce(o.kb_uid, n.kb_uid) AS kb_uid, coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.entity_type ELSE o.entity_type END AS entity_type, array_to_string(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])), '|') AS aliases FROM old_ o FULL JOIN new_ n ON o.kb_uid = n.kb_uid AND o.name = n.name")
def upsert_entities(spark, sf_dir):
    out = M.upsert_entities(*entity_sides(spark, sf_dir))
    return out.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH {OLD}, {NEW} SELECT kb_uid, name, entity_type FROM old_ UNION ALL SELECT kb_uid, name, entity_type FROM new_ n WHERE NOT EXISTS (SELECT 1 FROM old_ o WHERE o.kb_uid = n.kb_uid AND o.name = n.name)")
def insert_ignore(spark, sf_dir):
    old, new = (d.select("kb_uid", "name", "entity_type") for d in entity_sides(spark, sf_dir))
    return M.insert_ignore(old, new, ["kb_uid", "name"], [F.col("entity_type")])


@query(f"WITH {OLD}, {NEW} SELECT kb_uid, name, entity_type FROM new_ UNION ALL SELECT kb_uid, name, entity_type FROM old_ o WHERE NOT EXISTS (SELECT 1 FROM new_ n WHERE o.kb_uid = n.kb_uid AND o.name = n.name)")
def upsert_rows(spark, sf_dir):
    old, new = (d.select("kb_uid", "name", "entity_type") for d in entity_sides(spark, sf_dir))
    return M.upsert(old, new, ["kb_uid", "name"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def replace_by_source(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    return M.replace_by_source(old, new, ["l_orderkey"])


@query("SELECT c_custkey, coalesce(o.best, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def bulk_update(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return M.bulk_update(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), best, "c_custkey", "c_acctbal")


@query(f"WITH {LINKS} SELECT uid, name FROM entities WHERE uid IN (SELECT entity_uid FROM links WHERE file_uid <> 11)")
def delete_orphans(spark, sf_dir):
    _, kept = M.delete_with_orphans(entity_files(spark, sf_dir), entities(spark, sf_dir), 11)
    return kept.select("uid", "name")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END AS kb_uid FROM lineitem")
def swap_resources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kb_uid"))
    return M.swap(rows, "kb_uid", "A", "R")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Z' ELSE l_returnflag END AS kb_uid FROM lineitem")
def move_resources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kb_uid"))
    return M.move(rows, "kb_uid", "A", "Z")


@query("WITH l AS (SELECT DISTINCT l_orderkey AS file_uid, l_returnflag AS kb_uid FROM lineitem) SELECT 'link' AS kind, file_uid, kb_uid FROM (SELECT file_uid, kb_uid FROM l UNION SELECT file_uid, 'R' FROM l WHERE kb_uid = 'N') UNION ALL SELECT 'chunk', l_orderkey * 10 + l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'R' ELSE l_returnflag END FROM lineitem")
def copy_junction(spark, sf_dir):
    """Files of one side are linked to the other too, where they aren't yet; their chunks go over."""
    rows = table(spark, sf_dir, "lineitem").withColumn("kb_uid", F.col("l_returnflag"))
    links = rows.select(F.col("l_orderkey").alias("file_uid"), "kb_uid").distinct()
    links, (chunks,) = M.copy_and_move(links, [rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_uid"), "kb_uid")], "N", "R")
    return links.select(F.lit("link").alias("kind"), "file_uid", "kb_uid").unionByName(chunks.select(F.lit("chunk").alias("kind"), "file_uid", "kb_uid"))


@query(f"WITH {KBS}, {FILES} SELECT uid, usage + coalesce((SELECT sum(size) FROM live f WHERE f.kb_uid = k.uid), 0)::BIGINT AS usage FROM kbs k")
def counter_increment(spark, sf_dir):
    deltas = files(spark, sf_dir).where("delete_time is null").select(F.col("kb_uid").alias("uid"), "size")
    return M.add_to_counter(knowledge_bases(spark, sf_dir), deltas, "uid", "usage", "size").select("uid", "usage")


@query(f"WITH {FILES} SELECT uid, delete_time FROM files WHERE delete_time IS NOT NULL UNION ALL SELECT uid, TIMESTAMP '2024-06-01' FROM live WHERE kb_uid = 'src2'")
def soft_delete_live(spark, sf_dir):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return M.soft_delete(files(spark, sf_dir), F.col("kb_uid") == "src2", now).where("delete_time is not null").select("uid", "delete_time")


@query(f"WITH {KBS} SELECT id, id = 'kb-' || substr(sha256('src4'), 1, 8) AS is_default FROM kbs")
def single_default(spark, sf_dir):
    wanted = F.concat(F.lit("kb-"), F.substring(F.sha2(F.lit("src4"), 256), 1, 8))
    return M.single_default(knowledge_bases(spark, sf_dir).withColumn("is_default", F.lit(True)), wanted).select("id", "is_default")


@query("WITH n AS (SELECT l_suppkey, CASE WHEN count(*) % 2 = 0 THEN round(max(l_extendedprice), 2) ELSE 0 END AS t, CASE WHEN count(*) % 3 = 0 THEN 'told ' || l_suppkey ELSE '' END AS m, CASE WHEN count(*) % 2 = 1 THEN 'pipe' ELSE '' END AS p, count(*) AS k FROM lineitem GROUP BY 1) SELECT s_suppkey, CASE WHEN t <> 0 THEN t ELSE s_acctbal END AS time, CASE WHEN m <> '' THEN m ELSE s_name END AS message, CASE WHEN l_suppkey IS NULL THEN 'old' ELSE p END AS pipe, CASE WHEN k % 5 = 0 THEN k::VARCHAR ELSE '7.50' END AS pages FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey")
def metadata_merge(spark, sf_dir):
    """Times, messages and a decimal count are kept where the new ones are zero or empty; the pipeline's name is always the new one."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("k"), F.max("l_extendedprice").alias("x"))
    new = n.select(
        "s_suppkey", F.when(F.col("k") % 2 == 0, F.round("x", 2)).otherwise(0.0).alias("time"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("told "), F.col("s_suppkey").cast("string"))).otherwise("").alias("message"),
        F.when(F.col("k") % 2 == 1, "pipe").otherwise("").alias("pipe"), F.when(F.col("k") % 5 == 0, F.col("k")).otherwise(0).cast("decimal(38,18)").alias("pages"),
    )
    old = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("time"), F.col("s_name").alias("message"), F.lit("old").alias("pipe"), F.lit("7.5").cast("decimal(38,18)").alias("pages"))
    out = M.merge_non_zero(old, new, "s_suppkey", ["time", "message", "pages"], ["pipe"])
    return out.withColumn("pages", F.when(F.col("pages") == 7.5, "7.50").otherwise(F.col("pages").cast("long").cast("string")))


@query("SELECT doc_id, length(text) AS n, octet_length(encode(text)) <= 200 AS whole FROM (SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE (SELECT substr(text, 1, max(i)) FROM generate_series(1, 200) g(i) WHERE octet_length(encode(substr(text, 1, i))) <= 200) END AS text, octet_length(encode(text)) FROM documents)")
def truncate_bytes(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", M.truncate_bytes("text", 200).alias("t"))
    return cut.select("doc_id", F.length("t").cast("long").alias("n"), (F.expr("octet_length(t)") <= 200).alias("whole"))
