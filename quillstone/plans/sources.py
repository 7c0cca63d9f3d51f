"""Queries over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.registered import register
from quillstone.plans.adapters import FILES, files, table
from quillstone.plans.registry import query
from quillstone.sources import files as S


@query("SELECT event_id, event_type AS event, 'bucket-' || (user_id % 3) AS bucket, floor(value)::BIGINT AS size FROM events WHERE event_type <> 'error' AND user_id % 3 <> 1")
def audit_ingest(spark, sf_dir):
    """Events as webhooks of an object store; failed ones and one bucket are left out."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    line = F.to_json(F.struct(F.array(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.col("event_type").alias("eventName"), F.struct(F.struct(F.when(F.col("user_id") % 3 == 1, "core-milvus").otherwise(F.concat(F.lit("bucket-"), (F.col("user_id") % 3).cast("string"))).alias("name")).alias("bucket"), F.struct(F.col("event_id").cast("string").alias("key"), F.floor("value").cast("long").alias("size")).alias("object")).alias("s3"))).alias("Records")))
    return S.audit_events(e.select(line.alias("value"))).select(F.col("key").cast("long").alias("event_id"), "event", "bucket", "size")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01 00:00:00' + INTERVAL 1 MINUTE ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def ttl_scan(spark, sf_dir):
    """One batch of a cleanup: at most 1000 keys that end within a minute."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("expire_at"))
    return S.expiring(keys, F.lit("1995-06-01 00:00:00").cast("timestamp")).orderBy("expire_at", "o_orderkey").limit(1000).select("o_orderkey")


@query(f"WITH {FILES} SELECT uid, display_name FROM files WHERE uid IN ('f-00000003', 'f-00000007', 'f-99999999')")
def projected_lookup(spark, sf_dir):
    return S.lookup(files(spark, sf_dir), ["f-00000003", "f-00000007", "f-99999999"], "uid", "display_name")


@query("SELECT * FROM nation")
def table_scan(spark, sf_dir):
    return table(spark, sf_dir, "nation")


@query("SELECT doc_id, octet_length(encode(text)) // 4 AS tokens, lower(regexp_replace(regexp_replace(regexp_replace(source || ' No. ' || doc_id, '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')) AS slug FROM documents")
def registered_functions(spark, sf_dir):
    """The library's functions by name in SQL."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("registered_documents")
    return spark.sql("SELECT doc_id, quill_tokens(text) AS tokens, quill_slug(concat(source, ' No. ', doc_id)) AS slug FROM registered_documents")


@query("SELECT doc_id, part::INT AS part, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS part FROM documents)")
def registered_chunker(spark, sf_dir):
    """The chunker as a table function; no line of the test tables is too long to be one chunk."""
    register(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows.createOrReplaceTempView("registered_lines")
    return spark.sql("SELECT doc_id, i + 1 AS part, md5(c.text) AS line FROM registered_lines, LATERAL quill_chunks(line) c")
