"""The catalog's tables, made from the generic test tables; in Spark, and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.postings import SparseIndex
from quillstone.sources.shared import once

STATUSES = ("FILE_PROCESS_STATUS_NOTSTARTED", "FILE_PROCESS_STATUS_PROCESSING", "FILE_PROCESS_STATUS_COMPLETED", "FILE_PROCESS_STATUS_FAILED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("f-"), F.lpad(i.cast("string"), 8, "0")).alias("uid"),
        F.concat(F.lit("file-"), F.substring(F.sha2(i.cast("string"), 256), 1, 8)).alias("id"),
        F.concat("lang", F.lit(" report "), i.cast("string")).alias("display_name"),
        F.col("source").alias("kb_uid"),
        F.array("lang", "source").alias("tags"),
        F.array(F.concat(F.lit("alias-"), i.cast("string"))).alias("aliases"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (i % 4 + 1).cast("int")).alias("process_status"),
        F.when(i % 3 == 0, "VISIBILITY_WORKSPACE").otherwise("VISIBILITY_PRIVATE").alias("visibility"),
        F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_sha256"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("create_time"),
        F.timestamp_seconds(F.lit(1706745600) + (i % 97) * 3600).alias("update_time"),
        F.when(i % 50 == 7, F.timestamp_seconds(F.lit(1709251200) + i)).alias("delete_time"),
        F.format_string('{"content":{"totalTokenCount":%d},"summary":{"totalTokenCount":%d}}', F.col("n_chars"), i).alias("usage_metadata"),
        i.alias("doc_id"),
    )


FILES = """files AS (
  SELECT 'f-' || lpad(doc_id::VARCHAR, 8, '0') AS uid, 'file-' || substr(sha256(doc_id::VARCHAR), 1, 8) AS id,
    lang || ' report ' || doc_id AS display_name, source AS kb_uid, [lang, source] AS tags, ['alias-' || doc_id] AS aliases,
    ['FILE_PROCESS_STATUS_NOTSTARTED', 'FILE_PROCESS_STATUS_PROCESSING', 'FILE_PROCESS_STATUS_COMPLETED', 'FILE_PROCESS_STATUS_FAILED'][doc_id % 4 + 1] AS process_status,
    CASE WHEN doc_id % 3 = 0 THEN 'VISIBILITY_WORKSPACE' ELSE 'VISIBILITY_PRIVATE' END AS visibility, n_chars AS size, text AS content,
    sha256(text) AS content_sha256, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS create_time,
    TIMESTAMP '2024-02-01' + to_seconds((doc_id % 97) * 3600) AS update_time,
    CASE WHEN doc_id % 50 = 7 THEN TIMESTAMP '2024-03-01' + to_seconds(doc_id) END AS delete_time, doc_id
  FROM documents
), live AS (SELECT * FROM files WHERE delete_time IS NULL)"""


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(F.col("delete_time").isNull())


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line of a file's text."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("in_order", "text"))
        .select(
            F.concat_ws("-", F.lit("c"), "doc_id", "in_order").alias("uid"),
            F.concat(F.lit("f-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("file_uid"),
            F.col("source").alias("kb_uid"),
            F.col("in_order").cast("long").alias("in_order"),
            F.expr("octet_length(text) div 4").cast("long").alias("tokens"),
            F.when((F.col("doc_id") + F.col("in_order")) % 5 == 0, "TYPE_SUMMARY").otherwise("TYPE_CONTENT").alias("chunk_type"),
            ((F.col("doc_id") + F.col("in_order")) % 7 != 0).alias("retrievable"),
            "doc_id",
            "text",
        )
    )


CHUNKS = """chunks AS (
  SELECT 'c-' || doc_id || '-' || in_order AS uid, 'f-' || lpad(doc_id::VARCHAR, 8, '0') AS file_uid, source AS kb_uid, in_order::BIGINT AS in_order,
    (octet_length(encode(line)) // 4)::BIGINT AS tokens, CASE WHEN (doc_id + in_order) % 5 = 0 THEN 'TYPE_SUMMARY' ELSE 'TYPE_CONTENT' END AS chunk_type,
    (doc_id + in_order) % 7 <> 0 AS retrievable, doc_id, line AS text
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS in_order FROM documents)
)"""


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each source; every fourth is a staging copy of the one before it."""
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.regexp_extract("source", r"(\d+)", 1).cast("long"))
    return s.select(
        F.col("source").alias("uid"),
        F.concat(F.lit("kb-"), F.substring(F.sha2("source", 256), 1, 8)).alias("id"),
        F.concat(F.lit("Knowledge base "), F.col("n").cast("string")).alias("display_name"),
        F.when(F.col("n") % 4 == 3, F.array(F.lit("staging"))).otherwise(F.array(F.lit("prod"), F.concat(F.lit("team-"), (F.col("n") % 3).cast("string")))).alias("tags"),
        (F.col("n") % 4 == 3).alias("staging"),
        F.when(F.col("n") % 4 == 3, F.concat(F.lit("src"), (F.col("n") - 1).cast("string"))).alias("parent_kb_uid"),
        F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("UPDATING", "COMPLETED", "FAILED", "SWAPPING", "ROLLED_BACK"))), (F.col("n") % 6 + 1).cast("int")).alias("update_status"),
        F.when(F.col("n") % 5 != 0, F.timestamp_seconds(F.lit(1706745600) + F.col("n") * 86400)).alias("rollback_retention_until"),
        F.concat(F.lit("sys-"), (F.col("n") % 2).cast("string")).alias("system_uid"),
        (F.col("n") * 10).alias("usage"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 3600).alias("update_time"),
    )


KBS = """kbs AS (
  SELECT source AS uid, 'kb-' || substr(sha256(source), 1, 8) AS id, 'Knowledge base ' || n AS display_name,
    CASE WHEN n % 4 = 3 THEN ['staging'] ELSE ['prod', 'team-' || (n % 3)] END AS tags, n % 4 = 3 AS staging,
    CASE WHEN n % 4 = 3 THEN 'src' || (n - 1) END AS parent_kb_uid,
    [NULL, 'UPDATING', 'COMPLETED', 'FAILED', 'SWAPPING', 'ROLLED_BACK'][n % 6 + 1] AS update_status,
    CASE WHEN n % 5 <> 0 THEN TIMESTAMP '2024-02-01' + to_seconds(n * 86400) END AS rollback_retention_until, 'sys-' || (n % 2) AS system_uid,
    n * 10 AS usage, TIMESTAMP '2024-01-01' + to_seconds(n * 3600) AS update_time
  FROM (SELECT DISTINCT source, regexp_extract(source, '(\\d+)', 1)::BIGINT AS n FROM documents)
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("kb_uid"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))


def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem links a part, as an entity, to its order, as a file."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_uid"), F.col("l_orderkey").alias("file_uid")).distinct()


LINKS = """entities AS (SELECT p_partkey AS uid, p_brand AS kb_uid, p_name AS name, p_type AS entity_type FROM part),
links AS (SELECT DISTINCT l_partkey AS entity_uid, l_orderkey AS file_uid FROM lineitem)"""


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a collection's rows, with the text and tags of the document of the same number."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding", F.concat(F.lit("group-"), F.col("label").cast("string")).alias("file_uid"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text", F.array("lang", "source").alias("tags"), F.lit("chunk").alias("source_table"))
    return e.join(d, "uid")


def sparse_index(spark: SparkSession, sf_dir: str) -> SparseIndex:
    """The collection with stored postings, made at the first call of an application."""
    return SparseIndex(spark, once(spark, "postings", sf_dir, lambda folder: SparseIndex(spark, folder).add(vector_index(spark, sf_dir))))


INDEX = """idx AS (
  SELECT e.vec_id AS uid, e.embedding::DOUBLE[] AS embedding, 'group-' || e.label AS file_uid, d.text, [d.lang, d.source] AS tags
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
)"""
