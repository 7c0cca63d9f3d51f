"""Blobs from a folder, with missing ones, and webhooks."""

from pyspark.sql import functions as F

from quillstone.sources import files as S


def test_blobs(spark, tmp_path):
    for name in ("a.md", "b.md", "c.bin"):
        (tmp_path / name).write_bytes(name.encode())
    folder = str(tmp_path)
    assert S.blobs(spark, folder, "*.md").count() == 2
    wanted = spark.createDataFrame([(f"{folder}/a.md",), (f"{folder}/none",)], "path string")
    out = {r.path.rsplit("/", 1)[1]: r for r in S.fetch(wanted, S.blobs(spark, folder)).collect()}
    assert bytes(out["a.md"].content) == b"a.md" and out["a.md"].error is None and out["none"].content is None and "none" in out["none"].error
    assert {r.path.rsplit("/", 1)[1]: r.length for r in S.listing(spark, folder, "/c").collect()} == {"c.bin": 5}


def test_webhooks(spark):
    one = lambda name, bucket: '{"Records":[{"eventTime":"2024-01-01T00:00:00Z","eventName":"%s","s3":{"bucket":{"name":"%s"},"object":{"key":"k","size":3}}}]}' % (name, bucket)
    lines = spark.createDataFrame([(one("Put", "b"),), (one("Put", "core-milvus"),), (one("s3:ILMExpiry:x", "b"),), ("no json",), (None,)], "value string")
    assert [(r.event, r.bucket, r.size) for r in S.audit_events(lines).collect()] == [("Put", "b", 3)]


def test_expiring(spark):
    keys = spark.createDataFrame([("a", 0), ("b", 59), ("c", 61)], "k string, s int").withColumn("expire_at", F.timestamp_seconds("s"))
    assert {r.k for r in S.expiring(keys, F.timestamp_seconds(F.lit(0))).collect()} == {"a", "b"}
