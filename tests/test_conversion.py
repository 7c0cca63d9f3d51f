"""Blobs, ranges of pages, recordings in parts, the update workflow, and small rules of tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import lifecycle as L
from quillstone.operators import ranges as G
from quillstone.operators import records as R
from quillstone.operators import results as V
from quillstone.operators import transcripts as T
from quillstone.operators import workflow as W
from quillstone.plans.catalog import LIST_FILTER
from quillstone.plans.filters import FilterError
from quillstone.sources import blobs as B


def test_blobs(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    B.write(spark.createDataFrame([("a/1.txt", b"one"), ("a/b/2.txt", b""), ("ab.txt", None), ("c/3.txt", "é".encode())], "path string, content binary"), root)
    named = lambda *p: {(r.path, r.length) for r in B.listing(spark, root, p).collect()}
    assert named("") == {("a/1.txt", 3), ("a/b/2.txt", 0), ("ab.txt", 0), ("c/3.txt", 2)}
    assert named("a") == {("a/1.txt", 3), ("a/b/2.txt", 0), ("ab.txt", 0)} and named("a/", "a/b", "c/") == {("a/1.txt", 3), ("a/b/2.txt", 0), ("c/3.txt", 2)}
    assert named("none/") == set() and B.listing(spark, root, ("a/", "c/")).rdd.getNumPartitions() == 2
    wanted = spark.createDataFrame([("a/1.txt", 1), ("a/1.txt", 2), ("a", 3), ("x/y", 4), (None, 5), ("c/3.txt", 6)], "path string, error int")
    got = {(r.path, None if r.content is None else bytes(r.content), r.error) for r in B.fetch_all(wanted, root).collect()}
    assert got == {("a/1.txt", b"one", None), ("a", None, "no blob at a"), ("x/y", None, "no blob at x/y"), (None, None, "no blob at null"), ("c/3.txt", "é".encode(), None)}
    stats = {r.path: (r.length, r.error) for r in B.stat(wanted, root).collect()}
    assert stats["c/3.txt"] == (2, None) and stats["a"] == (None, "no blob at a")
    assert B.fetch_all(wanted.where("path = ''"), root).count() == 0


def test_ranges_are_halved_until_no_page_is_missing(spark):
    asked = []

    def ask(frontier):
        asked.append(sorted((r["first"], r["last"]) for r in frontier.where("id = 1").collect()))
        pages = F.array_join(F.transform(F.sequence("first", "last"), lambda p: F.when((p == 6) & (F.col("last") > F.col("first")), "untagged").otherwise(F.concat(F.lit("[Page: "), p.cast("string"), F.lit("]\nx")))), "\n")
        bad = F.when(F.col("id") == 2, "PERMISSION").when((F.col("id") == 3) & (F.col("last") > F.col("first")), "context DEADLINE_EXCEEDED")
        return frontier.select("id", "first", "last", F.when(bad.isNull(), pages).alias("text"), bad.alias("error"))

    parts = G.converted(spark.createDataFrame([(1, 1, 8), (2, 1, 3), (3, 1, 12), (4, 6, 6)], "id int, first int, last int"), ask, "id")
    assert asked == [[(1, 8)], [(1, 4), (5, 8)], [(5, 6), (7, 8)], [(5, 5), (6, 6)], []] or asked == [[(1, 8)], [(1, 4), (5, 8)], [(5, 6), (7, 8)], [(5, 5), (6, 6)]]
    out = {r.id: (r.text, r.error) for r in G.joined(parts, "id").collect()}
    assert out[1][0].count("[Page: ") == 8 and "untagged" not in out[1][0] and out[1][0].startswith("[Page: 1]\nx\n[Page: 2]") and "x\n\n[Page: 5]" in out[1][0]
    assert out[2] == (None, "PERMISSION")
    assert out[3] == (None, "context DEADLINE_EXCEEDED")  # at three pages it isn't halved any more
    assert out[4] == ("[Page: 6]\nx", None)


def test_a_single_page_gets_its_tag(spark):
    parts = G.converted(spark.createDataFrame([(1, 2, 3)], "id int, first int, last int"), lambda f: f.select("id", "first", "last", F.lit("plain").alias("text"), F.lit(None).cast("string").alias("error")), "id")
    assert G.joined(parts, "id").first()["text"] == "[Page: 2]\nplain\n\n[Page: 3]\nplain"


def parts(spark, *rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "id string, part int, text string, by int, overlap int")


def test_recordings_are_assembled(spark):
    got = T.assembled_media(parts(
        spark,
        ("preface\n[Audio: 0:05] a\n[Audio: 00:00:50] b\n[Page: 1]", 0, 0),
        ("lost\n[Audio: 0:01] told before\nof it\n[Audio: 0:20] c\nmore", 60, 40),
        ("[Audio: 0:10] on\n[Audio: 0:01] back", 60, 0),
        (None, 60, 0),
        ("[Video: 1:00 - 1:05] d", 120, 0),
    ), "id").first()
    # of the second part's overlap, which ends at 1:40, lines up to 0:20 are before 1:25 and go with all above them
    assert got["text"] == "preface\n[Audio: 0:05] a\n[Audio: 00:00:50] b\n\nmore\n\n[Audio: 00:01:10] on\n\n\n\n[Video: 00:03:00 - 00:03:05] d"
    assert got["dropped"] == 1 and got["length"] == len(got["text"])
    assert T.assembled_media(parts(spark, (None, 0, 0)), "id").first()["text"] == ""
    assert T.assembled_media(parts(spark).limit(0), "id").count() == 0


CATALOG = "uid string, update_status string, staging boolean, tags array<string>, parent_kb_uid string, rollback_retention_until timestamp"


def start(spark, folder):
    run = W.Run(spark, f"file://{folder}")
    kbs = spark.createDataFrame([("a", None, False, ["prod"], None, None)], CATALOG)
    held = spark.createDataFrame([(f"f{i}", "a", f"n{i}", None, None) for i in range(4)], "uid string, kb_uid string, display_name string, create_time timestamp, delete_time timestamp")
    made = held.select(F.col("uid").alias("file_uid"), "kb_uid")
    run.start({"kbs": kbs, "files": held, "chunks": made, "embeddings": made, "converted": made})
    return run


def process(new):
    made = new.select(F.col("uid").alias("file_uid"), "kb_uid")
    return {"chunks": made, "embeddings": made, "converted": made}


def until():
    return F.lit("2025-01-01").cast("timestamp")


def test_an_update_goes_on_where_it_was_ended(spark, tmp_path):
    run, calls = start(spark, tmp_path), []

    def fails_twice(new):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("the service is away")
        return process(new)

    for _ in range(2):
        with pytest.raises(RuntimeError):
            W.update(run, "a", fails_twice, until())
        assert run.state()[0] == "PREPARED" and run.tables()["files"].count() == 4
    assert W.update(run, "a", fails_twice, until()) == "SWAPPED"
    c = run.tables()
    assert {(r.uid, r.kb_uid) for r in c["files"].collect()} == {(f"f{i}", "a-rollback") for i in range(4)} | {(f"f{i}+", "a") for i in range(4)}
    assert {r.uid: r.update_status for r in c["kbs"].collect()} == {"a": "COMPLETED", "a-rollback": None}
    assert W.update(run, "a", fails_twice, until()) == "SWAPPED"  # nothing left to do


def test_an_update_whose_sides_differ_fails(spark, tmp_path):
    run = start(spark, tmp_path)
    no_vectors = lambda new: process(new) | {"embeddings": process(new)["embeddings"].limit(1)}
    assert W.update(run, "a", no_vectors, until()) == "FAILED"
    c = run.tables()
    kb = c["kbs"].first()
    assert (kb.uid, kb.update_status, kb.update_error_message) == ("a", "FAILED", "embeddings and chunks differ") and c["kbs"].count() == 1 and c["files"].count() == 4
    with pytest.raises(ValueError, match="can't be updated"):
        busy = start(spark, tmp_path / "b")
        busy.commit("NEW", {"kbs": busy.tables()["kbs"].withColumn("update_status", F.lit("UPDATING"))})
        W.update(busy, "a", process, until())


def test_metadata_keeps_its_types(spark):
    given = ['{"n":1,"o":{"b":[1,2]},"t":true,"z":null,"m":"old"}', "[1]", "7", "no json", None, "{}"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(R.with_field(F.col("j"), "m", F.lit('a"b'))).collect()]
    m = {"m": 'a"b'}
    assert [json.loads(g) if g != "no json" else g for g in got] == [{"n": 1, "o": {"b": [1, 2]}, "t": True, "z": None} | m, [1, m], [7, m], "no json", m, m]


def test_refused_media_and_chunks():
    assert V.media_type(None) is V.media_type("TYPE_UNSPECIFIED") is None and V.media_type("TYPE_DOCUMENT") == "document"
    assert V.chunk_type("") is None and V.chunk_type("TYPE_AUGMENTED") == "TYPE_AUGMENTED"
    for f, bad in ((V.media_type, ("TYPE_IMAGE", "TYPE_AUDIO", "TYPE_VIDEO", "documents")), (V.chunk_type, ("TYPE_OTHER", "content"))):
        for x in bad:
            with pytest.raises(V.Unsupported):
                f(x)


def test_a_listing_is_filtered_by_its_fields_only(spark):
    for field in ("uid", "id", "processStatus", "process_status"):
        LIST_FILTER.compile(f'{field} = "x"')
    LIST_FILTER.compile('q = "x" AND tags : "y"')
    for field in ("display_name", "size", "update_time", "usage_metadata.n", "kb_uid", "visibility", "create_time"):
        with pytest.raises(FilterError):
            LIST_FILTER.compile(f'{field} = "x"')


def test_integrity_of_files_that_are_not_there(spark):
    files = spark.createDataFrame([("a", "k", "FILE_PROCESS_STATUS_COMPLETED")], "uid string, kb_uid string, process_status string")
    none = spark.createDataFrame([], "file_uid string")
    asked = spark.createDataFrame([("a",), ("gone",), ("gone",)], "uid string")
    assert {(r.uid, r.state, r.action) for r in L.integrity(files, none, none, none, asked).collect()} == {("a", "EMPTY_PG", "REPROCESS"), ("gone", "FILE_NOT_FOUND", "SKIP")}


def test_configurations(spark):
    schema = "uid string, id string, slug string, config string, is_default boolean, delete_time timestamp"
    full = '{"rag":{"embedding":{"model_family":"gemini","dimensionality":768.0}}}'
    systems = spark.createDataFrame([("1", "x", "x", full, False, None), ("2", "y", "openai", '{"rag":{"embedding":{"dimensionality":null}}}', False, None), ("3", "z", "z", "not json", False, None)], schema)
    asked = spark.createDataFrame([("x",), ("z",), ("none",), (None,)], "system_id string")
    got = {r.system_id: (r.model_family, r.dimensionality) for r in R.configs_of(asked, systems).collect()}
    assert got == {"x": ("gemini", 768), "z": ("openai", 1536), "none": ("", 0), None: ("", 0)}
    assert {r.model_family for r in R.configs_of(asked, systems.limit(0)).collect()} == {"openai"}
    held = systems.withColumns({c: F.lit(None).cast("timestamp") for c in ("create_time", "update_time")}).withColumns({"display_name": F.col("id"), "description": F.lit("")})
    with pytest.raises(ValueError, match="no system nope"):
        R.update_systems(held, spark.createDataFrame([("nope", "{}")], "id string, config string"), F.current_timestamp())
    with pytest.raises(ValueError, match="protected"):
        R.rename_system(held, "y", "other")


def test_names(spark):
    df = spark.createDataFrame([("namespaces/n/knowledge-bases/k/files/f",), ("namespaces/n/files/f",), ("namespaces/n/files/f/x",), ("x/repositories/a/b/tags/t/y",), (None,)], "n string")
    got = [(r.f and tuple(r.f), r.t and tuple(r.t)) for r in df.select(X.file_of(F.col("n")).alias("f"), X.tag_of(F.col("n")).alias("t")).collect()]
    assert got == [(("n", "k", "f"), None), (("n", "", "f"), None), (None, None), (None, ("a/b", "t")), (None, None)]
