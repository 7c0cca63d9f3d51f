"""A knowledge base's update and its way back; versions of a table."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import updates as U
from quillstone.sources import versions as V


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def catalog(spark):
    kbs = spark.createDataFrame([("a", None, False, ["prod"], None, None), ("b", "COMPLETED", False, ["prod"], None, None)], "uid string, update_status string, staging boolean, tags array<string>, parent_kb_uid string, rollback_retention_until timestamp")
    files = spark.createDataFrame([("f1", "a"), ("f2", "a"), ("f3", "b")], "uid string, kb_uid string")
    return {"kbs": kbs, "files": files, "chunks": files.withColumn("n", F.lit(1))}


def test_swap_and_back(spark, catalog):
    begun = U.begin(catalog, "a", "s")
    with pytest.raises(ValueError, match="being updated"):
        U.begin(begun, "a", "t")
    begun["files"] = begun["files"].unionByName(spark.createDataFrame([("n1", "s")], "uid string, kb_uid string"))
    until = F.lit("2024-02-01").cast("timestamp")
    done = U.swap_in(begun, "a", "s", "r", until)
    assert {(r.uid, r.kb_uid) for r in done["files"].collect()} == {("f1", "r"), ("f2", "r"), ("f3", "b"), ("n1", "a")}
    assert {r.uid: r.update_status for r in done["kbs"].collect()} == {"a": "COMPLETED", "b": "COMPLETED", "r": None}
    back = U.roll_back(done, "a", "r")
    assert rows(back["files"]) == rows(catalog["files"]) and {r.uid for r in back["kbs"].collect()} == {"a", "b"}
    kept, gone = (U.purge(done, F.lit(d).cast("timestamp")) for d in ("2024-01-31", "2024-02-02"))
    assert rows(kept["files"]) == rows(done["files"]) and {r.kb_uid for r in gone["files"].collect()} == {"a", "b"} and {r.uid for r in gone["kbs"].collect()} == {"a", "b"}
    assert rows(U.abort(begun, "a", "s")["files"]) == rows(catalog["files"])


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert V.current(spark, folder) is None
    assert V.write(spark.range(3).toDF("n"), folder) == 1
    assert V.write(V.current(spark, folder).where("n > 0"), folder) == 2
    (tmp_path / "t" / "v=3").mkdir()  # an unfinished writing
    assert V.current(spark, folder).count() == 2
    V.write(V.current(spark, folder), folder)
    V.expire(spark, folder, 1)
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["v=3"]
