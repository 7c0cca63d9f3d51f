"""State machines over late and repeated events, in several runs from one checkpoint, against one run and plain Python."""

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.streaming import machine as M
from quillstone.streaming import status as S

SCHEMA = "key long, ts timestamp, id long, value string"
START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
DONE, FAILED, BUSY = "FILE_PROCESS_STATUS_COMPLETED", "FILE_PROCESS_STATUS_FAILED", "FILE_PROCESS_STATUS_PROCESSING"


def events(n=120, seed=4):
    """In order of time, over some hours."""
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([5, 40, 200, 700])
        out.append((rng.randrange(4), START + datetime.timedelta(seconds=at), i, rng.choice([DONE, FAILED, BUSY, BUSY])))
    return out


def late(rows, seed=1):
    """Three files: rows arrive up to nine minutes late, and some come twice."""
    rng = random.Random(seed)
    arrival = sorted(((r[1] + datetime.timedelta(seconds=rng.randrange(540)), r) for r in rows + rng.sample(rows, 30)), key=lambda x: x[0])
    rows = [r for _, r in arrival]
    return [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]


def run(spark, folder, machine):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = M.run_appended(M.through(stream, machine), f"{folder}/out", f"{folder}/state")
    return sorted((r.key, M.millis(r.at.replace(tzinfo=datetime.timezone.utc)), r.value, r.what) for r in found.select("key", F.to_utc_timestamp("at", "UTC").alias("at"), "value", "what").collect())


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def brute(rows):
    until, out = max(M.millis(r[1]) for r in rows) - 600_000, []
    for key in {r[0] for r in rows}:
        own = sorted((M.millis(t), i, v) for k, t, i, v in rows if k == key and M.millis(t) <= until)
        for n, (at, _, v) in enumerate(own):
            if n == 0 or own[n - 1][2] != v:
                out.append((key, at, v, "CHANGED"))
            ends = at + 900_000
            if v == BUSY and ends <= until and (n + 1 == len(own) or ends < own[n + 1][0]):
                out.append((key, ends, v, "ORPHAN"))
    return sorted(out)


def test_status_in_three_runs(spark, tmp_path):
    rows = events()
    for part in late(rows):
        put(spark, tmp_path, part)
        got = run(spark, tmp_path, M.StatusMachine())  # each goes on from the checkpoint
    assert got == brute(rows) and {w for *_, w in got} == {"CHANGED", "ORPHAN"}
    assert run(spark, tmp_path, M.StatusMachine()) == got  # nothing new


def test_barrier_in_three_runs(spark, tmp_path):
    rows = [(k, t, i, str(i // 7 % 3) if k else str(i)) for k, t, i, _ in events(90, 8)]
    for part in late(rows):
        put(spark, tmp_path / "a", part)
        got = run(spark, tmp_path / "a", M.CountBarrier(3, 60))
    put(spark, tmp_path / "b", rows)
    assert got == run(spark, tmp_path / "b", M.CountBarrier(3, 60))
    assert len({k for k, *_ in got}) == len(got) == 4 and {w for k, _, _, w in got if k == 0} == {"TIMEOUT"} and "STABLE" in {w for *_, w in got}


def test_streams_without_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path, M.StatusMachine()) == []
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").parquet(f"{tmp_path}/in")
    empty = S.run_available(S.latest(stream), f"{tmp_path}/rows", f"{tmp_path}/latest")
    assert empty.count() == 0 and empty.columns == ["user_id", "n_events", "status", "since", "batch"]


def test_batches_are_compacted(spark, tmp_path):
    schema = "user_id long, event_id long, event_type string, ts timestamp"
    folder = f"{tmp_path}/rows"

    def put_and_run(n):
        spark.createDataFrame([(u, 10 * n + u, f"t{n}", START + datetime.timedelta(minutes=n)) for u in range(n, n + 3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return S.run_available(S.latest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), folder, f"{tmp_path}/state")

    def newest():
        rows = spark.read.parquet(folder).withColumn("last", F.max("batch").over(Window.partitionBy("user_id"))).where("batch = last")
        return {(r.user_id, r.n_events, r.status) for r in rows.collect()}

    for n in range(3):
        put_and_run(n)
    before = newest()
    S.compact(spark, folder, ["user_id"])
    assert newest() == before == {(0, 1, "t0"), (1, 2, "t1"), (2, 3, "t2"), (3, 2, "t2"), (4, 1, "t2")}
    assert spark.read.parquet(folder).count() == 5 and len(list((tmp_path / "rows").glob("batch=*"))) == 1
    put_and_run(3)
    assert newest() == {(0, 1, "t0"), (1, 2, "t1"), (2, 3, "t2"), (3, 3, "t3"), (4, 2, "t3"), (5, 1, "t3")}
    S.compact(spark, f"{tmp_path}/none", ["user_id"])
