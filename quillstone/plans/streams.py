"""Queries over streams, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import lifecycle as L
from quillstone.operators.catalog import first_by
from quillstone.plans.adapters import table
from quillstone.plans.registry import query
from quillstone.sources.shared import fresh
from quillstone.streaming import machine as M
from quillstone.streaming import status as S


def run(spark, sf_dir, make, mode):
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = fresh(spark, "stream")
    return S.run_available(make(events), f"{name}/rows", f"{name}/state", mode)


def newest(rows, *keys):
    return first_by(rows, list(keys), [F.col("batch").desc()])


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS since FROM events GROUP BY 1")
def status_stream(spark, sf_dir):
    return newest(run(spark, sf_dir, S.latest, "update"), "user_id").select("user_id", "n_events", "status", "since")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts_stream(spark, sf_dir):
    out = newest(run(spark, sf_dir, S.counts_by_window, "update"), "window", "event_type")
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS since FROM events GROUP BY 1) SELECT user_id FROM s WHERE status NOT IN ('purchase', 'error') AND since < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE AND user_id % 5 <> 0")
def orphan_sweep_stream(spark, sf_dir):
    """Users as files whose last state isn't final, that haven't changed for 15 minutes, and that no workflow works on (those of every fifth run)."""
    states = newest(run(spark, sf_dir, S.latest, "update"), "user_id")
    now = states.agg(F.max("since").alias("now"))
    final = F.when(F.col("status") == "purchase", "FILE_PROCESS_STATUS_COMPLETED").when(F.col("status") == "error", "FILE_PROCESS_STATUS_FAILED").otherwise("FILE_PROCESS_STATUS_PROCESSING")
    rows = states.select(F.col("user_id").alias("uid"), final.alias("process_status"), F.col("since").alias("update_time")).crossJoin(F.broadcast(now))  # one row
    return L.orphans(rows, rows.where("uid % 5 = 0").select("uid"), F.col("now")).select(F.col("uid").alias("user_id"))


#: Events as states of files, in the order in which they count, up to the watermark.
STATES = """e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type, CASE event_type WHEN 'purchase' THEN 'FILE_PROCESS_STATUS_COMPLETED' WHEN 'error' THEN 'FILE_PROCESS_STATUS_FAILED' ELSE 'FILE_PROCESS_STATUS_PROCESSING' END AS value FROM events),
w AS (SELECT max(ms) - 600000 AS w FROM e), o AS (SELECT *, lag(value) OVER k AS was, lag(ms) OVER k AS then_, lead(ms) OVER k AS next_ FROM e, w WHERE ms <= w WINDOW k AS (PARTITION BY key ORDER BY ms, id))"""


def event_stream(spark, sf_dir, value):
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("id"), value.alias("value"))


def run_machine(spark, rows, machine):
    name = fresh(spark, "machine")
    return M.run_appended(M.through(rows, machine), f"{name}/rows", f"{name}/state").select("key", F.unix_millis("at").alias("ms"), "value", "what")


@query(f"""WITH {STATES} SELECT key, ms, value, 'CHANGED' AS what FROM o WHERE was IS NULL OR value <> was OR then_ + 2592000000 < ms
UNION ALL SELECT key, ms + 900000, value, 'ORPHAN' FROM o WHERE value NOT IN ('FILE_PROCESS_STATUS_COMPLETED', 'FILE_PROCESS_STATUS_FAILED') AND ms + 900000 <= w AND (next_ IS NULL OR ms + 900000 < next_)""")
def status_machine_stream(spark, sf_dir):
    """Users as files: each change of their state, and each time that one became an orphan, by timers."""
    state = F.when(F.col("event_type") == "purchase", "FILE_PROCESS_STATUS_COMPLETED").when(F.col("event_type") == "error", "FILE_PROCESS_STATUS_FAILED").otherwise("FILE_PROCESS_STATUS_PROCESSING")
    return run_machine(spark, event_stream(spark, sf_dir, state), M.StatusMachine())


@query(f"""WITH {STATES}, c AS (SELECT *, sum(coalesce((event_type <> before)::INT, 0)) OVER (PARTITION BY key ORDER BY ms, id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY key ORDER BY ms, id) AS before FROM o)),
n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ms, id) AS k, min(ms) OVER (PARTITION BY key) + 86400000 AS until FROM c),
s AS (SELECT key, min(ms) AS ms FROM n WHERE k = 3 AND ms <= until GROUP BY key)
SELECT n.key, n.ms, n.event_type AS value, 'STABLE' AS what FROM n JOIN s ON s.key = n.key AND s.ms = n.ms AND n.k = 3
UNION ALL SELECT key, until, arg_max(event_type, (ms, id)), 'TIMEOUT' FROM n, w WHERE ms <= until AND until <= w.w AND key NOT IN (SELECT key FROM s) GROUP BY key, until""")
def count_barrier_stream(spark, sf_dir):
    """Events as polls of a count: three equal ones in a row within a day, or the wait is over."""
    return run_machine(spark, event_stream(spark, sf_dir, F.col("event_type")), M.CountBarrier(3, 24 * 60))
