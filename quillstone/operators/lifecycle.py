"""Integrity, reconciliation, validation and retention as plain relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.catalog import counted, numbered

#: States of an update.
IN_PROGRESS = ("UPDATING", "SWAPPING", "VALIDATING", "SYNCING")
DONE = ("", "COMPLETED", "FAILED", "ROLLED_BACK", "ABORTED")


def integrity(files: DataFrame, chunks: DataFrame, vectors: DataFrame, converted: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """uid, state, action. files: uid, kb_uid, process_status; the others: file_uid rows, each counted once before its join.

    files are the live ones. asked: uids to tell of; one that no live file has is FILE_NOT_FOUND.
    """
    out = files.withColumnRenamed("uid", "file_uid").withColumn("there_", F.lit(True))
    if asked is not None:
        out = asked.select(F.col("uid").alias("file_uid")).distinct().join(out, "file_uid", "left")
    out = counted(counted(counted(out, chunks, ["file_uid"], "n_chunks"), vectors, ["file_uid"], "n_vectors", -1), converted, ["file_uid"], "n_converted")
    state = (
        F.when(F.col("there_").isNull(), "FILE_NOT_FOUND")
        .when(F.col("process_status") != "FILE_PROCESS_STATUS_COMPLETED", "NOT_COMPLETED")
        .when(F.col("n_chunks") == 0, "EMPTY_PG")
        .when(F.col("kb_uid").isNull(), "FILE_NOT_FOUND")
        .when((F.col("n_vectors") < 0) | (F.col("n_vectors") != F.col("n_chunks")), "MISSING_MILVUS")
        .when(F.col("n_converted") == 0, "MISSING_CONVERTED_FILE")
        .otherwise("HEALTHY")
    )
    action = F.when(F.col("state") == "HEALTHY", "NONE").when(F.col("state") == "FILE_NOT_FOUND", "SKIP").when(F.col("state") == "NOT_COMPLETED", "DEFER").otherwise("REPROCESS")
    return out.withColumn("state", state).withColumn("action", action).select(F.col("file_uid").alias("uid"), "n_chunks", "n_vectors", "n_converted", "state", "action")


def embed_only() -> Column:
    """All but the vectors is there: chunks and converted files."""
    return (F.col("state") == "MISSING_MILVUS") & (F.col("n_chunks") > 0) & (F.col("n_converted") > 0)


def reconcile(production: DataFrame, staging: DataFrame, name: str = "display_name") -> DataFrame:
    """name, uid, todo: files to add to staging, to remove from it, and repeats of which the oldest stays."""
    add = production.join(staging, name, "left_anti").select(name, "uid", F.lit("ADD").alias("todo"))
    gone = staging.join(production, name, "left_anti").select(name, "uid", F.lit("REMOVE").alias("todo"))
    again = numbered(staging.join(production, name, "left_semi"), [name], [F.col("create_time"), F.col("uid")]).where("rn > 1").select(name, "uid", F.lit("DUPLICATE").alias("todo"))
    return add.unionByName(gone).unionByName(again)


def validate(counts: DataFrame) -> DataFrame:
    """Errors of an update, from one row a knowledge base: files, converted, chunks and embeddings of both sides."""
    c = F.col
    checks = [
        (c("staging_files") > 0) & (c("files") != c("staging_files")), "file count differs",
        c("staging_converted") < c("converted"), "converted files are missing",
        (c("chunks") > 0) & (c("staging_chunks") == 0), "no chunks",
        c("staging_embeddings") != c("staging_chunks"), "embeddings and chunks differ",
    ]
    found = [F.when((F.lit(i == 0) | (c("files") > 0)) & checks[2 * i], checks[2 * i + 1]) for i in range(4)]
    return counts.withColumn("errors", F.array_compact(F.array(*found)))


def target(kbs: DataFrame) -> DataFrame:
    """uid, target: the copy that changes to a knowledge base go to as well: staging or else rollback while an update runs, rollback after it."""
    side = lambda tag: kbs.where(F.array_contains("tags", tag)).groupBy(F.col("parent_kb_uid").alias("uid")).agg(F.min("uid").alias(tag))
    out = kbs.select("uid", "update_status").join(side("staging"), "uid", "left").join(side("rollback"), "uid", "left")
    running, after = F.col("update_status").isin(*IN_PROGRESS), F.col("update_status").isin("COMPLETED", "ROLLED_BACK")
    return out.select("uid", F.when(running, F.coalesce("staging", "rollback")).when(after, F.col("rollback")).alias("target"))


def retention_over(kbs: DataFrame, now: Column) -> DataFrame:
    """uid, expired of rollback sides: no base that they belong to, no date of their own, or a date that has passed."""
    return kbs.select("uid", (F.col("parent_kb_uid").isNull() | F.coalesce(F.col("rollback_retention_until") < now, F.lit(True))).alias("expired"))


def eligible(kbs: DataFrame, tags: list[str], ids: list[str] = ()) -> DataFrame:
    """Production bases that no update holds, with any of the tags (none: all) and one of the ids (none: all)."""
    free = F.col("update_status").isNull() | F.col("update_status").isin("", "COMPLETED")
    wanted = F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(True)
    return kbs.where(~F.col("staging") & free & wanted & (F.col("id").isin(*ids) if ids else F.lit(True)))


def orphans(files: DataFrame, running: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Files that no workflow works on though they are neither done nor failed, and haven't changed for a while."""
    stuck = ~F.col("process_status").isin("FILE_PROCESS_STATUS_COMPLETED", "FILE_PROCESS_STATUS_FAILED") & (F.col("update_time") < now - F.expr(f"interval {minutes} minutes"))
    return files.where(stuck).join(running, "uid", "left_anti")


def expired_objects(objects: DataFrame, now: Column, grace_hours: int = 24) -> DataFrame:
    """Objects whose days are over by more than the grace; 0 days: never."""
    until = F.col("create_time") + F.make_dt_interval(days=F.col("expire_days"), hours=F.lit(grace_hours))
    return objects.where((F.col("expire_days") > 0) & (until < now))


def stable(samples: DataFrame, key: str, at: str, count: str, polls: int) -> DataFrame:
    """key, since: the first poll from which on `polls` counts in a row were equal."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(at)
    change = samples.withColumn("run_", F.sum(F.coalesce((F.col(count) != F.lag(count).over(order)).cast("int"), F.lit(0))).over(order))
    place = change.withColumn("n_", F.row_number().over(Window.partitionBy(key, "run_").orderBy(at)))
    return place.where(F.col("n_") == polls).groupBy(key).agg(F.min(at).alias("since"))
