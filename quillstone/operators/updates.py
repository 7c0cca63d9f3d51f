"""Update of a knowledge base: staging copy, swap, rollback, purge, abort.

A catalog is a dict of DataFrames: kbs (uid, status, staging, tags, parent_kb_uid, rollback_retention_until and what
else it has) and resource tables with a kb_uid. Every step returns the changed tables; writing them as the next
version is the caller's, so that a failed step leaves the version before it in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lifecycle import IN_PROGRESS

Catalog = dict[str, DataFrame]
RESOURCES = ("files", "chunks", "embeddings", "converted")


def resources(catalog: Catalog) -> list[str]:
    return [t for t in RESOURCES if t in catalog]


def with_status(kbs: DataFrame, uid: str, status: str, until: Column | None = None) -> DataFrame:
    own = F.col("uid") == uid
    out = kbs.withColumn("update_status", F.when(own, status).otherwise(F.col("update_status")))
    return out if until is None else out.withColumn("rollback_retention_until", F.when(own, until).otherwise(F.col("rollback_retention_until")))


def status_written(kbs: DataFrame, uid: str, status: str, now: Column, workflow: str = "", error: str = "", previous_system: str | None = None) -> DataFrame:
    """A state with what goes with it, deleted bases included: the start, the workflow, a cleared error and the system before when an update begins; the end, and a failure's error, when it is over; between them the workflow, if one is given."""
    own = F.col("uid") == uid
    values: dict[str, Column] = {"update_status": F.lit(status)}
    if status == "UPDATING":
        values |= {"update_started_at": now, "update_workflow_id": F.lit(workflow), "update_error_message": F.lit("")}
        values |= {"previous_system_uid": F.lit(previous_system)} if previous_system else {}
    elif status in ("COMPLETED", "FAILED", "ABORTED", "ROLLED_BACK"):
        values |= {"update_completed_at": now, "update_error_message": F.lit(error if status == "FAILED" else "")}
    elif workflow:
        values |= {"update_workflow_id": F.lit(workflow)}
    return kbs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items()})


def side(kbs: DataFrame, uid: str, new: str, tag: str) -> DataFrame:
    """A copy of a base's row under another uid, marked as its staging or rollback side."""
    copy = kbs.where(F.col("uid") == uid).withColumns({"uid": F.lit(new), "parent_kb_uid": F.lit(uid), "staging": F.lit(True), "tags": F.array(F.lit(tag)), "update_status": F.lit(None).cast("string")})
    return kbs.where(F.col("uid") != new).unionByName(copy)


def begin(catalog: Catalog, uid: str, staging: str) -> Catalog:
    """A staging side beside the base, which is in state UPDATING from then on. A base that is being updated is an error."""
    kbs = catalog["kbs"]
    if not kbs.where((F.col("uid") == uid) & F.coalesce(F.col("update_status").isin(*IN_PROGRESS), F.lit(False))).isEmpty():
        raise ValueError(f"{uid} is being updated")
    return catalog | {"kbs": with_status(side(kbs, uid, staging, "staging"), uid, "UPDATING")}


def swap_in(catalog: Catalog, uid: str, staging: str, rollback: str, until: Column) -> Catalog:
    """The base's resources go to the rollback side and the staging ones to the base, in one pass over each table; the base keeps its uid."""
    out = dict(catalog)
    for t in resources(catalog):
        kb = F.col("kb_uid")
        out[t] = catalog[t].where(kb != rollback).withColumn("kb_uid", F.when(kb == uid, rollback).when(kb == staging, uid).otherwise(kb))
    kbs = side(catalog["kbs"], uid, rollback, "rollback").where(F.col("uid") != staging)
    return out | {"kbs": with_status(kbs, uid, "COMPLETED", until)}


def roll_back(catalog: Catalog, uid: str, rollback: str) -> Catalog:
    """The rollback side's resources take the place of the base's."""
    out = dict(catalog)
    for t in resources(catalog):
        kb = F.col("kb_uid")
        out[t] = catalog[t].where(kb != uid).withColumn("kb_uid", F.when(kb == rollback, uid).otherwise(kb))
    kbs = catalog["kbs"].where(F.col("uid") != rollback)
    return out | {"kbs": with_status(kbs, uid, "ROLLED_BACK", F.lit(None).cast("timestamp"))}


def drop_side(catalog: Catalog, other: str) -> Catalog:
    out = {t: catalog[t].where(F.col("kb_uid") != other) for t in resources(catalog)}
    return catalog | out | {"kbs": catalog["kbs"].where(F.col("uid") != other)}


def abort(catalog: Catalog, uid: str, staging: str) -> Catalog:
    out = drop_side(catalog, staging)
    return out | {"kbs": with_status(out["kbs"], uid, "ABORTED")}


def purge(catalog: Catalog, now: Column) -> Catalog:
    """Rollback sides whose base has no retention date, or one that has passed, go with all their resources."""
    kbs = catalog["kbs"]
    base = kbs.select(F.col("uid").alias("parent_kb_uid"), F.col("rollback_retention_until").alias("until"))
    old = kbs.where(F.array_contains("tags", "rollback")).select("uid", "parent_kb_uid").join(base, "parent_kb_uid", "left").where(F.coalesce(F.col("until") < now, F.lit(True))).select("uid")
    out = {t: catalog[t].join(old, catalog[t]["kb_uid"] == old["uid"], "left_anti") for t in resources(catalog)}
    return catalog | out | {"kbs": kbs.join(old, "uid", "left_anti")}
