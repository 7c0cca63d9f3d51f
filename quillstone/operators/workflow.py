"""The update of a knowledge base from its preparation to the swap, as one function that can be called again.

The catalog's tables are kept as numbered versions in a folder, and so is the run's state: the last phase that ended and
which version of each table it left. A phase writes the next versions of the tables it changes and then the state; a run
that was ended anywhere goes on after the last phase of which the state was written.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import lifecycle as L
from quillstone.operators import updates as U
from quillstone.operators.updates import Catalog
from quillstone.sources import versions as V

#: Phases in order; FAILED ends a run.
PHASES = ("NEW", "PREPARED", "REPROCESSED", "SYNCHRONIZED", "VALIDATED", "SWAPPED")
#: Characters of an error that are kept, and what follows them if there were more.
ERROR_CHARS, CUT = 1000, "... (truncated)"
#: Tables of what is made of files; each has file_uid and kb_uid.
MADE = ("chunks", "embeddings", "converted")


@dataclass
class Run:
    """A catalog and a run's state in a folder. One run at a time."""

    spark: SparkSession
    folder: str

    def state(self) -> tuple[str, dict[str, int]]:
        held = V.current(self.spark, f"{self.folder}/state")
        if held is None:
            return "", {}
        row = held.first()
        return row["phase"], json.loads(row["versions"])

    def tables(self) -> Catalog:
        return {t: self.spark.read.parquet(f"{self.folder}/{t}/v={n}") for t, n in self.state()[1].items()}

    def commit(self, phase: str, changed: Catalog) -> None:
        """The changed tables are written beside the versions in use; they count when the state is written."""
        versions = self.state()[1] | {t: V.write(df, f"{self.folder}/{t}") for t, df in changed.items()}
        V.write(self.spark.createDataFrame([(phase, json.dumps(versions))], "phase string, versions string").coalesce(1), f"{self.folder}/state")

    def start(self, catalog: Catalog) -> None:
        self.commit("NEW", catalog)


def live(files: DataFrame, kb: str) -> DataFrame:
    return files.where((F.col("kb_uid") == kb) & F.col("delete_time").isNull())


def cloned(files: DataFrame, staging: str) -> DataFrame:
    return files.withColumn("kb_uid", F.lit(staging)).withColumn("uid", F.concat("uid", F.lit("+")))


def with_files(catalog: Catalog, new: DataFrame, process: Callable[[DataFrame], Catalog]) -> Catalog:
    """The catalog with new files and what is made of them."""
    made = process(new)
    return {"files": catalog["files"].unionByName(new)} | {t: catalog[t].unionByName(made[t].select(*catalog[t].columns)) for t in MADE}


def without_files(catalog: Catalog, gone: DataFrame) -> Catalog:
    """The catalog without files (uid) and what was made of them."""
    out = {t: catalog[t].join(gone.select(F.col("uid").alias("file_uid")), "file_uid", "left_anti").select(*catalog[t].columns) for t in MADE}
    return out | {"files": catalog["files"].join(gone.select("uid"), "uid", "left_anti").select(*catalog["files"].columns)}


def counts(catalog: Catalog, base: str, staging: str) -> DataFrame:
    """One row: live files of both sides, and converted files, chunks and embeddings of live files, each counted in one pass over its table."""
    out = None
    live_ = catalog["files"].where(F.col("kb_uid").isin(base, staging) & F.col("delete_time").isNull())
    for t in ("files", *MADE):
        rows = live_ if t == "files" else catalog[t].where(F.col("kb_uid").isin(base, staging)).join(live_.select(F.col("uid").alias("file_uid")), "file_uid", "left_semi")
        one = rows.agg(F.count_if(F.col("kb_uid") == base).alias(t), F.count_if(F.col("kb_uid") == staging).alias(f"staging_{t}"))
        out = one if out is None else out.crossJoin(one)  # of one row each
    return out


def update(run: Run, base: str, process: Callable[[DataFrame], Catalog], until: Column, stop_after: str = PHASES[-1]) -> str:
    """Take a run on to a phase (the swap, if not said); returns the phase reached, FAILED if the sides don't agree.

    The catalog: kbs (as updates has it), files (uid, kb_uid, display_name, create_time, delete_time), chunks, embeddings
    and converted (file_uid, kb_uid). process makes the last three of files. An update takes the files that are live when
    it begins; those that are deleted or added meanwhile are found by their names when the sides are synchronized.
    An error of process ends the call, not the run: the next call tries the phase again.
    """
    staging, rollback = f"{base}-staging", f"{base}-rollback"

    def prepare(c: Catalog) -> Catalog:
        if L.eligible(c["kbs"].withColumn("id", F.col("uid")), [], [base]).isEmpty():
            raise ValueError(f"{base} can't be updated")
        return {"kbs": U.begin(c, base, staging)["kbs"], "snapshot": live(c["files"], base).select("uid")}

    def reprocess(c: Catalog) -> Catalog:
        return with_files(c, cloned(live(c["files"], base).join(c["snapshot"], "uid", "left_semi"), staging), process) | {"kbs": U.with_status(c["kbs"], base, "SYNCING")}

    def synchronize(c: Catalog) -> Catalog:
        ours, theirs = live(c["files"], base), live(c["files"], staging)
        todo = L.reconcile(ours, theirs)
        out = without_files(c, todo.where("todo <> 'ADD'"))
        new = cloned(ours.join(todo.where("todo = 'ADD'").select("uid"), "uid", "left_semi"), staging)
        return with_files(out, new, process) | {"kbs": U.with_status(c["kbs"], base, "VALIDATING")}

    def validate(c: Catalog) -> Catalog:
        if errors := L.validate(counts(c, base, staging)).first()["errors"]:
            raise Invalid("; ".join(errors))
        return {"kbs": U.with_status(c["kbs"], base, "SWAPPING")}

    def swap(c: Catalog) -> Catalog:
        out = U.swap_in(c, base, staging, rollback, until)
        return {t: out[t] for t in ("kbs", "files", *MADE)}

    steps = dict(zip(PHASES[1:], (prepare, reprocess, synchronize, validate, swap), strict=True))
    while (phase := run.state()[0]) in PHASES and PHASES.index(phase) < PHASES.index(stop_after):
        following = PHASES[PHASES.index(phase) + 1]
        try:
            run.commit(following, steps[following](run.tables()))
        except Invalid as e:
            c = U.drop_side(run.tables(), staging)
            message = str(e) if len(str(e)) <= ERROR_CHARS else str(e)[:ERROR_CHARS] + CUT
            kbs = U.with_status(c["kbs"], base, "FAILED").withColumn("update_error_message", F.when(F.col("uid") == base, message))
            run.commit("FAILED", {"kbs": kbs} | {t: c[t] for t in ("files", *MADE)})
    return run.state()[0]


class Invalid(ValueError):
    pass
