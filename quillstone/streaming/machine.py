"""State machines over events that may be late, out of order or sent twice, with timers for each key.

A key's events wait in its state until the watermark has passed them, and are then taken in order of their time, each
once. So what comes out doesn't depend on how events were dealt to batches, as long as none is later than the watermark
allows. Times are milliseconds inside; a key's state is what waits for the watermark and one small row.

Every call of the state costs a message between Python and the JVM. So events wait in blocks, one a batch and key or some
more, and a key has a timer for the first that waits, not one an event: calls grow with keys times batches.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.sources.shared import exists

#: Events may be so late.
LATENESS = "10 minutes"
#: States in which a file stays; minutes after which a file in any other is an orphan.
TERMINAL = ("FILE_PROCESS_STATUS_COMPLETED", "FILE_PROCESS_STATUS_FAILED")
ORPHAN_MINUTES = 15
#: A key that has come to rest is forgotten so many days after its last event; another event finds it new.
KEEP_DAYS = 30
#: Events of a block at most.
BLOCK = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def millis(t: datetime.datetime) -> int:
    return round((t.replace(tzinfo=datetime.timezone.utc) if t.tzinfo is None else t).timestamp() * 1000)


def said(key: tuple, at: int, out: tuple[str, str]) -> Row:
    return Row(key=key[0], at=at, value=out[0], what=out[1])


def block(events: tuple[tuple, ...]) -> tuple[list, ...]:
    """Times, ids and values of some events."""
    return tuple(map(list, zip(*events, strict=True)))


class Ordered(StatefulProcessor):
    """Events of a key in order. Subclasses say what a key remembers (MEMORY, NEW), what an event does, and what a time without one does.

    Events are rows of key, at (milliseconds), id and value; equal at and id are the same event.
    """

    MEMORY, NEW = "value string", ("",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", self.MEMORY + ", last long")
        self.waiting = handle.getListState("waiting", "at array<long>, id array<long>, value array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = timerValues.getCurrentWatermarkInMs()
        first = None
        for some in batched(((r.at, r.id, r.value) for r in rows if r.at > seen), BLOCK):
            self.waiting.appendValue(block(some))
            first = min(x[0] for x in some) if first is None else min(first, min(x[0] for x in some))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        *memory, last = before = tuple(self.memory.get() or (*self.NEW, 0))
        memory = tuple(memory)
        waiting = {(at, id_): value for b in self.waiting.get() for at, id_, value in zip(*b, strict=True)}  # of equal ones the last
        due = sorted(k for k in waiting if k[0] <= until)
        for at, id_ in due:
            for ends, out, memory in self.elapsed(memory, at - 1):
                yield said(key, ends, out)
            if self.forgotten(memory, last, at - 1):
                memory = self.NEW
            out, memory = self.event(memory, at, id_, waiting.pop((at, id_)))
            last = at
            for o in out:
                yield said(key, at, o)
        if due and waiting:
            self.waiting.put([block(some) for some in batched(((*k, v) for k, v in waiting.items()), BLOCK)])
        elif due:
            self.waiting.clear()
        if waiting:
            self.handle.registerTimer(min(waiting)[0])
        for ends, out, memory in self.elapsed(memory, until):
            yield said(key, ends, out)
        if self.forgotten(memory, last, until):
            self.memory.clear()
        elif (*memory, last) != before:
            self.memory.update((*memory, last))
            self.handle.registerTimer(last + KEEP_DAYS * 86_400_000 if (next_ := self.deadline(memory)) is None else next_)

    def forgotten(self, memory: tuple, last: int, at: int) -> bool:
        """A key that nothing more happens to is forgotten after a while."""
        return self.deadline(memory) is None and last + KEEP_DAYS * 86_400_000 <= at

    def deadline(self, memory: tuple) -> int | None:
        """When something happens to the key though no event comes."""
        return None

    def missed(self, memory: tuple) -> tuple[tuple, tuple]:
        """What comes out at the deadline, and what is remembered then."""
        raise NotImplementedError

    def elapsed(self, memory: tuple, until: int) -> Iterator[tuple[int, tuple, tuple]]:
        if (at := self.deadline(memory)) is not None and at <= until:
            out, memory = self.missed(memory)
            yield at, out, memory

    def event(self, memory: tuple, at: int, id_: int, value: str) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class StatusMachine(Ordered):
    """A file's states: each change, and the time from which it is an orphan: neither done nor failed, and without an event for a while."""

    MEMORY, NEW = "status string, since long, orphan boolean", ("", 0, True)

    def deadline(self, memory):
        status, since, orphan = memory
        return None if orphan or status in TERMINAL else since + ORPHAN_MINUTES * 60_000

    def missed(self, memory):
        return (memory[0], "ORPHAN"), (memory[0], memory[1], True)

    def event(self, memory, at, id_, value):
        return [(value, "CHANGED")] if value != memory[0] else [], (value, at, False)


class CountBarrier(Ordered):
    """A key's counts until so many in a row are equal, or the wait is over; polls after that say nothing."""

    MEMORY, NEW = "count string, run int, first long, over boolean", ("", 0, -1, False)

    def __init__(self, polls: int, minutes: int):
        self.polls, self.wait = polls, minutes * 60_000

    def deadline(self, memory):
        return None if memory[3] or memory[2] < 0 else memory[2] + self.wait

    def missed(self, memory):
        return (memory[0], "TIMEOUT"), (*memory[:3], True)

    def event(self, memory, at, id_, value):
        count, run, first, over = memory
        if over:
            return [], memory
        run = run + 1 if value == count and run else 1
        done = run >= self.polls
        return [(value, "STABLE")] if done else [], (value, run, at if first < 0 else first, done)


OUT = "key long, at long, value string, what string"


def through(events: DataFrame, machine: Ordered) -> DataFrame:
    """key, at, value, what: a stream of events (key long, ts, id long, value) through a machine. Run it with run_appended."""
    rows = events.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", LATENESS).select("key", "ts", F.unix_millis("ts").alias("at"), "id", "value")
    out = rows.groupBy("key").transformWithState(machine, OUT, "append", "eventTime")
    return out.select("key", F.timestamp_millis("at").alias("at"), "value", "what")


def run_appended(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Process what is there, stop, and return all rows so far; the checkpoint lets the next run go on where this one ended.

    The file sink takes a batch that is tried again once. State is kept by RocksDB: the session's setting for it is
    changed while the query starts, which takes a copy of the settings.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        running = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], stream.schema)
