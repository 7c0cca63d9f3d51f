"""Documents packed into batches that can ask the rest of the corpus and get answers back.

A batch is one row of several megabytes of text, compressed. Steps that need facts about the whole corpus send keys
dealt by their hash, merge them where equal keys meet, and join the answers to the batch again by its number.

A batch sends to FAN groups, however large the corpus is, so that the messages of a level are FAN for each batch. Where
FAN groups would be too large, relays stand between: each takes one group's messages from some FAN batches, merges
them, and sends to the FAN groups that its own is divided into; answers go back the same way. Messages grow with the
text times the number of levels, which is its logarithm to the base of FAN, and no step holds more than a batch, FAN
messages of one group, or one last group, which as many senders reach as a relay has. A key that every batch holds
is merged on the way, too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import as_bytes, column, shared_dir, shuffle_partitions, slices

BATCH_BYTES = 4 << 20
#: A sender deals to 2 ** BITS groups, by the next bits of the keys' hashes.
BITS = 8
MESSAGE = "batch long, kind int, pid int, blob binary"

#: Spark's own setting to delete the shuffle files of a query once it has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, where a lost executor takes nothing of it.

    The shuffles that only its making needed are deleted when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = BATCH_BYTES, carry: str | None = None) -> DataFrame:
    """batch, keys (array<long>), lengths (array<int>), texts (compressed UTF-8 bytes, one after the other), carried, written.

    carry: a string column that goes with each document. Keys are of an integer type; any other is an error.
    """
    if not isinstance(kind := df.select(column(key)).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type, not {kind.simpleString()}: give other keys a number first")
    rows = df.select(column(key).cast("long").alias("key"), F.coalesce(column(text), F.lit("")).alias("text"), (column(carry) if carry else F.lit(None)).cast("string").alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        keys: list = []
        texts: list[bytes] = []
        carried: list = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([squeeze(b"".join(texts))], pa.binary()), pa.array([carried], pa.list_(pa.string()))], names=["batch", "keys", "lengths", "texts", "carried"])

        for part in (p for b in batches for p in slices(b, 1, 1 << 20)):
            keys += part.column(0).to_pylist()
            carried += part.column(2).to_pylist()
            texts += (got := as_bytes(part.column(1)))
            held += sum(map(len, got))
            if held >= size:
                yield full()
                number, keys, texts, carried, held = number + 1, [], [], [], 0
        if keys:
            yield full()

    return written(rows.mapInArrow(run, "batch long, keys array<long>, lengths array<int>, texts binary, carried array<string>"))


def unpack(row: dict) -> tuple[list, np.ndarray, bytes]:
    """Keys, bounds (one more than documents) and the concatenated bytes of a batch."""
    bounds = np.zeros(len(row["lengths"]) + 1, dtype=np.int64)
    np.cumsum(row["lengths"], out=bounds[1:])
    return row["keys"], bounds, expand(row["texts"])


def shares(batches: DataFrame, per_batch: int, target: int = 12 << 20) -> tuple[int, int, int]:
    """Batches, partitions and levels for an exchange in which each batch sends about per_batch bytes."""
    n = batches.count()
    parts, levels = -(-n * per_batch // target), 1
    while parts > 1 << (BITS * levels):
        levels += 1
    return n, max(shuffle_partitions(batches.sparkSession), parts), levels


def messages(rows: list[tuple]) -> pa.Table:
    """A table of sender, kind, group and blob."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(("batch", "kind", "pid", "blob"), types, strict=True))})


def relayed(sent: DataFrame, senders: int) -> tuple[DataFrame, int]:
    """Messages with the number of the relay that takes them, and how many relays a group has."""
    fan = 1 << BITS
    n = -(-senders // fan)
    number = (F.col("pid").cast("long") * 2 + F.col("kind")) * n + F.pmod(F.xxhash64("batch"), F.lit(n))
    return sent.withColumn("relay", number), n


def climbed(sent: DataFrame, senders: int, parts: int, levels: int, merge: Callable) -> list[DataFrame]:
    """The messages of each level, the last of which are for the groups that answer.

    merge(kind, width, blobs) gives (group, blob) for the merged keys of some messages to one group; groups of the next
    level are told apart by so many bits.
    """
    out = [sent]
    for depth in range(2, levels + 1):
        out[-1] = written(out[-1])
        below, senders = relayed(out[-1], senders)

        out.append(below.repartition(parts, "relay").groupBy("relay").applyInArrow(_relay(merge, BITS * depth), MESSAGE))
    return out


def _relay(merge: Callable, width: int) -> Callable[[pa.Table], pa.Table]:
    def relay(table: pa.Table) -> pa.Table:
        kind, number = table["kind"][0].as_py(), table["relay"][0].as_py()
        return messages([(number, kind, p, x) for p, x in merge(kind, width, in_order(table)["blob"].to_pylist())])

    return relay


def _back(spread: Callable, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def back(sent: pa.Table, answers: pa.Table) -> pa.Table:
        if not sent.num_rows or not answers.num_rows:
            return messages([])
        sent, kind = in_order(sent), sent["kind"][0].as_py()
        found = spread(kind, width, sent["blob"].to_pylist(), list(zip(answers["pid"].to_pylist(), answers["blob"].to_pylist(), strict=True)))
        return messages([(b, kind, p, x) for b, p, x in zip(sent["batch"].to_pylist(), sent["pid"].to_pylist(), found, strict=True) if x is not None])

    return back


def in_order(table: pa.Table) -> pa.Table:
    """A relay's messages in an order that doesn't depend on their arrival."""
    return table.sort_by([("batch", "ascending"), ("pid", "ascending")])


def descended(levels: list[DataFrame], senders: int, parts: int, replies: DataFrame, spread: Callable) -> DataFrame:
    """Answers for the batches, from those of the last groups to the messages of the last level.

    spread(kind, width, blobs, answers) gives the answer to each of a relay's messages, or None, from those (group,
    blob) to what merge made of them.
    """
    counts = [senders]
    for _ in levels[1:]:
        counts.append(-(-counts[-1] // (1 << BITS)))
    for depth in range(len(levels), 1, -1):
        below, _ = relayed(levels[depth - 2], counts[depth - 2])
        told = replies.withColumnRenamed("batch", "relay").repartition(parts, "relay").groupBy("relay")
        replies = below.repartition(parts, "relay").groupBy("relay").cogroup(told).applyInArrow(_back(spread, BITS * depth), MESSAGE)
    return replies
