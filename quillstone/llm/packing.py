"""Best-fit packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import as_bytes, column, quoted, slices
from quillstone.llm.tokens import encoder, vocabulary_text

#: Bytes of text that a partition packs at least, if there are so many: in smaller ones too many bins stay part empty.
PACKED_TOGETHER = 32 << 20
#: Sequences numbered within each partition, which is the number above this bit.
PARTITION_BIT = 33


class OpenBins:
    """Bounded-space best fit. A bitset has bit f set while some open bin has f tokens free."""

    def __init__(self, capacity: int, bins: int, first: int = 0):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece: the open bin that it leaves the least space in, else a new one."""
        if fitting := self.bits >> length:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.bins:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space = self.next, self.capacity
            self.next += 1
        if left := space - length:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        held = self.free[space]
        bin_ = held.pop()
        self.open -= 1
        if not held:
            self.bits ^= 1 << space
        return bin_


def cut_points(n: int, capacity: int) -> list[int]:
    """Ends of the pieces of n tokens: only what is too long is cut, into full pieces after a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [first, *range(first + capacity, n + 1, capacity)] if n else []


def best_fit_pack(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024, bins: int = 512, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    Each whole text is encoded, end_id is appended, and the pieces are placed into sequences of at most capacity
    tokens by online best fit with a fixed number of open bins. Each partition packs its own rows, so nothing is
    shuffled and a lost task is packed again in the same way; at a partition's end its open bins are closed. Small
    partitions are read together by one task, about PACKED_TOGETHER bytes of text at least.
    A null or empty text is one piece of the end id (no row if end_id is None); a null key is kept; equal rows are
    packed as separate documents; columns other than key and text are dropped; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    rows = df.select(column(key).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))
    schema = f"{quoted(key)} {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids binary, sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, "byte").encode
        open_ = OpenBins(capacity, bins, TaskContext.get().partitionId() << PARTITION_BIT)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            of, piece, start, length, ids, sequence, offset = [], [], [], [], [], [], []
            for i, blob in enumerate(encode(as_bytes(batch.column(1)))):
                blob += tail
                begin = 0
                for k, end in enumerate(cut_points(len(blob) // 4, capacity)):
                    bin_, at = open_.place(end - begin)
                    of.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    ids.append(blob[4 * begin : 4 * end])
                    sequence.append(bin_)
                    offset.append(at)
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(np.array(x, dtype=np.int64)) for x in (start, length)), pa.array(ids, pa.binary()), *(pa.array(np.array(x, dtype=np.int64)) for x in (sequence, offset))],
                names=[key, "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return rows.coalesce(max(1, size // PACKED_TOGETHER)).mapInArrow(pack, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents

    packed = best_fit_pack(documents(spark, sf_dir))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
