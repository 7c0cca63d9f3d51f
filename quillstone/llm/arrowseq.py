"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds documents in order of their key, their ids one after the other in sequences of equal length. Each batch
has two fixed-size-list columns, ids (uint16 if the vocabulary allows, else uint32) and mask (bool, false where the
last sequence is filled up), so that sequence n is at a place that can be computed and a memory-mapped reader gets
its ids without copying. The documents'
keys and lengths are in a second stream after the first.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import as_bytes, column, shared_dir, shuffle_partitions, slices
from quillstone.llm.tokens import encoder, vocabulary_text

LENGTH, ROWS = 1024, 256
#: Bytes of text that a file holds at most, about, and at least where that leaves enough files for the cluster.
LARGEST, SMALLEST = 256 << 20, 8 << 20


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """One file: a stream of fixed-size-list batches, a stream with the documents, and the second one's place in the last 8 bytes."""

    def __init__(self, sink: pa.NativeFile, length: int, rows: int, ids: pa.DataType):
        self.sink, self.length, self.rows = sink, length, rows
        self.schema = pa.schema([pa.field("ids", pa.list_(ids, length), nullable=False), pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)])
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.keys: list = []
        self.counts: list[int] = []

    def add(self, key, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.length * self.rows:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.held), dtype="<u4")
        full = len(values) if last else len(values) // (self.length * self.rows) * self.length * self.rows
        for at in range(0, full, self.length * self.rows):
            part = values[at : min(full, at + self.length * self.rows)]
            n = -(-len(part) // self.length)
            ids, mask = np.zeros(n * self.length, dtype=self.schema[0].type.value_type.to_pandas_dtype()), np.zeros(n * self.length, dtype=bool)
            ids[: len(part)], mask[: len(part)] = part, True
            self.stream.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema[0].type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema[1].type)], schema=self.schema))
        self.total += full
        self.held, self.size = [values[full:].tobytes()], 4 * (len(values) - full)

    def close(self, key_type: pa.DataType) -> None:
        self._flush(last=True)
        self.stream.close()
        place = self.sink.tell()
        table = pa.table({"key": pa.array(self.keys, key_type), "n_tokens": pa.array(self.counts, pa.int64())}, metadata={"sequences": json.dumps({"length": self.length, "tokens": self.total})})
        with pa.ipc.new_stream(self.sink, table.schema) as out:
            out.write_table(table)
        self.sink.write(struct.pack("<Q", place))


class SequenceReader:
    """Random access to a file's sequences; from a memory map or a buffer, arrays are views of the file."""

    def __init__(self, data: pa.Buffer):
        (place,) = struct.unpack("<Q", data[data.size - 8 :].to_pybytes())
        self.batches = list(pa.ipc.open_stream(data[:place]))
        self.documents = pa.ipc.open_stream(data[place : data.size - 8]).read_all()
        self.length = json.loads(self.documents.schema.metadata[b"sequences"])["length"]
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence n."""
        batch, row = self.batches[n // self.rows], n % self.rows
        ids, mask = (c.values[(c.offset + row) * self.length : (c.offset + row + 1) * self.length] for c in batch.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def documents_of(source: pa.NativeFile) -> pa.Table:
    """Keys and lengths of a file's documents, from the stream at its end."""
    size = source.size()
    source.seek(size - 8)
    (place,) = struct.unpack("<Q", source.read(8))
    source.seek(place)
    table = pa.ipc.open_stream(source).read_all()
    source.seek(0)
    return table


def runs(batches: Iterator[pa.RecordBatch], counts: list[int]) -> Iterator[bytes]:
    """Ids of documents that follow one another, by their lengths; one batch of the file is held at a time."""
    held, at = np.zeros(0, dtype=np.uint32), 0
    for n in counts:
        parts, left = [], n
        while left:
            if at == len(held):
                held, at = next(batches).column(0).flatten().to_numpy(), 0
            part = held[at : at + left]
            parts.append(part.astype("<u4").tobytes())
            at += len(part)
            left -= len(part)
        yield b"".join(parts)


def write_sequences(df: DataFrame, folder: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending order of key; the files' rows: part, path, n_docs, n_tokens.

    folder: shared by all nodes; by default a new one in the cluster's checkpoint folder. Rows are dealt by ranges of
    the key, as many as the bytes of text ask for (LARGEST, SMALLEST) unless partitions says, each range is a file, and ties are in order of their text. A task writes to a name of its own attempt,
    and only the names that finished tasks return are read, so a lost executor leaves no half file behind in the
    result. A null key comes first; a null or empty text has only the end id; other columns are dropped; an empty
    table gives no files. The result is computed when this returns: it has one row for each file.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(vocabulary_text(vocabulary))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    rows = df.select(column(key).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))
    if not partitions:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = max(1, -(-size // LARGEST), min(shuffle_partitions(spark), size // SMALLEST))
    dealt = rows.repartitionByRange(partitions, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, task = encoder(shared.value, "word").encode, None, TaskContext.get()
        system, path = open_folder(folder)
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrows"
        for batch in (part for whole in batches for part in slices(whole, 1)):
            if batch.num_rows and out is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(name)
                out = SequenceWriter(sink, length, ROWS, pa.uint16() if max(encoder(shared.value, "word").largest, end_id or 0) < 1 << 16 else pa.uint32())
                kind = batch.schema[0].type
            for k, ids in zip(batch.column(0).to_pylist(), encode(as_bytes(batch.column(1))), strict=True):
                out.add(k, ids + tail)
        if out is not None:
            out.close(kind)
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "n_docs": [len(out.keys)], "n_tokens": [out.total]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    files = dealt.mapInArrow(write, "part int, path string, n_docs long, n_tokens long").toPandas().sort_values("part")
    files["first"] = files.n_tokens.cumsum() - files.n_tokens
    files["folder"] = folder
    return spark.createDataFrame(files.astype({"part": "int32"}), "part int, path string, n_docs long, n_tokens long, first long, folder string")


def ends(counts: np.ndarray, most: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about so many ids together, and no more rows than that."""
    start = held = 0
    for i, n in enumerate(counts.tolist()):
        if i > start and (held + n > most or i - start == rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(counts):
        yield start, len(counts)


def read_sequences(files: DataFrame, key_type: str = "long") -> DataFrame:
    """One row for each document in the files that write_sequences returned: key, start, n_tokens, ids (binary)."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                system, _ = open_folder(f["folder"])
                with system.open_input_file(f["path"]) as source:
                    documents = documents_of(source)
                    counts = documents["n_tokens"].to_numpy()
                    starts = f["first"] + np.cumsum(counts) - counts
                    ids = runs(iter(pa.ipc.open_stream(source)), counts.tolist())
                    keys = documents["key"].combine_chunks()
                    for a, b in ends(counts):
                        yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(list(islice(ids, b - a)), pa.binary())], names=["key", "start", "n_tokens", "ids"])

    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "part").mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids binary") if n else spark.createDataFrame([], f"key {key_type}, start long, n_tokens long, ids binary")


def op7(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents

    return read_sequences(write_sequences(documents(spark, sf_dir))).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
