"""Helpers shared by the operators: Arrow columns as bytes, shared vocabulary files, checkpoints, column names."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts are worked on in groups of about so many bytes, so that a worker's memory doesn't follow the Arrow batch.
GROUP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots or blanks."""
    return F.col(quoted(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*(column(c) for c in df.columns if c.lower() not in gone))


def mapped(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any name; run gets them by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def whole_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the whole text; a null text is the empty one."""
    return docs.select(column(key), F.coalesce(column(text), F.lit("")).alias(text))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def groups(texts: list[bytes], size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about size bytes each; a longer text is a range of its own."""
    start = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int | str, size: int = 2 * GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in the column hold about size bytes each, so that results are as small."""
    texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def int_lists(blobs: list[bytes], kind: pa.DataType | None = None) -> pa.ListArray:
    """Little-endian 32-bit integers in each blob, as an Arrow list column without copying each value."""
    values = np.frombuffer(b"".join(blobs), dtype="<i4")
    offsets = np.zeros(len(blobs) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind or pa.int32()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, one of our own in a local session, else an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillstone-')}")
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
