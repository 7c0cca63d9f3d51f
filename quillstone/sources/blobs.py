"""Blobs as a Python data source: listing and stat by prefix, writing, and reading of many paths with their errors.

`spark.read.format("quill_blobs")` lists a store, one partition for each prefix; `df.write.format("quill_blobs")`
writes rows of path and content. `fetch_all` reads the paths of a table where the table's rows are, and tells an error
for each that it can't read. Paths are relative to a root, which is a URI of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "quill_blobs"
#: Contents that a task of fetch_all hands on at once.
HELD_BYTES = 16 << 20


def store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(root if "://" in root or not root.startswith("/") else f"file://{root}")
    return fs, path.rstrip("/")


@dataclass
class Prefix(InputPartition):
    prefix: str


class BlobReader(DataSourceReader):
    """path, length, modified of all blobs whose name begins with one of the prefixes; a prefix within another lists nothing of its own."""

    def __init__(self, options: dict):
        self.root = options["path"]
        own = sorted(set(json.loads(options.get("prefixes", '[""]'))))
        self.prefixes = [p for p in own if not any(p != q and p.startswith(q) for q in own)]

    def partitions(self) -> list[Prefix]:
        return [Prefix(p) for p in self.prefixes]

    def read(self, partition: Prefix) -> Iterator[tuple]:
        fs, top = store(self.root)
        folder = posixpath.dirname(f"{top}/{partition.prefix}")
        for info in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            name = info.path[len(top) + 1 :]
            if info.type == pyarrow.fs.FileType.File and name.startswith(partition.prefix):
                yield name, info.size, info.mtime


@dataclass
class Written(WriterCommitMessage):
    n: int


class BlobWriter(DataSourceWriter):
    """A blob for each row of path and content. A task that is tried again writes the same blobs; of rows with one path one stays."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator) -> Written:
        fs, top = store(self.root)
        made: set[str] = set()
        n = 0
        for row in iterator:
            path = f"{top}/{row.path}"
            if (folder := posixpath.dirname(path)) not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(path) as out:
                out.write(bytes(row.content or b""))
            n += 1
        return Written(n)


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options)


def listing(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """path, length and modified of the blobs below a root; no contents are read, and prefixes are listed side by side."""
    spark.dataSource.register(Blobs)
    return spark.read.format(NAME).option("prefixes", json.dumps(list(prefixes))).load(root)


def write(blobs: DataFrame, root: str) -> None:
    """Blobs (path, content) below a root; those that are there are written over."""
    blobs.sparkSession.dataSource.register(Blobs)
    blobs.select("path", F.col("content").cast("binary").alias("content")).write.format(NAME).mode("append").save(root)


def stat(wanted: DataFrame, root: str, path: str = "path") -> DataFrame:
    """wanted, and length, modified and error of each blob, which is asked for by itself."""
    return _each(wanted, root, path, False)


def fetch_all(wanted: DataFrame, root: str, path: str = "path") -> DataFrame:
    """wanted, and content (binary) and error: every path gets one or the other, and one that can't be read fails no other.

    A null path is an error, a path that is asked for twice is read twice.
    """
    return _each(wanted, root, path, True)


def _each(wanted: DataFrame, root: str, path: str, content: bool) -> DataFrame:
    more = "content binary, error string" if content else "length long, modified timestamp, error string"
    names = [n.split()[0] for n in more.split(", ")]
    kept = wanted.drop(*names)
    at = kept.columns.index(path)
    columns = kept.columns
    schema = T.StructType(list(kept.schema.fields))
    for n in more.split(", "):
        schema = schema.add(*n.split())

    def one(fs, top, name) -> tuple:
        try:
            if name is None:
                raise FileNotFoundError("null")
            info = fs.get_file_info(f"{top}/{name}")
            if info.type != pyarrow.fs.FileType.File:
                raise FileNotFoundError(name)
            if not content:
                return info.size, info.mtime, None
            with fs.open_input_stream(info.path) as x:
                return x.read(), None
        except FileNotFoundError as e:
            return *(None for _ in names[1:]), f"no blob at {e}"
        except OSError as e:
            return *(None for _ in names[1:]), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(root)
        types = (pa.binary(), pa.string()) if content else (pa.int64(), pa.timestamp("us", "UTC"), pa.string())
        for b in batches:
            start, held, size = 0, [], 0
            for i, name in enumerate(b.column(at).to_pylist()):
                held.append(one(fs, top, name))
                size += len(held[-1][0] or b"") if content else 0
                if size >= HELD_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, i + 1 - start).columns, *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))], names=[*columns, *names])
                    start, held, size = i + 1, [], 0

    return kept.mapInArrow(run, schema)
