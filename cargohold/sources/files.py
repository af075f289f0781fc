"""Store listings, single files and gzip."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.session import qualify
from cargohold.storage import append_columns, blocks, column_values, resolve, with_columns, write_atomic


def scan_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """`path, modificationTime, length, content` of every file. Content is read only when selected.

    Spark leaves out empty files; `listing` has them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path)


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path` and `length` of every file, empty ones too, without the `file:` scheme; no file is opened.

    Tasks walk the folders, one for each given path. As in Spark, names that begin with `_` or `.` are passed over.
    """
    roots = [(p,) for given in ([path] if isinstance(path, str) else path) for p in _matches(spark, given)]

    def walk(root: str) -> Iterator[tuple[str, int]]:
        filesystem, name = resolve(root)
        prefix = root[: len(root) - len(name)] if root.endswith(name) else ""
        info = filesystem.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if info.type == fs.FileType.File:
            yield root, info.size
            return
        folders = [name]
        while folders:
            for item in sorted(filesystem.get_file_info(fs.FileSelector(folders.pop())), key=lambda i: i.path):
                if item.base_name[:1] in "_.":
                    continue
                if item.type == fs.FileType.Directory:
                    folders.append(item.path)
                elif item.type == fs.FileType.File:
                    yield prefix + item.path, item.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in column_values(batch, "root"):
                found = walk(root)
                while rows := list(islice(found, 4096)):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64()))], names=["path", "length"])

    return spark.createDataFrame(roots, "root string").repartition(max(1, len(roots))).mapInArrow(run, "path string, length bigint")


def _matches(spark: SparkSession, path: str) -> list[str]:
    """The path, or what it matches if it is a pattern."""
    if not re.search(r"[*?\[{]", path):
        return [qualify(spark, path)]
    context = spark.sparkContext
    jpath = context._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(jpath) or []
    return [qualify(spark, status.getPath().toString()) for status in found]


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def inflate(data: Iterable[bytes]) -> Iterator[bytes]:
    """Streaming gunzip, members one after the other as `gzip` writes them."""
    state = zlib.decompressobj(31)
    started = False
    for block in data:
        while block:
            if state.eof:
                state = zlib.decompressobj(31)
            started = True
            out = state.decompress(block)
            if out:
                yield out
            block = state.unused_data
    if not started or not state.eof:
        raise EOFError("gzip stream ends early")


def gunzip(df: DataFrame, col: str) -> DataFrame:
    """Decompress a binary column; a damaged value becomes NULL with the reason in `error`."""
    fields = [f for f in df.schema.fields if f.name != col]
    schema = T.StructType(fields + [T.StructField(col, T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for value in column_values(batch, col):
                try:
                    values.append(None if value is None else b"".join(inflate([value])))
                    errors.append(None)
                except (zlib.error, EOFError) as exc:
                    values.append(None)
                    errors.append(str(exc))
            kept = batch.select([f.name for f in fields])
            yield append_columns(kept, {col: pa.array(values, pa.binary()), "error": pa.array(errors, pa.string())})

    return df.mapInArrow(run, schema)


def gunzip_files(df: DataFrame, source: str, target: str) -> DataFrame:
    """Decompress file to file, streaming in the worker: adds `bytes_written` and `error`.

    gzip cannot be split, so an archive is one task whatever its size; the stored tar is then read in parallel.
    """
    schema = with_columns(
        df.schema, T.StructField("bytes_written", T.LongType()), T.StructField("error", T.StringType())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written, errors = [], []
            for src, dst in zip(column_values(batch, source), column_values(batch, target)):
                try:
                    filesystem, name = resolve(src)
                    with filesystem.open_input_stream(name, compression=None) as stream:
                        written.append(write_atomic(dst, inflate(blocks(stream))))
                    errors.append(None)
                except (OSError, zlib.error, EOFError) as exc:
                    written.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield append_columns(
                batch, {"bytes_written": pa.array(written, pa.int64()), "error": pa.array(errors, pa.string())}
            )

    return df.mapInArrow(run, schema)
