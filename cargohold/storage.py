"""Small helpers that run inside tasks: file access and Arrow batches."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T

from cargohold.functions.digest import check_algorithm

BLOCK = 1024 * 1024
GROUP_BYTES = 8 * 1024 * 1024


@lru_cache(maxsize=64)
def _mounted(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


LOCAL = fs.LocalFileSystem()


#: Schemes that workers can open; what Spark's connector calls s3a (or s3n) is s3 here.
SCHEMES = {"hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(/.*)$", re.S)


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a plain path or a `file:`, `hdfs:`, `s3a:`, ... URI; one connection per store.

    A plain path is a local one: qualify paths on the driver (`session.qualify`) where the default store isn't.
    """
    parts = _SCHEME.match(path)
    if not parts:
        return LOCAL, path
    scheme, rest = parts[1].lower(), parts[2]
    if scheme == "file":
        return LOCAL, "/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"cannot open {scheme}: paths on workers: {path}")
    store, _, name = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    filesystem, base = _mounted(f"{SCHEMES[scheme]}://{store}/")
    return filesystem, f"{base.rstrip('/')}/{name}"


def in_parallel(fn: Callable[..., Any], calls: Iterable[tuple], threads: int) -> Iterator[Any]:
    """Results in order, with at most `threads` calls under way or waiting to be taken."""
    if threads <= 1:
        yield from (fn(*call) for call in calls)
        return
    with ThreadPoolExecutor(threads) as pool:
        window: deque = deque()
        for call in calls:
            if len(window) == threads:
                yield window.popleft().result()
            window.append(pool.submit(fn, *call))
        while window:
            yield window.popleft().result()


def blocks(stream, size: int = BLOCK) -> Iterator[bytes]:
    while True:
        data = stream.read(size)
        if not data:
            return
        yield data


def new_hash(algorithm: str):
    return hashlib.new(check_algorithm(algorithm).replace("SHA-", "sha"))


def digest_file(path: str | None, algorithm: str = "MD5") -> str | None:
    if path is None:
        return None
    state = new_hash(algorithm)
    filesystem, name = resolve(path)
    try:
        with filesystem.open_input_stream(name, compression=None) as stream:
            for data in blocks(stream):
                state.update(data)
    except OSError:
        return None
    return state.hexdigest()


def write_atomic(path: str, data: Iterator[bytes], expected: int | None = None) -> int:
    """Write to a temporary name, then rename: a repeated or killed task leaves no half-written file.

    With `expected` nothing is renamed unless that many bytes were written.
    """
    filesystem, name = resolve(path)
    folder, _, base = name.rpartition("/")
    if folder:
        filesystem.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{base[:100]}.{uuid.uuid4().hex}" if folder else f".{base[:100]}.{uuid.uuid4().hex}"
    written = 0
    try:
        with filesystem.open_output_stream(temporary, compression=None) as stream:
            for block in data:
                stream.write(block)
                written += len(block)
        if expected is not None and written != expected:
            raise OSError(f"expected {expected} bytes, wrote {written}")
        if filesystem is LOCAL:
            # Spark keeps a checksum beside a local file that it wrote; it is not that of the new content.
            with suppress(FileNotFoundError):
                filesystem.delete_file(f"{folder}/.{base}.crc" if folder else f".{base}.crc")
        filesystem.move(temporary, name)
    except BaseException:
        with suppress(OSError):
            filesystem.delete_file(temporary)
        raise
    return written


def file_size(path: str) -> int | None:
    filesystem, name = resolve(path)
    info = filesystem.get_file_info(name)
    return info.size if info.type == fs.FileType.File else None


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType(schema.fields + list(fields))


def append_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = list(batch.columns) + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names + list(columns))


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def payload_batches(
    batch: pa.RecordBatch, fields: dict[str, pa.DataType], cells: Iterator[tuple]
) -> Iterator[pa.RecordBatch]:
    """Append one tuple of cells per row, cutting the batch when its new payloads pass `GROUP_BYTES`.

    `cells` is consumed lazily, so a task holds about one group of payloads at a time.
    """
    done: list[tuple] = []
    start = held = 0
    for row in cells:
        done.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if held >= GROUP_BYTES:
            yield _with_cells(batch.slice(start, len(done)), fields, done)
            start, held, done = start + len(done), 0, []
    if done:
        yield _with_cells(batch.slice(start, len(done)), fields, done)


def _with_cells(batch: pa.RecordBatch, fields: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(fields.items(), zip(*rows))
    return append_columns(batch, {name: pa.array(values, kind) for (name, kind), values in columns})
