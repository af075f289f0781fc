"""Payload files, extracted archives, stored and cached stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.session import small_batches
from cargohold.sources.tar import OpenArchive, by_window
from cargohold.storage import (
    BLOCK,
    append_columns,
    blocks,
    column_values,
    file_size,
    payload_batches,
    resolve,
    with_columns,
    write_atomic,
)


def write_files(
    df: DataFrame,
    path: str,
    col: str,
    keep: list[str] | None = None,
    size_name: str = "bytes_written",
    error_name: str = "error",
) -> DataFrame:
    """Write each payload to its own file; returns the `keep` columns, the size and the error.

    Lazy: the files appear when the result rows are used. Writing is idempotent (temporary name, then
    rename), so repeated tasks are harmless. Rows with a NULL path or payload are passed over.
    """
    kept = list(keep) if keep is not None else [path]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(size_name, T.LongType()), T.StructField(error_name, T.StringType())]
    )

    def save(target: str | None, value: bytes | None) -> tuple[int | None, str | None]:
        if target is None or value is None:
            return None, None
        try:
            return write_atomic(target, [value]), None
        except OSError as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {size_name: pa.int64(), error_name: pa.string()}
        for batch in batches:
            # One payload at a time leaves the batch.
            pairs = zip(column_values(batch, path), batch.column(batch.schema.get_field_index(col)))
            yield from payload_batches(batch.select(kept), fields, (save(target, value.as_py()) for target, value in pairs))

    return df.select(*dict.fromkeys([*kept, path, col])).mapInArrow(run, schema)


def unsafe_name(name: str) -> bool:
    return name.startswith("/") or ".." in name.split("/")


def extract_tar(index: DataFrame, root: str) -> DataFrame:
    """Copy indexed entries to files under `root`: adds `path, bytes_written, skipped, error`.

    Each task copies the byte range of an entry straight from the archive, so no payload is shuffled.
    Files that already have the right size are skipped; absolute names and `..` are refused. Of entries with one
    name the last counts, as in unpacking one after another; links and devices are errors.
    """
    schema = with_columns(
        T.StructType([f for f in index.schema.fields if f.name != "error"]),
        T.StructField("path", T.StringType()),
        T.StructField("bytes_written", T.LongType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("error", T.StringType()),
    )
    kept = [f.name for f in index.schema.fields if f.name != "error"]

    def entry_blocks(archive: OpenArchive, row: dict) -> Iterator[bytes]:
        stream, left = archive.at(row["archive"], row["data_offset"]), row["entry_size"]
        while left > 0 and (data := stream.read(min(left, BLOCK))):
            left -= len(data)
            yield data

    def copy(archive: OpenArchive, row: dict) -> tuple:
        name = row["entry_name"]
        if row["error"]:
            return None, None, False, row["error"]
        if unsafe_name(name):
            return None, None, False, f"UnsafePath: {name}"
        target = f"{root.rstrip('/')}/{name.rstrip('/')}"
        try:
            if row["entry_type"] == "directory":
                filesystem, folder = resolve(target)
                filesystem.create_dir(folder, recursive=True)
                return target, 0, False, None
            if row["entry_type"] != "file":
                return target, None, False, f"Unsupported: {name} is neither file nor directory"
            if file_size(target) == row["entry_size"]:
                return target, row["entry_size"], True, None
            written = write_atomic(target, entry_blocks(archive, row))
        except OSError as exc:
            return target, None, False, f"{type(exc).__name__}: {exc}"
        if written != row["entry_size"]:
            return target, written, False, f"expected {row['entry_size']} bytes, got {written}"
        return target, written, False, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = OpenArchive()
        fields = {"path": pa.string(), "bytes_written": pa.int64(), "skipped": pa.bool_(), "error": pa.string()}
        for batch in batches:
            yield from payload_batches(batch.select(kept), fields, (copy(archive, row) for row in batch.to_pylist()))
        archive.close()

    last = index.groupBy("archive", "entry_name").agg(F.max("entry_ord").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = [index[c].eqNullSafe(F.col(f"_{c}")) for c in ("archive", "entry_name")]
    older = last.select(F.col("archive").alias("_archive"), F.col("entry_name").alias("_entry_name"), "_last")
    kept_rows = index.join(older, same[0] & same[1] & (F.col("entry_ord") < F.col("_last")) & F.col("error").isNull(), "left_anti")
    return by_window(kept_rows, F.col("data_offset")).mapInArrow(run, schema)


def copy_files(df: DataFrame, source: str, target: str) -> DataFrame:
    """Stream files to new places: adds `bytes_written` and `error`."""
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
                        written.append(write_atomic(dst, blocks(stream)))
                    errors.append(None)
                except OSError as exc:
                    written.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield append_columns(
                batch, {"bytes_written": pa.array(written, pa.int64()), "error": pa.array(errors, pa.string())}
            )

    return df.mapInArrow(run, schema)


def spool(df: DataFrame, path: str | None = None) -> DataFrame:
    """A stage boundary: kept as Parquet at `path`, or on executor disks until unpersisted."""
    if path is None:
        return df.persist(StorageLevel.DISK_ONLY)
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_stage(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    valid: Callable[[DataFrame], bool] | None = None,
    keep: str = "save",
    made_from: str | None = None,
) -> DataFrame:
    """Read the stage stored at `path` when it is complete and `valid` accepts it, else build it.

    `made_from` names what the stage depends on (inputs, options): a stage stored for anything else is built again.

    `keep`: "save" stores what was built, "temporary" holds it on executor disks, "none" stays lazy.
    """
    if keep not in ("save", "temporary", "none"):
        raise ValueError("keep must be save, temporary or none")
    record = f"{path.rstrip('/')}.made-from"
    if file_size(f"{path.rstrip('/')}/_SUCCESS") is not None and (made_from is None or _text(record) == made_from):
        stored = spark.read.parquet(path)
        if valid is None or valid(stored):
            return stored
    built = build()
    if keep == "none":
        return built
    stored = spool(built, path if keep == "save" else None)
    if keep == "save" and made_from is not None:
        write_atomic(record, [made_from.encode()])
    return stored


def _text(path: str) -> str | None:
    if file_size(path) is None:
        return None
    filesystem, name = resolve(path)
    with filesystem.open_input_stream(name) as stream:
        return stream.read().decode()


def null_sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
