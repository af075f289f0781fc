"""Payloads in large files: appended to packs, found by path and version, read by byte range."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.operators import changes
from cargohold.session import qualify, shuffle_partitions
from cargohold.storage import column_values, payload_batches, resolve, with_columns

PACK_BYTES = 1024 * 1024 * 1024
WINDOW_BYTES = 8 * 1024 * 1024


class _Pack:
    """The pack that a task appends to. No name is used twice, so what a killed task leaves is never referred to."""

    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit, self.stream, self.at = folder, limit, None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.stream is not None and self.at + len(data) > self.limit:
            self.close()
        if self.stream is None:
            self.name, self.at = f"pack-{uuid.uuid4().hex}", 0
            filesystem, place = resolve(f"{self.folder}/packs")
            filesystem.create_dir(place, recursive=True)
            self.stream = filesystem.open_output_stream(f"{place}/{self.name}", compression=None)
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def pack_payloads(df: DataFrame, path: str, col: str, folder: str, keep: list[str] | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Append each payload to a pack of its task; returns the `keep` columns, `pack`, `offset`, `bytes_written` and `error`.

    Lazy, as `write_files`: store the rows once and use them from there. Rows come out as they are packed, but a pack is
    only whole when its task has ended, so nothing may be read before the job has. Rows with a NULL path or payload are
    passed over.
    """
    kept = list(keep) if keep is not None else [path]
    folder = qualify(df.sparkSession, folder).rstrip("/")
    new = {"pack": T.StringType(), "offset": T.LongType(), "bytes_written": T.LongType(), "error": T.StringType()}
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new.items()])
    fields = {"pack": pa.string(), "offset": pa.int64(), "bytes_written": pa.int64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pack(folder, pack_bytes)

        def save(target: str | None, value: bytes | None) -> tuple:
            if target is None or value is None:
                return None, None, None, None
            return *out.add(value), len(value), None

        try:
            for batch in batches:
                pairs = zip(column_values(batch, path), column_values(batch, col))
                yield from payload_batches(batch.select(kept), fields, (save(*pair) for pair in pairs))
        finally:
            out.close()

    return df.select(*dict.fromkeys([*kept, path, col])).mapInArrow(run, schema)


def put(df: DataFrame, path: str, col: str, folder: str, pack_bytes: int = PACK_BYTES) -> int:
    """Store the payloads under their paths as the next version of the store; returns its number.

    One pass over `df`: the rows of the version are written by the job that fills the packs. A path that was there
    already gets its new content; a NULL payload deletes it.
    """
    rows = df.select(F.col(path).alias("path"), F.col(col).cast("binary").alias("bytes"))
    rows = rows.withColumns({"length": F.octet_length("bytes").cast("bigint"), "md5": F.md5("bytes"), "deleted": F.col("bytes").isNull()})
    packed = pack_payloads(rows, "path", "bytes", folder, ["path", "length", "md5", "deleted"], pack_bytes)
    return changes.append(packed, f"{folder}/log")


def entries(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """`path, length, md5, pack, offset, version` of what the store holds."""
    return changes.state(spark, f"{folder}/log", upto).drop("deleted")


def read_ranges(rows: DataFrame, folder: str) -> DataFrame:
    """Add `bytes` and `error` to rows with `pack`, `offset` and `length`; only the ranges asked for are read.

    The narrow rows are shuffled by windows of a pack, so a large pack is read by many tasks, each from front to back.
    """
    folder = qualify(rows.sparkSession, folder).rstrip("/")
    schema = with_columns(rows.schema, T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}

        def read(pack: str | None, offset: int | None, length: int | None) -> tuple[bytes | None, str | None]:
            if pack is None:
                return None, "NotStored"
            try:
                if pack not in opened:
                    for stream in opened.values():
                        stream.close()
                    opened.clear()
                    filesystem, place = resolve(f"{folder}/packs/{pack}")
                    opened[pack] = filesystem.open_input_file(place)
                opened[pack].seek(offset)
                data = opened[pack].read(length)
            except OSError as exc:
                return None, f"{type(exc).__name__}: {exc}"
            return (data, None) if len(data) == length else (None, f"expected {length} bytes, got {len(data)}")

        for batch in batches:
            cells = zip(*[column_values(batch, c) for c in ("pack", "offset", "length")])
            yield from payload_batches(batch, {"bytes": pa.binary(), "error": pa.string()}, (read(*c) for c in cells))
        for stream in opened.values():
            stream.close()

    window = F.floor(F.col("offset") / WINDOW_BYTES)
    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "pack", window).sortWithinPartitions("pack", "offset")
    return spread.mapInArrow(run, schema)


def get(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """Every stored path with its `bytes` and `error`; filters on the other columns act before any pack is opened."""
    return read_ranges(entries(spark, folder, upto), folder)


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """`pack, live, size` of every pack that the store refers to in any version: bytes in use and bytes up to its last entry."""
    logged = changes.entries(spark, qualify(spark, f"{folder}/log").rstrip("/"), -1, changes.latest_version(spark, f"{folder}/log"))
    size = logged.filter("pack IS NOT NULL").groupBy("pack").agg(F.max(F.col("offset") + F.col("length")).alias("size"))
    live = entries(spark, folder).groupBy("pack").agg(F.sum("length").alias("live"))
    return size.join(live, "pack", "left").fillna(0, ["live"])


def compact(spark: SparkSession, folder: str, least: float = 0.5, pack_bytes: int = PACK_BYTES) -> int:
    """Copy what is left in packs that are used below `least` into new packs; returns the version that says so.

    The new version is the swap: readers see the old ranges before it is complete and the new ones after. Paths,
    sizes and digests stay, and a range that can't be read fails the job before anything has changed.
    """
    thin = usage(spark, folder).filter(F.col("live") < F.col("size") * least).select("pack")
    moved = read_ranges(entries(spark, folder).join(thin, "pack", "left_semi"), folder)
    broken = F.raise_error(F.concat(F.lit("cannot compact "), "path", F.lit(": "), F.coalesce("error", F.lit("other bytes"))))
    sound = F.col("error").isNull() & (F.md5("bytes") == F.col("md5"))
    checked = moved.withColumn("bytes", F.when(sound, F.col("bytes")).otherwise(broken.cast("binary"))).drop("error")
    packed = pack_payloads(checked, "path", "bytes", folder, ["path", "length", "md5"], pack_bytes)
    return changes.append(packed, f"{folder}/log")


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete packs that the last version doesn't refer to, those of killed tasks too; returns how many.

    Earlier versions can't be read in full afterwards. No job may write to the store meanwhile.
    """
    folder = qualify(spark, folder).rstrip("/")
    filesystem, place = resolve(f"{folder}/packs")
    if filesystem.get_file_info(place).type != fs.FileType.Directory:
        return 0
    found = spark.createDataFrame([(i.base_name,) for i in filesystem.get_file_info(fs.FileSelector(place))], "pack string")
    used = entries(spark, folder).select("pack").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in column_values(batch, "pack"):
                filesystem, place = resolve(f"{folder}/packs/{name}")
                filesystem.delete_file(place)
            yield batch

    return found.join(used, "pack", "left_anti").mapInArrow(run, "pack string").count()
