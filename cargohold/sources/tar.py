"""Tar archives as DataFrames.

Two passes, both distributed. The index pass walks the headers of an archive (seeking over the data)
and yields one row per entry. The data pass spreads byte ranges of the entries over tasks, so one
large archive, and one large entry in it, is read by many tasks.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.schemas import TAR_INDEX
from cargohold.session import shuffle_partitions
from cargohold.sources.files import listing
from cargohold.storage import GROUP_BYTES, column_values, payload_batches, resolve, with_columns

RECORD = 512
RANGE_BYTES = 8 * 1024 * 1024
#: What one cell of a binary column can hold.
CELL_BYTES = (1 << 31) - (1 << 16)
#: Extension headers hold a name and a few numbers; a longer one is damage.
EXTENSION_BYTES = 1024 * 1024
INDEX_ROWS = 4096
INDEX_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def _kind(info: tarfile.TarInfo) -> str:
    if info.isdir():
        return "directory"
    return "file" if info.isreg() else "other"


def walk_headers(stream, size: int, at: int = 0, ordinal: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """(ord, name, entry size, type, data offset, error) for each entry; an error ends the archive.

    `at` is where the headers of entry `ordinal` begin; entries that begin at `stop` or later are left out.
    """
    long_name: str | None = None
    extended: dict[str, str] = {}
    closed = False
    begun = at
    while at < size:
        if stop is not None and begun >= stop:
            return
        stream.seek(at)
        block = stream.read(RECORD)
        if len(block) != RECORD:
            yield ordinal, None, None, None, at, "InvalidRecordSize"
            return
        if not block.strip(b"\0"):
            closed = True
            at += RECORD
            continue
        try:
            info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        except tarfile.HeaderError:
            yield ordinal, None, None, None, at, "InvalidChecksum"
            return
        data = at + RECORD
        if info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.GNUTYPE_LONGLINK):
            if not 0 <= info.size <= EXTENSION_BYTES:
                yield ordinal, None, None, None, at, "InvalidHeader"
                return
            stream.seek(data)
            extra = stream.read(info.size)
            if len(extra) < info.size:
                yield ordinal, None, info.size, None, data, "Truncated"
                return
            if info.type == tarfile.GNUTYPE_LONGNAME:
                long_name = extra.rstrip(b"\0").decode("utf-8", "replace")
            elif info.type == tarfile.XHDTYPE:
                extended = pax_fields(extra)
                if extended is None:
                    yield ordinal, None, None, None, at, "InvalidHeader"
                    return
            at = data + -(-info.size // RECORD) * RECORD
            continue
        name = extended.get("path") or long_name or info.name
        stated = extended.get("size", str(info.size))
        length = (int(stated) if re.fullmatch("[0-9]+", stated) else -1) if info.isreg() else 0
        if length < 0:
            yield ordinal, None, None, _kind(info), at, "InvalidHeader"
            return
        long_name, extended = None, {}
        closed = False
        name = name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        if data + length > size:
            yield ordinal, name, length, _kind(info), data, "Truncated"
            return
        yield ordinal, name, length, _kind(info), data, None
        ordinal += 1
        begun = at = data + -(-length // RECORD) * RECORD
    if not closed and (stop is None or begun < stop):
        yield ordinal, None, None, None, at, "NoEOF"


def pax_fields(data: bytes) -> dict[str, str] | None:
    """`length key=value` records of an extended header; None if one is damaged."""
    fields = {}
    while data.strip(b"\0"):
        head, _, _ = data.partition(b" ")
        if not re.fullmatch(rb"[0-9]{1,9}", head) or not len(head) + 2 < int(head) <= len(data):
            return None
        record, data = data[len(head) + 1 : int(head) - 1], data[int(head) :]
        key, _, value = record.partition(b"=")
        fields[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
    return fields


def index_archives(archives: DataFrame, path: str = "path") -> DataFrame:
    """Entry rows of the archives in column `path` (schema `TAR_INDEX`), one archive at a time per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = TAR_INDEX.fieldNames()
        for batch in batches:
            for archive in column_values(batch, path):
                rows = []
                filesystem, name = resolve(archive)
                with filesystem.open_input_file(name) as stream:
                    for row in walk_headers(stream, stream.size()):
                        rows.append((archive, *row))
                        if len(rows) == INDEX_ROWS:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    return archives.select(path).mapInArrow(run, TAR_INDEX)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType] = INDEX_KINDS) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def tar_index(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Entries of all archives under `path`. PERMISSIVE keeps the `error` rows, FAILFAST raises on them."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    archives = listing(spark, path).select("path")
    index = index_archives(archives.repartition(shuffle_partitions(spark), "path"))
    if mode == "PERMISSIVE":
        return index
    message = F.concat(F.lit("bad tar archive "), "archive", F.lit(": "), "error")
    return index.filter(F.when(F.col("error").isNotNull(), F.raise_error(message).isNull()).otherwise(True))


def _ranges(index: DataFrame, range_bytes: int) -> DataFrame:
    """Cut entries into byte ranges and spread these over the cluster. Only offsets are shuffled."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest("entry_size", F.lit(1)) - 1, F.lit(range_bytes).cast("bigint"))
    cut = index.select("*", F.explode(starts).alias("_start"))
    length = F.least(F.lit(range_bytes), F.col("entry_size") - F.col("_start"))
    return by_window(cut.withColumn("_length", length), F.col("data_offset") + F.col("_start"))


def by_window(rows: DataFrame, offset: Column) -> DataFrame:
    """Spread index rows by windows of the archives: even in bytes, and neighbours stay together."""
    window = F.floor(offset / RANGE_BYTES)
    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "archive", window)
    # A stream can't be sorted; its archives come a few at a time.
    return spread if rows.isStreaming else spread.sortWithinPartitions("archive", offset)


class OpenArchive:
    """Ranges of archives, keeping the last archive open between calls."""

    def __init__(self) -> None:
        self.path, self.stream = None, None

    def at(self, path: str, offset: int):
        if path != self.path:
            self.close()
            filesystem, name = resolve(path)
            self.path, self.stream = path, filesystem.open_input_file(name)
        self.stream.seek(offset)
        return self.stream

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.path, self.stream = None, None


def tar_chunks(index: DataFrame, chunk_size: int = RECORD, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Data rows of indexed entries: `chunk_pos, bytes, first, last` added to entry columns.

    Empty entries and directories give one empty chunk with both flags set, as the last one of an
    entry is trimmed to the entry's size. A damaged entry gives one row with NULL bytes and its `error`.
    """
    if chunk_size % RECORD:
        raise ValueError("chunk_size must be a multiple of 512")
    range_bytes = max(chunk_size, range_bytes // chunk_size * chunk_size)
    columns = ["archive", "entry_ord", "entry_name", "entry_size", "entry_type"]
    schema = T.StructType(
        [index.schema[c] for c in columns]
        + [
            T.StructField("chunk_pos", T.LongType()),
            T.StructField("bytes", T.BinaryType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("error", T.StringType()),
        ]
    )
    per_batch = max(1, min(10_000, GROUP_BYTES // chunk_size))

    def read_range(archive: OpenArchive, row: dict) -> Iterator[tuple[int, bytes, bool, bool]]:
        size, start, length = row["entry_size"], row["_start"], row["_length"]
        if size == 0:
            yield 0, b"", True, True
            return
        stream = archive.at(row["archive"], row["data_offset"] + start)
        for at in range(start, start + length, chunk_size):
            data = stream.read(min(chunk_size, start + length - at))
            yield at // chunk_size, data, at == 0, at + len(data) == size

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    kinds += [pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = OpenArchive()
        rows: list[tuple] = []
        for batch in batches:
            for entry in batch.to_pylist():
                head = tuple(entry[c] for c in columns)
                for chunk in read_range(archive, entry):
                    rows.append((*head, *chunk, None))
                    if len(rows) == per_batch:
                        yield _batch(rows, schema.fieldNames(), kinds)
                        rows = []
        if rows:
            yield _batch(rows, schema.fieldNames(), kinds)
        archive.close()

    good = _ranges(index.filter("error IS NULL"), range_bytes).mapInArrow(run, schema)
    bad = index.filter("error IS NOT NULL")
    return good.unionByName(bad.select(*columns, "error"), allowMissingColumns=True)


def read_tar(
    spark: SparkSession, path: str | list[str], chunk_size: int = RECORD, mode: str = "FAILFAST"
) -> DataFrame:
    """Chunk rows of all archives under `path`."""
    return tar_chunks(tar_index(spark, path, mode), chunk_size)


def tar_entries(index: DataFrame, max_bytes: int = CELL_BYTES) -> DataFrame:
    """One row per entry with its bytes.

    Damaged entries, and with `error` EntryTooLarge those over `max_bytes` (by default what a cell can hold), have
    NULL bytes: read large ones as chunks.
    """
    schema = with_columns(index.schema, T.StructField("bytes", T.BinaryType()))
    large = F.col("error").isNull() & (F.col("entry_size") > max_bytes)
    marked = index.withColumn("error", F.when(large, "EntryTooLarge").otherwise(F.col("error"))).select(*index.columns)

    def read(archive: OpenArchive, row: dict) -> tuple[bytes | None]:
        if row["error"]:
            return (None,)
        return (archive.at(row["archive"], row["data_offset"]).read(row["entry_size"]),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = OpenArchive()
        for batch in batches:
            yield from payload_batches(batch, {"bytes": pa.binary()}, (read(archive, r) for r in batch.to_pylist()))
        archive.close()

    return by_window(marked, F.col("data_offset")).mapInArrow(run, schema)


def keep_files(index: DataFrame) -> DataFrame:
    return index.filter(F.col("entry_type") == "file")
