"""Tar archives as a Spark data source: `spark.read.format("tar")`, split by windows, filtered on the headers.

    register(spark)
    spark.read.format("tar").option("path", folder).load().filter("entry_name LIKE 'train/%' AND entry_size < 1000000")

Without more, each archive is one partition. `write_windows` finds, in a Spark job over the archives, where in each
window of bytes the first entry begins; with its table as option `windows`, each window is a partition of its own, or
with option `tasks` windows that follow each other share one, so that there are about that many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from cargohold.schemas import TAR_INDEX
from cargohold.session import qualify, scratch_dir, shuffle_partitions
from cargohold.sources.files import listing, plain_path
from cargohold.sources.tar import CELL_BYTES, INDEX_KINDS, INDEX_ROWS, RECORD, index_archives, tar_entries, walk_headers
from cargohold.storage import GROUP_BYTES, column_values, resolve

#: Bytes of an archive that one partition reads.
WINDOW_BYTES = 256 * 1024 * 1024
#: Partitions of one read for each core, or shuffle partition if these are more, before windows share one.
TASKS_PER_CORE = 16
#: Beyond any archive; a cut one ends before its last entry does.
END = 1 << 62
WINDOWS = "archive string, begin bigint, ordinal bigint, size bigint"
#: Columns of Spark's file source (fixed).
FILES = "path string, modificationTime timestamp, length bigint, content binary"
COLUMNS = TAR_INDEX.fieldNames()


def _tests() -> dict:
    return {
        D.EqualTo: lambda v, f: v == f.value,
        D.In: lambda v, f: v in f.value,
        D.GreaterThan: lambda v, f: v > f.value,
        D.GreaterThanOrEqual: lambda v, f: v >= f.value,
        D.LessThan: lambda v, f: v < f.value,
        D.LessThanOrEqual: lambda v, f: v <= f.value,
        D.StringStartsWith: lambda v, f: v.startswith(f.value),
        D.StringEndsWith: lambda v, f: v.endswith(f.value),
        D.StringContains: lambda v, f: f.value in v,
    }


def holds(condition: D.Filter, row: dict) -> bool | None:
    """Whether a pushed filter holds for a header, as SQL: None where a value is NULL."""
    if isinstance(condition, D.Not):
        found = holds(condition.child, row)
        return None if found is None else not found
    value = row[condition.attribute[0]]
    if isinstance(condition, D.IsNull):
        return value is None
    if isinstance(condition, D.IsNotNull):
        return value is not None
    if isinstance(condition, D.EqualNullSafe):
        return value == condition.value
    return None if value is None else _tests()[type(condition)](value, condition)


def answerable(condition: D.Filter) -> bool:
    if isinstance(condition, D.Not):
        return answerable(condition.child)
    known = (*_tests(), D.IsNull, D.IsNotNull, D.EqualNullSafe)
    return isinstance(condition, known) and len(condition.attribute) == 1 and condition.attribute[0] in COLUMNS


@dataclass
class Window(D.InputPartition):
    """Entries of an archive whose headers begin in [begin, stop)."""

    archive: str
    begin: int
    ordinal: int
    stop: int
    size: int


class TarReader(D.DataSourceReader):
    """Reads the headers of its window and the data of the entries that pass the filters, nothing else."""

    def __init__(self, options: dict, schema: T.StructType):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.windows = options.get("path"), options.get("windows")
        if not (self.path or self.windows):
            raise ValueError("the tar source needs a path or a table of windows")
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError("mode must be FAILFAST or PERMISSIVE")
        self.max_bytes = int(options.get("maxbytes", CELL_BYTES))
        self.tasks = int(options["tasks"]) if "tasks" in options else None
        self.names = schema.fieldNames()
        self.filters: list[D.Filter] = []
        #: Ranges of data that were opened and their bytes, for tests.
        self.opened = [0, 0]

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for condition in filters:
            if answerable(condition):
                self.filters.append(condition)
            else:
                yield condition

    def _wanted(self, archive: str) -> bool:
        only = [f for f in self.filters if not isinstance(f, D.Not) and f.attribute == ("archive",)]
        return all(holds(f, {"archive": archive}) for f in only)

    def partitions(self) -> list[Window]:
        if self.windows:
            filesystem, name = resolve(self.windows)
            rows = ds.dataset(name, filesystem=filesystem, format="parquet").to_table().sort_by([("archive", "ascending"), ("begin", "ascending")]).to_pylist()
            rows = [r for r in rows if self._wanted(r["archive"])]
            # Neighbours in an archive share a partition: as many as leave about `tasks` of them, and about WINDOW_BYTES at most.
            most = -(-len(rows) // self.tasks) if self.tasks else 1
            heads, held = [], 0
            for r in rows:
                if heads and heads[-1]["archive"] == r["archive"] and held < most and r["begin"] - heads[-1]["begin"] < WINDOW_BYTES:
                    held += 1
                else:
                    heads.append(r)
                    held = 1
            return [
                Window(r["archive"], r["begin"], r["ordinal"], n["begin"] if n and n["archive"] == r["archive"] else END, r["size"])
                for r, n in zip(heads, [*heads[1:], None])
            ] or [Window("", 0, 0, 0, -1)]
        return [Window(path, 0, 0, END, size) for path, size in archives_under(self.path) if self._wanted(path)] or [Window("", 0, 0, 0, -1)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if partition.size < 0:
            return
        kinds = [*INDEX_KINDS, pa.binary()]
        rows, held = [], 0
        filesystem, name = resolve(partition.archive)
        with filesystem.open_input_file(name) as stream:
            for found in walk_headers(stream, partition.size, partition.begin, partition.ordinal, partition.stop):
                row = dict(zip(COLUMNS, (partition.archive, *found)))
                large = row["error"] is None and "bytes" in self.names and row["entry_size"] > self.max_bytes
                if large:
                    row["error"] = "EntryTooLarge"
                elif row["error"] and self.mode == "FAILFAST":
                    raise ValueError(f"bad tar archive {partition.archive}: {row['error']}")
                if not all(holds(f, row) for f in self.filters):
                    continue
                if "bytes" in self.names:
                    row["bytes"] = None
                    if row["error"] is None:
                        stream.seek(row["data_offset"])
                        row["bytes"] = stream.read(row["entry_size"]) if row["entry_size"] else b""
                        self.opened[0] += 1
                        self.opened[1] += row["entry_size"]
                        held += row["entry_size"]
                rows.append(tuple(row[c] for c in self.names))
                if len(rows) == INDEX_ROWS or held >= GROUP_BYTES:
                    yield self._batch(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, kinds)

    def _batch(self, rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=self.names)


def archives_under(path: str) -> Iterator[tuple[str, int]]:
    """Files under a folder, or the file itself, with their sizes; hidden ones are passed over."""
    filesystem, name = resolve(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = filesystem.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    items = [info] if info.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(name, recursive=True))
    below = len(name.rstrip("/"))
    for item in sorted(items, key=lambda i: i.path):
        hidden = item is not info and any(part[:1] in ("_", ".") for part in item.path[below:].split("/") if part)
        if item.type == fs.FileType.File and not hidden:
            yield prefix + item.path, item.size


class TarDataSource(D.DataSource):
    """Options: `path` (a file or folder) or `windows` (and `tasks`); `bytes` (false: headers only), `mode`, `maxBytes`."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> T.StructType:
        headers = self.options.get("bytes", "true").lower() == "false"
        return TAR_INDEX if headers else T.StructType([*TAR_INDEX.fields, T.StructField("bytes", T.BinaryType())])

    def reader(self, schema: T.StructType) -> TarReader:
        return TarReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make `format("tar")` known to the session and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarDataSource)


def write_windows(spark: SparkSession, path: str | list[str], out: str, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """Table (archive, begin, ordinal, size): for each `window_bytes` of every archive, its first entry.

    Tasks walk the headers, one archive each, and leave one row for each window, whatever the number of entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in column_values(batch, "path"):
                filesystem, name = resolve(archive)
                rows, begin, last = [], 0, -1
                with filesystem.open_input_file(name) as stream:
                    size = stream.size()
                    for ordinal, _, length, _, offset, error in walk_headers(stream, size):
                        if begin // window_bytes != last:
                            rows.append((archive, begin, ordinal, size))
                            last = begin // window_bytes
                        if error is None:
                            begin = offset + -(-length // RECORD) * RECORD
                rows = rows or [(archive, 0, 0, size)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["archive", "begin", "ordinal", "size"])

    archives = listing(spark, path).select("path").repartition(shuffle_partitions(spark), "path")
    archives.mapInArrow(run, WINDOWS).write.parquet(out)
    return spark.read.schema(WINDOWS).parquet(out)


def read_archives(spark: SparkSession, path: str | list[str], window_bytes: int = WINDOW_BYTES, **options: str) -> DataFrame:
    """Entries of all archives under `path` through the source, with a partition for every window or, where these are
    far more than the cluster's cores, for a few that follow each other."""
    register(spark)
    table = qualify(spark, scratch_dir(spark, "windows"))
    write_windows(spark, path, table, window_bytes)
    tasks = TASKS_PER_CORE * max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    return spark.read.format("tar").options(**{"windows": table, "tasks": str(tasks), **options}).load()


def stream_archives(spark: SparkSession, path: str, glob: str = "*.tar", per_trigger: int = 100) -> DataFrame:
    """Entries of archives as they arrive in a folder, `per_trigger` archives in a micro-batch; put them there by renaming.

    Which archives have been read is Spark's own file log, in the query's checkpoint. Damaged entries come as rows with `error`.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    arrived = files.option("maxFilesPerTrigger", per_trigger).load(path).select(plain_path("path").alias("path"))
    return tar_entries(index_archives(arrived))
