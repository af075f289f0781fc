"""Success and failure tables: every input row ends in exactly one of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.functions.text import csv_quote
from cargohold.schemas import FAILURE_COLUMNS, FAILURE_DETAILS, IMAGE_LIST_COLUMNS
from cargohold.session import scratch_dir, shuffle_partitions
from cargohold.sinks.files import spool
from cargohold.sources.files import listing
from cargohold.storage import blocks, column_values, file_size, resolve, write_atomic

CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
QUOTED = ("Author", "Title", FAILURE_DETAILS)


def success_rows(df: DataFrame) -> DataFrame:
    return df.filter("failure_code IS NULL").select(*IMAGE_LIST_COLUMNS)


def failure_rows(df: DataFrame) -> DataFrame:
    details = F.coalesce("failure_details", F.lit("")).alias(FAILURE_DETAILS)
    return df.filter("failure_code IS NOT NULL").select(*IMAGE_LIST_COLUMNS, details)


def result_line(columns: list[str]) -> Column:
    """The fixed text form: author, title and details always quoted, other fields never."""
    fields = [csv_quote(F.col(c)) if c in QUOTED else F.col(c) for c in columns]
    return F.concat_ws(",", *fields)


def write_results(
    df: DataFrame, out: str, subsets: list[str] | None = None, compat: bool = False, mode: str = "overwrite", stored: bool = False
) -> None:
    """`outcome=success|failure/subset_dir=.../*.csv` with headers, without a shuffle.

    The rows are evaluated once: they are stored first, and both tables are written from there, so a row can't end
    in both or in none when its source answers differently the second time. `stored` says that `df` only reads a table.

    `subsets` get a header-only file where an outcome has no rows. `compat` writes `result_line` text
    instead, whose unquoted fields cannot be read back when they hold a comma; the header is a file of
    its own that sorts first, so the parts of a folder in order are the one file they stand for.
    """
    needed = [*IMAGE_LIST_COLUMNS, "failure_code", "failure_details"]
    df = df.select(*[F.col(c).cast("string").alias(c) for c in needed])
    if not stored:
        df = spool(df, scratch_dir(df.sparkSession, "results"))
    parts = {"success": (success_rows(df), IMAGE_LIST_COLUMNS), "failure": (failure_rows(df), FAILURE_COLUMNS)}
    for name, (rows, columns) in parts.items():
        target = f"{out}/outcome={name}"
        if compat:
            lines = rows.select(result_line(columns).alias("value"), F.col("Subset").alias("subset_dir"))
            lines.write.mode(mode).partitionBy("subset_dir").text(target)
            _write_headers(target, columns)
        else:
            writer = rows.withColumn("subset_dir", F.col("Subset")).write.mode(mode).options(**CSV_WRITE_OPTIONS)
            writer.partitionBy("subset_dir").csv(target)
        for subset in subsets or []:
            _ensure_header(f"{target}/subset_dir={subset}", columns)


def _write_headers(target: str, columns: list[str]) -> None:
    filesystem, name = resolve(target)
    for folder in filesystem.get_file_info(fs.FileSelector(name)):
        if folder.type == fs.FileType.Directory:
            with filesystem.open_output_stream(f"{folder.path}/part-00000-0-header.txt") as stream:
                stream.write((",".join(columns) + "\n").encode())


def _ensure_header(folder: str, columns: list[str]) -> None:
    """A header-only file where an outcome has no rows for the subset."""
    filesystem, name = resolve(folder)
    header = (",".join(columns) + "\n").encode()
    if filesystem.get_file_info(name).type.name == "NotFound":
        filesystem.create_dir(name, recursive=True)
        with filesystem.open_output_stream(f"{name}/part-header.csv") as stream:
            stream.write(header)


def repair_headers(spark: SparkSession, path: str | list[str], columns: list[str], known: list[str] | None = None) -> DataFrame:
    """Give every CSV file under `path` the header `columns`; returns `path, action, error`, one row for each file.

    `action` is `ok`, `written` (the file was empty), `added` (it began with a row), `replaced` (it began with another
    header of as many fields) or `refused`. No row is ever lost: a file is copied behind its new header under another
    name, compared by size and only then renamed, so a killed task leaves the old file or the new one. A header of
    another number of fields, or of the same names in another order, would give the rows other columns: such a file is
    left as it is, with an `error`. A first line is a header if its first field or half of its fields are among
    `known` (by default `columns` and those of both result tables); a row that reads like this is taken for one.
    Lazy, like every sink with result rows: store them once. A second run finds all files `ok`.
    """
    names = {c.strip('"') for c in (known if known is not None else [*columns, *IMAGE_LIST_COLUMNS, *FAILURE_COLUMNS])}
    head = (",".join(columns) + "\n").encode()

    def first_line(place: str) -> bytes:
        filesystem, name = resolve(place)
        line = b""
        with filesystem.open_input_stream(name, compression=None) as stream:
            for block in blocks(stream, 4096):
                line += block
                if b"\n" in block:
                    return line[: line.index(b"\n") + 1]
        return line

    def body(place: str, skip: int) -> Iterator[bytes]:
        yield head
        filesystem, name = resolve(place)
        with filesystem.open_input_file(name) as stream:
            stream.seek(skip)
            yield from blocks(stream)

    def repair(place: str) -> tuple[str, str | None]:
        try:
            line, size = first_line(place), file_size(place)
            if line.rstrip(b"\r\n") == head.rstrip():
                return "ok", None
            fields = [f.strip('"') for f in line.decode("utf-8-sig", "replace").rstrip("\r\n").split(",")]
            skip = 0
            if fields[0] in names or 2 * sum(f in names for f in fields) > len(fields):
                if len(fields) != len(columns):
                    return "refused", f"header of {len(fields)} fields"
                if sorted(fields) == sorted(columns) and fields != columns:
                    return "refused", "header in another order"
                skip = len(line)
            write_atomic(place, body(place, skip), size - skip + len(head))
        except OSError as exc:
            return "refused", f"{type(exc).__name__}: {exc}"
        return ("written" if not size else "replaced" if skip else "added"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = column_values(batch, "path")
            actions, errors = zip(*map(repair, places)) if places else ((), ())
            cells = [pa.array(c, pa.string()) for c in (places, actions, errors)]
            yield pa.record_batch(cells, names=["path", "action", "error"])

    files = listing(spark, path).filter("path LIKE '%.csv'").select("path")
    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(run, "path string, action string, error string")
