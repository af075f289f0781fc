"""Image-list CSV files as DataFrames of text columns."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.operators.skew import DEFAULT_POLICY, SkewPolicy, running_sums, slice_hot_keys
from cargohold.schemas import IMAGE_LIST_COLUMNS
from cargohold.session import scratch_dir
from cargohold.sinks.files import spool
from cargohold.sources.files import listing, plain_path
from cargohold.storage import column_values, resolve

CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "nullValue": "\u0000",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    # A list of eleven text columns may hold a very long field.
    "maxCharsPerColumn": "-1",
}


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path` and first line of every file; workers read one line of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lines = column_values(batch, "path"), []
            for item in paths:
                filesystem, name = resolve(item)
                with filesystem.open_input_stream(name, compression="detect") as stream:
                    head = b""
                    while b"\n" not in head and (block := stream.read(4096)):
                        head += block
                lines.append(head.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lines, pa.string())], ["path", "line"])

    return listing(spark, path).select("path").mapInArrow(run, "path string, line string")


def header_ok(spark: SparkSession, path: str | list[str], header: list[str]) -> DataFrame:
    """`path` and whether the file starts with the expected header line."""
    expected = ",".join(header)
    return first_lines(spark, path).select("path", (F.col("line") == expected).alias("header_ok"))


def _read_plain(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.options(**CSV_OPTIONS).option("header", "true").option("enforceSchema", "true")
    raw = reader.option("recursiveFileLookup", "true").schema(schema).csv(paths)
    return raw.select("*", plain_path(F.col("_metadata.file_path")).alias("_csv_filename"))


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that starts inside a quoted field, or at the start of one, ends inside.

    A quote opens a field where one begins: at the start of the line or behind a comma. The next quote closes it,
    unless another follows at once. Any other quote is text.
    """
    plain, quoted, closed = 0, 1, 2
    parts = F.split(line, '"')

    def at_quote(state: Column, before: Column) -> Column:
        opens = before.endswith(",") | ((state == closed) & (before == ""))
        return F.when(state == quoted, closed).when(opens, quoted).otherwise(plain)

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(quoted if inside else closed), at_quote) == quoted


def _read_quoted(
    spark: SparkSession, paths: str | list[str], columns: list[str], policy: SkewPolicy, only: DataFrame | None = None
) -> DataFrame:
    """Line breaks in quoted fields, without the one task per file that `multiLine` takes.

    A quote opens a field only where one begins, and the next single quote closes it; others are text. So a line
    takes the state at its start (inside a field or not) to that at its end: whatever the start (`_fixed`), or kept,
    or swapped. The state at a line is that after the last fixed line before it, swapped by the lines since; all of
    this are running sums over lines that are read in parallel. Lines of one record are then joined again. A file
    that ends inside a field raises. Lines are stored once, so every branch sees the same ones.
    """
    at = plain_path(F.col("_metadata.file_path")).alias("_csv_filename")
    block = F.col("_metadata.file_block_start").alias("_block")
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    raw = reader.text(paths).select(at, block, F.monotonically_increasing_id().alias("_row"), "value")
    if only is not None:
        raw = raw.join(only.select(F.col("path").alias("_csv_filename")), "_csv_filename", "left_semi")
    lines = spool(raw.withColumn("_out", _ends_inside(F.col("value"), False)).withColumn("_in", _ends_inside(F.col("value"), True)), scratch_dir(spark, "lines"))
    # The text stays out of the sums; it meets the number of its record once.
    s = slice_hot_keys(lines.drop("value"), ["_csv_filename"], ["_block", "_row"], policy)
    fixed = (F.col("_out") == F.col("_in")).cast("bigint")
    swaps = (F.col("_out") & ~F.col("_in")).cast("bigint")
    before = running_sums(s, s.df, {"_fixed": fixed, "_swaps": swaps}, inclusive=False)
    # The n-th fixed line says what holds behind it, until the next.
    known = before.filter("_out = _in").select(
        F.col("_csv_filename").alias("_f"), (F.col("_fixed") + 1).alias("_n"), F.col("_out").alias("_to"), F.col("_swaps").alias("_upto")
    )
    joined = before.join(known, (F.col("_csv_filename") == F.col("_f")) & (F.col("_fixed") == F.col("_n")), "left")
    swapped = (F.col("_swaps") - F.coalesce("_upto", F.lit(0))) % 2 == 1
    inside = F.coalesce("_to", F.lit(False)) != swapped
    states = joined.select(*before.columns, inside.alias("_inside"))
    after = F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out"))
    ends = states.groupBy("_csv_filename").agg(F.max_by(after, F.struct("_block", "_row")).alias("_open")).filter("_open").first()
    if ends is not None:
        raise ValueError(f"{ends['_csv_filename']} ends inside a quoted field")
    numbered = running_sums(s, states, {"_record": F.when(F.col("_inside"), 0).otherwise(1), "_at": F.lit(1)})
    text = F.expr("listagg(value, '\n') WITHIN GROUP (ORDER BY _at)")
    placed = lines.select("_row", "value").join(numbered.select("_row", "_csv_filename", "_record", "_at"), "_row")
    records = placed.groupBy("_csv_filename", "_record").agg(text.alias("_text"))
    body = records.filter("_record > 1").withColumn("_text", F.regexp_replace("_text", "\r$", ""))
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv("_text", schema, CSV_OPTIONS).alias("_fields")
    return body.filter("_text <> ''").select(parsed, "_csv_filename").select("_fields.*", "_csv_filename")


def read_image_list(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    columns: list[str] | None = None,
    with_filename: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Rows of all lists under `path`; missing fields are empty text, never NULL.

    Columns are found by each file's own header line, so their order may differ between files. Large
    files are split either way; `multi_line=False` saves a shuffle where no field holds a line break.
    """
    wanted = columns or IMAGE_LIST_COLUMNS
    heads = spool(first_lines(spark, path), scratch_dir(spark, "heads"))
    headers = sorted(row["line"] for row in heads.select("line").distinct().collect() if row["line"])
    parts = []
    for line in headers:
        names = next(csv.reader([line.lstrip("\ufeff")]))
        missing = [c for c in wanted if c not in names]
        if missing:
            raise ValueError(f"columns {missing} not in the header {line!r}")
        only = heads.filter(F.col("line") == line) if len(headers) > 1 else None
        if multi_line:
            part = _read_quoted(spark, path, names, policy, only)
        else:
            # Spark's own reader wants the paths of the files with this header.
            part = _read_plain(spark, path if only is None else [r["path"] for r in only.select("path").collect()], names)
        kept = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in wanted]
        parts.append(part.select(*kept, *(["_csv_filename"] if with_filename else [])))
    if not parts:
        fields = [*wanted, *(["_csv_filename"] if with_filename else [])]
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in fields]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
