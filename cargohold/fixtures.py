"""Inputs that the registered queries derive from the given tables: image lists, responses, archives."""

from __future__ import annotations

import gzip
import hashlib
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.operators.images import encode_png
from cargohold.storage import append_columns, column_values, write_atomic

LICENSE = "https://creativecommons.org/licenses/by/2.0/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as image-list rows, each with the response a server might have given."""
    case = F.col("page_id") % 12
    size = F.octet_length("html").cast("bigint")
    digested = F.md5(F.when(F.col("page_id") % 17 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    subset = F.when(F.col("page_id") % 10 == 0, "validation").when(F.col("page_id") % 10 == 1, "test").otherwise("train")
    thumb = F.concat(F.lit("https://thumb.example.com/"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("_z.jpg"))
    status = F.when(case == 7, 302).when(case == 8, 404).when(case == 9, 204).when(case != 10, 200)
    return table(spark, sf_dir, "pages").select(
        F.lpad(F.col("page_id").cast("string"), 16, "0").alias("ImageID"),
        subset.alias("Subset"),
        F.col("url").alias("OriginalURL"),
        F.lit("").alias("OriginalLandingURL"),
        F.lit(LICENSE).alias("License"),
        F.lit("").alias("AuthorProfileURL"),
        F.concat(F.lit('author "'), "page_id", F.lit('", and others')).alias("Author"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("Title"),
        size.cast("string").alias("OriginalSize"),
        F.base64(F.unhex(digested)).alias("OriginalMD5"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(thumb).alias("Thumbnail300KURL"),
        status.cast("int").alias("status"),
        F.when(case == 10, "connection reset").alias("transport_error"),
        F.when(case == 6, "text/html").otherwise("image/jpeg").alias("content_type"),
        F.when(case == 4, size + 1).when(case != 5, size).alias("content_length"),
        F.lit(None).cast("string").alias("location"),
        F.col("html").cast("binary").alias("body"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as named payloads `lang/source/doc_id.txt`."""
    name = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", name.alias("name"), F.col("text").cast("binary").alias("bytes"), "n_chars"
    )


def gzip_column(df: DataFrame, col: str) -> DataFrame:
    columns = df.columns
    rest = [c for c in columns if c != col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(v, mtime=0) for v in column_values(batch, col)]
            yield append_columns(batch.select(rest), {col: pa.array(packed, pa.binary())}).select(columns)

    return df.mapInArrow(run, df.schema)


def tar_blocks(rows: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    for name, data in rows:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        yield info.tobuf(tarfile.PAX_FORMAT)
        yield data + b"\0" * (-len(data) % 512)
    yield b"\0" * 1024


def pack_tars(df: DataFrame, folder: str) -> DataFrame:
    """Pack `name, bytes` rows into one tar per task; returns the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(column_values(batch, "name"), column_values(batch, "bytes"))

        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.tar"
        write_atomic(path, tar_blocks(rows()))
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return df.select("name", "bytes").mapInArrow(run, "path string")


def pack_gzips(df: DataFrame, folder: str) -> DataFrame:
    """Pack `doc_id, bytes` rows into one gzip file per task, a member for each; returns `doc_id, path, start`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids, starts, at = f"{folder}/part-{TaskContext.get().partitionId():05d}.gz", [], [], 0

        def members() -> Iterator[bytes]:
            nonlocal at
            for batch in batches:
                for key, value in zip(column_values(batch, "doc_id"), column_values(batch, "bytes")):
                    ids.append(key)
                    starts.append(at)
                    packed = gzip.compress(value, mtime=0)
                    at += len(packed)
                    yield packed

        write_atomic(path, members())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([path] * len(ids), pa.string()), pa.array(starts, pa.int64())], names=["doc_id", "path", "start"])

    return df.select("doc_id", "bytes").mapInArrow(run, "doc_id bigint, path string, start bigint")


def csv_field(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def pack_lists(rows: DataFrame, folder: str) -> DataFrame:
    """Pack image-list rows into one `part-N.tar.gz` per task with a CSV per subset in it.

    Returns manifest columns for both forms of every archive.
    """
    columns = rows.columns
    subset_at = columns.index("Subset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        lines: dict[str, list[str]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                lines.setdefault(row[subset_at], [",".join(columns)]).append(",".join(csv_field(v) for v in row))
        files = ((f"part-{part}/{s}/images.csv", ("\n".join(v) + "\n").encode()) for s, v in sorted(lines.items()))
        tar = b"".join(tar_blocks(files))
        packed = gzip.compress(tar, mtime=0)
        write_atomic(f"{folder}/part-{part}.tar.gz", [packed])
        forms = [("tar.gz", packed), ("tar", tar)]
        cells = [
            ["images"] * 2,
            [f"https://archive.example.com/part-{part}.tar.gz"] * 2,
            [kind for kind, _ in forms],
            [f"part-{part}.{kind}" for kind, _ in forms],
            [len(data) for _, data in forms],
            [hashlib.md5(data).hexdigest() for _, data in forms],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["role", "uri", "kind", "name", "size", "md5_hex"])

    return rows.mapInArrow(run, "role string, uri string, kind string, name string, size bigint, md5_hex string")


def gray_images(df: DataFrame) -> DataFrame:
    """Add `png`: an evenly gray picture of size `w` x `h` and brightness `v`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*[column_values(batch, c) for c in ("w", "h", "v")])
            data = [encode_png(np.full((h, w, 1), v, np.uint8)) for w, h, v in cells]
            yield append_columns(batch, {"png": pa.array(data, pa.binary())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, png binary")
