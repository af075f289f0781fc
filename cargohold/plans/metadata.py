"""Metadata job: fetch archives, unpack them, keep the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.config import JobConfig
from cargohold.operators.aggregate import assert_no_failures
from cargohold.operators.audit import verify_artifacts
from cargohold.session import scratch_dir
from cargohold.sinks.files import extract_tar, spool
from cargohold.sources.fetch import Fetcher, fetch_to_store
from cargohold.sources.files import gunzip_files
from cargohold.sources.image_list import read_image_list
from cargohold.sources.manifest import manifest
from cargohold.sources.tar import index_archives, keep_files


def archives(rows: DataFrame) -> DataFrame:
    """One row per archive from manifest rows: `uri`, and name, size and md5 of both its forms."""
    form = [F.struct("name", "size", "md5_hex").alias("form")]
    gz = rows.filter("kind = 'tar.gz'").select("uri", "role", *form).withColumnRenamed("form", "gz")
    tar = rows.filter("kind = 'tar'").select("uri", *form).withColumnRenamed("form", "tar")
    return gz.join(tar, "uri")


def unpack_archives(
    spark: SparkSession, cfg: JobConfig, rows: DataFrame, fetcher: Fetcher, check_md5: bool = True
) -> DataFrame:
    """Bring the tar form of every archive to disk; returns its `path`. Raises when one fails.

    A valid stored tar is used as it is, a valid stored tar.gz is not fetched again. Archives go to the
    root with `save_tarballs`, else to scratch space.
    """
    work = scratch_dir(spark, "archives")
    folder = cfg.root if cfg.save_tarballs else work
    state = verify_artifacts(rows, None, check_md5, cfg.root).select("name", "state")
    states = [state.select(F.col("name").alias(f"{k}_name"), F.col("state").alias(f"{k}_state")) for k in ("gz", "tar")]
    planned = archives(rows).join(states[0], F.col("gz.name") == F.col("gz_name"))
    planned = planned.join(states[1], F.col("tar.name") == F.col("tar_name"))

    def place(kind: str) -> F.Column:
        root = F.when(F.col(f"{kind}_state") == "ok", cfg.root).otherwise(folder)
        return F.concat(root, F.lit("/"), F.col(f"{kind}_name"))

    planned = planned.select(
        "uri", "gz", "tar", "gz_state", "tar_state", place("gz").alias("gz_path"), place("tar").alias("tar_path")
    )
    # The steps have side effects: each is run once and its small result stored.
    planned = spool(planned, f"{work}/plan")
    wanted = planned.filter("tar_state <> 'ok' AND gz_state <> 'ok'").withColumn("max_bytes", F.col("gz.size"))
    fetched = fetch_to_store(
        wanted, "uri", "gz_path", fetcher, cfg.max_retries, cfg.max_host_connections, cfg.max_total_connections, "max_bytes"
    )
    sums = F.when(F.col("md5") != F.col("gz.md5_hex"), F.concat(F.lit("md5 sum mismatch: "), "uri")) if check_md5 else F.lit(None)
    assert_no_failures(spool(fetched.withColumn("error", F.coalesce("error", sums)), f"{work}/fetched"), order_by="uri")
    packed = planned.filter("tar_state <> 'ok'").repartition(cfg.max_total_connections, "gz_path")
    unzipped = gunzip_files(packed, "gz_path", "tar_path")
    assert_no_failures(spool(unzipped, f"{work}/unzipped"), order_by="uri")
    return planned.select("uri", F.col("tar_path").alias("path"))


def extract_archives(spark: SparkSession, cfg: JobConfig, tars: DataFrame) -> DataFrame:
    """Extract all entries under the root; one result row per entry, raises on the first failed one."""
    index = index_archives(tars.repartition("path"))
    out = spool(extract_tar(index, cfg.root), scratch_dir(spark, "extracted"))
    assert_no_failures(out, order_by="entry_ord")
    return out


def ingest_metadata(
    spark: SparkSession, cfg: JobConfig, fetcher: Fetcher, rows: DataFrame | None = None
) -> DataFrame:
    """Annotation and class archives of the configured version, extracted under the root."""
    source = manifest(spark, cfg.dataset_version) if rows is None else rows
    return extract_archives(spark, cfg, unpack_archives(spark, cfg, source.filter("role = 'other'"), fetcher))


def image_list_from_archive(
    spark: SparkSession, cfg: JobConfig, fetcher: Fetcher, rows: DataFrame | None = None, multi_line: bool = True
) -> DataFrame:
    """Rows of the CSV lists inside the image archive, with `_csv_filename`."""
    source = manifest(spark, cfg.dataset_version) if rows is None else rows
    tars = unpack_archives(spark, cfg, source.filter("role = 'images'"), fetcher)
    extracted = keep_files(extract_archives(spark, cfg, tars))
    # One path per list file, a handful per archive.
    paths = [row["path"] for row in extracted.select("path").collect()]
    return read_image_list(spark, paths, multi_line, with_filename=True)
