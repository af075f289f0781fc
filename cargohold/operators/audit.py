"""Compare what should be stored with what is stored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.storage import append_columns, column_values, digest_file, file_size, in_parallel, with_columns


def size_matches(length: str = "length", expected: str = "expected_size") -> Column:
    """A missing file has no length and does not match."""
    return F.coalesce(F.col(length) == F.col(expected), F.lit(False))


def digest_paths(df: DataFrame, path: str, wanted: Column, algorithm: str = "MD5", out: str = "actual_md5") -> DataFrame:
    """Digest the files behind the rows where `wanted` holds; other rows get NULL and read nothing.

    Workers stream each file in blocks, so only paths move through Spark and memory stays constant.
    A file that cannot be read gives NULL as well.
    """
    schema = with_columns(df.schema, T.StructField(out, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(column_values(batch, path), column_values(batch, "_wanted"))
            sums = [digest_file(p, algorithm) if wanted else None for p, wanted in pairs]
            kept = batch.select([n for n in batch.schema.names if n != "_wanted"])
            yield append_columns(kept, {out: pa.array(sums, pa.string())})

    return df.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).mapInArrow(run, schema)


def stat_paths(df: DataFrame, columns: dict[str, str], threads: int = 8) -> DataFrame:
    """Add the size of the file named by each path column, NULL where there is none.

    One metadata request per path, made by the task that holds the row: no listing of the store, no
    join and no shuffle, so many rows with one path or one directory do not matter. The requests of a
    task overlap, as they mostly wait.
    """
    schema = with_columns(df.schema, *[T.StructField(out, T.LongType()) for out in columns])

    def size_or_none(path: str | None) -> int | None:
        return None if path is None else file_size(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = {}
            for out, path in columns.items():
                calls = ((p,) for p in column_values(batch, path))
                sizes[out] = pa.array(in_parallel(size_or_none, calls, threads), pa.int64())
            yield append_columns(batch, sizes)

    return df.mapInArrow(run, schema)


def join_listing(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Left join with a store listing; no hint, so Spark broadcasts it only when it is small enough."""
    stored = listing.select([F.col(c).alias(f"_{c}") for c in listing.columns])
    return df.join(stored, F.col(path) == F.col("_path"), "left")


def plan_fetch(
    df: DataFrame,
    listing: DataFrame | None = None,
    check_md5: bool = True,
    always: bool = False,
    path: str = "dest_path",
) -> DataFrame:
    """Add `need_fetch` and `reason`, cheap checks first: missing, size, then digest.

    `listing` has `path`, `length` and optionally `md5`; without a listing the size is asked for row by
    row. Without `md5` the stored bytes are read, but only for rows whose size already matches.
    """
    joined = stat_paths(df, {"_length": path}) if listing is None else join_listing(df, listing, path)
    same_size = size_matches("_length")
    if check_md5 and not always and (listing is None or "md5" not in listing.columns):
        joined = digest_paths(joined, path, same_size, out="_md5")
    reason = F.when(F.lit(always), "always").when(F.col("_length").isNull(), "missing").when(~same_size, "size")
    if check_md5 and not always:
        reason = reason.when(~F.col("_md5").eqNullSafe(F.col("expected_md5")), "md5")
    return joined.select(*df.columns, F.coalesce(reason, F.lit("valid")).alias("reason")).withColumn(
        "need_fetch", F.col("reason") != "valid"
    )


def verify_artifacts(
    manifest: DataFrame, listing: DataFrame | None = None, check_md5: bool = True, folder: str | None = None
) -> DataFrame:
    """`state` of every expected artifact: ok, missing, size_mismatch or md5_mismatch.

    The manifest has `name`, `size` and `md5_hex`. The store is a listing (`path` equal to the name,
    `length`, `md5`) or a folder whose files are asked for one by one.
    """
    if listing is not None:
        joined = join_listing(manifest, listing, "name")
    else:
        placed = manifest.withColumn("_path", F.concat(F.lit(f"{folder}/"), "name"))
        joined = stat_paths(placed, {"_length": "_path"})
    same_size = size_matches("_length", "size")
    if check_md5 and listing is None:
        joined = digest_paths(joined, "_path", same_size, out="_md5")
    state = F.when(F.col("_length").isNull(), "missing").when(~same_size, "size_mismatch")
    if check_md5:
        state = state.when(~F.col("_md5").eqNullSafe(F.col("md5_hex")), "md5_mismatch")
    return joined.select(*manifest.columns, state.otherwise("ok").alias("state"))


def resize_needed(df: DataFrame, listing: DataFrame, path: str = "resized_path") -> DataFrame:
    """Rows whose resized copy is absent or empty."""
    # Distinct by the join key: merged before the shuffle that the join needs anyway.
    present = listing.filter("length > 0").select(F.col("path").alias(path)).distinct()
    return df.join(present, path, "left_anti")


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume across runs: drop rows that an earlier success table already holds."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def join_results(saved: DataFrame, digested: DataFrame, keys: list[str]) -> DataFrame:
    """Zip two results of the same element; an error on either side is the error of the row."""
    left = saved.withColumnRenamed("error", "_error_a")
    right = digested.withColumnRenamed("error", "_error_b")
    joined = left.join(right, keys, "full")
    kept = [c for c in joined.columns if c not in ("_error_a", "_error_b")]
    return joined.select(*kept, F.coalesce("_error_a", "_error_b").alias("error"))


def quarantine(df: DataFrame, path: str = "dest_path") -> DataFrame:
    """Stored copies that failed their check, for an opt-in deletion step."""
    return df.filter(F.col("failure_code").isin("MD5SumMismatch", "ImageIO")).select(
        F.col(path).alias("to_delete"), "failure_code"
    )
