"""Image job: plan, fetch, verify, save, resize, and one result row per input row."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.config import JobConfig
from cargohold.functions.paths import download_params, resized_path
from cargohold.operators import changes
from cargohold.operators.audit import plan_fetch, stat_paths
from cargohold.operators.classify import (
    FAILURE_BODY_LIMIT,
    body_failure,
    failure_message,
    header_failure,
    input_failure,
    outcome,
    size_limit,
    verify_digest,
)
from cargohold.operators.images import resize_payloads
from cargohold.operators.route import if_then_else
from cargohold.schemas import IMAGE_LIST_COLUMNS, RESPONSE, SUBSETS
from cargohold.session import qualify, scratch_dir, shuffle_partitions
from cargohold.sinks import packs
from cargohold.sinks.files import spool, write_files
from cargohold.sinks.results import write_results
from cargohold.sources.fetch import RESPONSE_KINDS, Fetcher, Response, fetch
from cargohold.storage import column_values, file_size, payload_batches, resolve, write_atomic

RESULT_COLUMNS = [
    *IMAGE_LIST_COLUMNS,
    "url",
    "dest_path",
    "resized_path",
    "need_fetch",
    "reason",
    "bytes_written",
    "failure_code",
    "failure_details",
]

PACKED_COLUMNS = ["md5", "pack", "offset"]


def target_owners(rows: DataFrame, cfg: JobConfig, top_dir: str, done: DataFrame | None = None) -> DataFrame:
    """(dest_path, target_owner) of the paths that several URLs of the list lead to: one URL owns the path.

    That is the URL whose bytes `done` says are stored there, else the least one.
    """
    params = download_params(rows.select(*IMAGE_LIST_COLUMNS), cfg, top_dir).filter("dest_path IS NOT NULL")
    shared = params.groupBy("dest_path").agg(F.min("url").alias("least"), F.max("url").alias("most")).filter("least <> most")
    owner = F.col("least")
    if done is not None:
        held = done.filter("failure_code IS NULL").groupBy("dest_path").agg(F.min("url").alias("held"))
        shared, owner = shared.join(held, "dest_path", "left"), F.coalesce("held", "least")
    return shared.select("dest_path", owner.alias("target_owner"))


def target_taken() -> Column:
    return F.coalesce(F.col("target_owner") != F.col("url"), F.lit(False))


def plan_images(rows: DataFrame, cfg: JobConfig, top_dir: str, owners: DataFrame | None = None) -> DataFrame:
    """Image-list rows with URL, paths, expected size and digest, `need_fetch` and `need_resize`.

    `owners` are the `target_owners` of the whole list; by default those of `rows`.
    """
    owners = target_owners(rows, cfg, top_dir) if owners is None else owners
    extra = [c for c in ("row_key",) if c in rows.columns]
    params = download_params(rows.select(*IMAGE_LIST_COLUMNS, *extra), cfg, top_dir)
    target = resized_path(F.col("dest_path"), cfg.resized_images_subdirectory, cfg.resize_output_format)
    params = params.withColumn("resized_path", target).join(owners, "dest_path", "left")
    # The log of a packed store has sizes and digests: a join instead of a request for each row.
    listing = packs.entries(rows.sparkSession, packed_store(cfg)).select("path", "length", "md5") if cfg.packed else None
    planned = plan_fetch(params, listing, cfg.check_md5_if_exists, cfg.always_download)
    # A valid copy has the expected size.
    planned = planned.withColumn("stored_size", F.when(~F.col("need_fetch"), F.col("expected_size")))
    if not cfg.resize_images:
        return planned.withColumn("need_resize", F.lit(False))
    sized = stat_paths(planned, {"_resized": "resized_path"})
    return sized.select(*planned.columns, (F.coalesce("_resized", F.lit(0)) == 0).alias("need_resize"))


def packed_store(cfg: JobConfig) -> str:
    return f"{cfg.root}/packed"


def read_packed(df: DataFrame, store: str, path: str = "dest_path") -> DataFrame:
    """`read_stored` of a packed store."""
    held = packs.entries(df.sparkSession, store).select(F.col("path").alias("_path"), "pack", "offset", "length")
    got = packs.read_ranges(df.join(held, F.col(path) == F.col("_path"), "left").drop("_path"), store)
    cells = {"body": F.col("bytes"), "transport_error": F.col("error"), "attempts": F.lit(0), "size_limit_hit": F.lit(False)}
    return got.select(*df.columns, *[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESPONSE.fields])


def _log_packed(rows: DataFrame, store: str) -> None:
    """Make what the rows have packed known, unless it is: a run may have ended between the two."""
    spark, log = rows.sparkSession, qualify(rows.sparkSession, f"{store}/log")
    saved = rows.filter("pack IS NOT NULL").select(
        F.col("dest_path").alias("path"), F.col("bytes_written").alias("length"), "md5", "pack", "offset"
    )
    logged = changes.entries(spark, log, -1, changes.latest_version(spark, log)).select("pack", "offset")
    missing = saved.join(logged, ["pack", "offset"], "left_anti")
    if not missing.isEmpty():
        changes.append(missing, log)


def _no_response(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RESPONSE.fields])


def read_stored(df: DataFrame, path: str = "dest_path") -> DataFrame:
    """The stored bytes as `body`, as if they had just arrived; a read error becomes `transport_error`."""
    schema = T.StructType(df.schema.fields + RESPONSE.fields)

    def read(item: str) -> tuple:
        try:
            filesystem, name = resolve(item)
            with filesystem.open_input_stream(name, compression=None) as stream:
                return None, None, None, None, stream.read(), None, 0, False
        except OSError as exc:
            return None, None, None, None, None, str(exc), 0, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from payload_batches(batch, RESPONSE_KINDS, (read(p) for p in column_values(batch, path)))

    return df.mapInArrow(run, schema)


def acquire(planned: DataFrame, cfg: JobConfig, fetcher: Fetcher) -> DataFrame:
    """Bytes and verdict of every row: fetched, read from the store, or refused before any request."""
    small = cfg.download_300k

    def keep_body(response: Response) -> bool:
        """Bodies of images, and of failures whose text goes into the message; the rest is refused on its headers."""
        if response.status != 200:
            return not 300 <= (response.status or 0) < 400
        return (response.content_type or "").strip().lower() == "image/jpeg" and response.content_length is not None

    def fetched(df: DataFrame) -> DataFrame:
        got = fetch(
            df,
            "url",
            fetcher,
            cfg.max_retries,
            cfg.max_host_connections,
            cfg.max_total_connections,
            # Failure pages may be longer than the image; they are read up to their own cap.
            F.greatest(size_limit(small), F.lit(FAILURE_BODY_LIMIT).cast("bigint")),
            keep_body=keep_body,
            threads=cfg.connections_per_task,
            expected=F.col("expected_size") if cfg.schedule_by_size else None,
        )
        oversize = F.when(F.coalesce("size_limit_hit", F.lit(False)) & (F.col("status") == 200), "ImageUnknown")
        code = F.coalesce(header_failure(small), oversize, body_failure(small))
        coded = got.withColumn("failure_code", code)
        return coded.withColumn("failure_details", failure_message(small))

    def stored(df: DataFrame) -> DataFrame:
        got = read_packed(df, packed_store(cfg)) if cfg.packed else read_stored(df)
        code = F.when(F.col("transport_error").isNotNull(), "ImageIO")
        return got.withColumn("failure_code", code).withColumn("failure_details", F.col("transport_error"))

    def unread(df: DataFrame) -> DataFrame:
        return _no_response(df).select("*", *[F.lit(None).cast("string").alias(c) for c in ("failure_code", "failure_details")])

    def refused(df: DataFrame) -> DataFrame:
        coded = _no_response(df).withColumn("failure_code", F.coalesce(input_failure(small), F.when(target_taken(), "TargetTaken")))
        taken = F.when(F.col("failure_code") == "TargetTaken", F.concat(F.lit("stored under this path: "), "target_owner"))
        return coded.withColumn("failure_details", F.coalesce(taken, failure_message(small)))

    def usable(df: DataFrame) -> DataFrame:
        arrived = if_then_else(df, F.col("need_fetch"), fetched, stored)
        return verify_digest(arrived, F.md5("body"), small)

    def accepted(df: DataFrame) -> DataFrame:
        # The plan has checked a valid stored copy already: it is opened again only to be resized.
        return if_then_else(df, F.col("need_fetch") | F.col("need_resize"), usable, unread)

    return if_then_else(planned, input_failure(small).isNotNull() | target_taken(), refused, accepted)


def store_and_resize(
    rows: DataFrame, cfg: JobConfig, resizer: Callable[[bytes], bytes] | None = None
) -> DataFrame:
    """Save and resize the verified rows; a failing save or resize is the failure of its row.

    One narrow chain over the row that holds the payload: nothing is shuffled, and only verified
    bytes reach the store.
    """
    ok = F.col("failure_code").isNull()
    # bytes_written of an unsaved row is the size of the stored copy.
    out = rows
    save = ok & F.col("need_fetch") & F.lit(cfg.save_original_images)
    out = out.withColumn("_save_to", F.when(save, F.col("dest_path")))
    if cfg.packed:
        out = out.withColumn("md5", F.when(save, F.md5("body")))
        out = packs.pack_payloads(out, "_save_to", "body", packed_store(cfg), out.columns)
        out = out.withColumnsRenamed({"bytes_written": "_saved", "error": "_save_error"})
    else:
        out = write_files(out, "_save_to", "body", out.columns, "_saved", "_save_error")
    have = F.when(ok & ~F.col("need_fetch"), F.coalesce(F.octet_length("body").cast("long"), F.col("stored_size")))
    out = out.withColumn("bytes_written", F.coalesce("_saved", have, F.lit(0)))
    out = out.withColumn("_image", F.when(ok & F.col("need_resize"), F.col("body"))).drop("body", "_save_to")
    if cfg.resize_images:
        out = resize_payloads(
            out,
            "_image",
            cfg.resize_mode,
            cfg.resize_box_size,
            cfg.resize_output_format,
            cfg.resize_compression_quality,
            resizer,
        )
        out = write_files(out, "resized_path", "resized", [c for c in out.columns if c != "_image"], "_resized", "_write_error")
        late = F.coalesce("resize_error", "_write_error")
    else:
        late = F.lit(None).cast("string")
    unknown = ok & F.coalesce("_save_error", late).isNotNull()
    code = F.when(ok & F.col("_save_error").isNotNull(), "ImageIO").when(unknown, "ImageUnknown")
    final = out.withColumn("_late_code", code).withColumn("_late", F.coalesce("_save_error", late))
    return final.withColumn("failure_details", F.coalesce("failure_details", F.when(ok, F.col("_late")))).withColumn(
        "failure_code", F.coalesce("failure_code", "_late_code")
    ).select(*RESULT_COLUMNS, *[c for c in ("row_key",) if c in rows.columns], *(PACKED_COLUMNS if cfg.packed else []))


def _finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """Result rows of the parts that were written to their end."""
    filesystem, name = resolve(folder)
    if filesystem.get_file_info(name).type != fs.FileType.Directory:
        return None
    parts = sorted(i.base_name for i in filesystem.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.Directory)
    done = [p for p in (f"{folder}/{n}" for n in parts) if file_size(f"{p}/_SUCCESS") is not None]
    return spark.read.parquet(*done) if done else None


def _claim(folder: str, job: dict) -> None:
    """Write the record of a job, or raise if the folder belongs to another one."""
    place, text = f"{folder}/job.json", json.dumps(job, sort_keys=True)
    if file_size(place) is None:
        write_atomic(place, [text.encode()])
        return
    filesystem, name = resolve(place)
    with filesystem.open_input_stream(name) as stream:
        if stream.read().decode() != text:
            raise ValueError(f"{folder} holds results of another configuration")


def ingest_images(
    rows: DataFrame,
    cfg: JobConfig,
    top_dir: str,
    fetcher: Fetcher,
    resizer: Callable[[bytes], bytes] | None = None,
    results: str | None = None,
    waves: int = 1,
) -> DataFrame:
    """Run the image job; returns the stored result rows and writes the CSV tables beside them.

    With several `waves` the rows are worked off in that many parts. A run that is given the `results` folder of an
    earlier one works off what is missing there, whatever its number of waves: the rows of this list without a
    result row, by all their fields. A longer list is thus continued. Another configuration, a list that lacks rows
    of the stored results, or one that repeats a row more often than they do, is an error. Without `results` every
    run has a folder of its own and looks at every stored file again.
    """
    spark = rows.sparkSession
    target = results or f"{cfg.root}/results/{top_dir}/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    target = qualify(spark, target).rstrip("/")
    # Results of jobs from before there were packs can be continued.
    _claim(target, {"config": hashlib.sha256(repr((cfg, top_dir)).replace(", packed=False", "").encode()).hexdigest()})
    # Equal rows share a key, so they are in one wave.
    key = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in IMAGE_LIST_COLUMNS])), 256)
    keyed = spool(rows.select(*IMAGE_LIST_COLUMNS, key.alias("row_key")), scratch_dir(spark, "list"))
    done = _finished(spark, f"{target}/rows")
    pending = keyed
    if done is not None:
        counts = [d.groupBy("row_key").agg(F.count(F.lit(1)).alias(n)) for d, n in ((keyed, "listed"), (done, "stored"))]
        # Rows without a result are fine; any other difference is not.
        odd = counts[0].join(counts[1], "row_key", "right").filter(F.coalesce("listed", F.lit(0)) != F.col("stored"))
        if not odd.isEmpty():
            raise ValueError(f"{target} holds results of rows that this list lacks or counts otherwise")
        pending = keyed.join(done.select("row_key").distinct(), "row_key", "left_anti")
        if cfg.packed:
            _log_packed(done, packed_store(cfg))
    owners = spool(target_owners(keyed, cfg, top_dir, done), scratch_dir(spark, "owners"))
    # Lists come in few files: spread the rows, however they repeat, before any per-row file access.
    spread = pending.repartition(shuffle_partitions(spark))
    for wave in range(waves):
        mine = F.pmod(F.xxhash64("row_key"), F.lit(waves)) == wave
        part = spread.filter(mine) if waves > 1 else spread
        # Four branches read the plan: store it once, it is narrow.
        planned = spool(plan_images(part, cfg, top_dir, owners), scratch_dir(spark, "plan"))
        if planned.isEmpty():
            continue
        # The wide chain runs once; everything later reads the narrow table it leaves.
        made = spool(store_and_resize(acquire(planned, cfg, fetcher), cfg, resizer), f"{target}/rows/part={uuid.uuid4().hex}")
        if cfg.packed:
            _log_packed(made, packed_store(cfg))
    stored = _finished(spark, f"{target}/rows")
    if stored is None:
        planned = plan_images(keyed, cfg, top_dir, owners)
        stored = spool(store_and_resize(acquire(planned, cfg, fetcher), cfg, resizer), f"{target}/rows/part=none")
    stored = stored.drop("row_key", "part", *PACKED_COLUMNS)
    write_results(stored, f"{target}/csv", SUBSETS, stored=True)
    return stored


def report(results: DataFrame) -> DataFrame:
    """Rows per subset and outcome."""
    return results.groupBy("Subset", outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))
