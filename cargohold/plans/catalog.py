"""Registered queries: every operator over the given tables, whole."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.config import JobConfig
from cargohold.fixtures import (
    document_files,
    gray_images,
    gzip_column,
    image_responses,
    pack_gzips,
    pack_lists,
    pack_tars,
    table,
)
from cargohold.functions import digest as D
from cargohold.functions import paths as P
from cargohold.functions import text as X
from cargohold.operators import aggregate as A
from cargohold.operators import audit, changes, classify, digests, images, pipe, route
from cargohold.operators import sequence as Q
from cargohold.operators.skew import SkewPolicy
from cargohold.plans.assets import ingest_images, report
from cargohold.plans.assets import packed_store as packed_store_of
from cargohold.plans.metadata import image_list_from_archive
from cargohold.schemas import FAILURE_COLUMNS, FAILURE_DETAILS, IMAGE_LIST_COLUMNS, SUBSETS
from cargohold.session import scratch_dir, shuffle_partitions
from cargohold.sinks import packs
from cargohold.sinks.files import cached_stage, extract_tar, spool, write_files
from cargohold.sinks.results import CSV_WRITE_OPTIONS, failure_rows, repair_headers, result_line, success_rows, write_results
from cargohold.sources import tar as TAR
from cargohold.sources.fetch import FileFetcher, Response, TransportError, fetch, fetch_table
from cargohold.sources.files import gunzip
from cargohold.sources.gzip_members import member_index, read_members
from cargohold.sources.image_list import header_ok, read_image_list
from cargohold.sources.ledger import answers, fetch_due
from cargohold.sources.tar_source import read_archives, stream_archives
from cargohold.streaming.ops import stream_results, unique_consecutive_stream

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = JobConfig(root="/store")
TOP_DIR = "assets"
ASSET_HOST = "https://assets.example.com/"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- rows, paths and outcomes -------------------------------------------------------------------


def _params(spark: SparkSession, sf_dir: str, cfg: JobConfig = CONFIG) -> DataFrame:
    return P.download_params(image_responses(spark, sf_dir), cfg, TOP_DIR)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.verify_digest(classify.classify_response(_params(spark, sf_dir)), F.md5("body"))


@query
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_classified(spark, sf_dir))


@query
def dest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _params(spark, sf_dir)
    name = P.url_filename(F.col("url"))
    return rows.select("ImageID", "url", name.alias("file_name"), P.shard(name).alias("shard"), "dest_path")


@query
def resized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = P.resized_path(F.col("dest_path"), CONFIG.resized_images_subdirectory, "png")
    return _params(spark, sf_dir).select("ImageID", target.alias("resized_path"))


@query
def choose_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir, JobConfig(root="/store", download_300k=True)).select("ImageID", "url", "dest_path")


@query
def classify_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("ImageID", "failure_code", "failure_details")


@query
def classify_small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails are made on the fly: neither their size nor their digest is checked."""
    rows = _params(spark, sf_dir, JobConfig(root="/store", download_300k=True))
    out = classify.verify_digest(classify.classify_response(rows, small=True), F.md5("body"), small=True)
    return report(out)


@query
def success_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return success_rows(_classified(spark, sf_dir))


@query
def failure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_rows(_classified(spark, sf_dir))


@query
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed text form of both result tables."""
    rows = _classified(spark, sf_dir).withColumn(FAILURE_DETAILS, F.coalesce("failure_details", F.lit("")))
    good, bad = result_line(IMAGE_LIST_COLUMNS), result_line(FAILURE_COLUMNS)
    return rows.select("ImageID", F.when(F.col("failure_code").isNull(), good).otherwise(bad).alias("line"))


@query
def replayed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a table of recorded responses, as many rows as there are requests."""
    rows = image_responses(spark, sf_dir)
    recorded = [c for c in rows.columns if c not in IMAGE_LIST_COLUMNS]
    keyed = rows.select(F.concat_ws("#", "OriginalURL", "ImageID").alias("url"), *recorded)
    asked = rows.select("ImageID", F.concat_ws("#", "OriginalURL", "ImageID").alias("url"))
    known = keyed.filter(F.col("status").isNull() | (F.col("status") != 204))
    got = fetch_table(asked, known).withColumn("expected_size", F.col("content_length"))
    return got.select("ImageID", "status", "transport_error", classify.header_failure().alias("failure_code"))


@query
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers point at the 'photo unavailable' picture, with every page as the location."""
    path = F.when(F.octet_length("body") % 3 == 0, "/photo_unavailable.png").when(
        F.octet_length("body") % 3 == 1, "/images/photo_unavailable_l.png"
    )
    located = image_responses(spark, sf_dir).withColumn("location", F.concat(F.lit("https://s.example.com"), path, F.lit("?q")))
    return located.select("ImageID", classify.is_unavailable_redirect().alias("unavailable"))


# --- counts and totals --------------------------------------------------------------------------


@query
def count_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_by_subset(table(spark, sf_dir, "documents"), "lang")


@query
def host_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.host_count(table(spark, sf_dir, "pages"))


@query
def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bytes_written(table(spark, sf_dir, "documents"), ["lang", "source"], "text")


@query
def entry_size_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose bytes differ from the declared size, their number of characters."""
    turns = table(spark, sf_dir, "conversations")
    declared = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("entry_size"))
    chunks = turns.join(declared, "conv_id")
    return A.entry_size_errors(chunks, ["conv_id"], "entry_size", "text")


@query
def parent_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select(X.parent_dir(F.col("name")).alias("dir")).distinct()


@query
def parent_dirs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories as an archive scan meets them: one row per run of entries, over one global order."""
    named = document_files(spark, sf_dir).select("doc_id", X.parent_dir(F.col("name")).alias("dir"))
    return Q.unique_consecutive(named, ["dir"], ["doc_id"])


# --- digests ------------------------------------------------------------------------------------


def _payload_digest(algorithm: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", D.digest(F.col("text"), algorithm).alias("digest"))

    return run


for _algorithm in D.ALGORITHMS:
    _QUERIES[f"payload_{_algorithm.lower().replace('-', '')}"] = _payload_digest(_algorithm)


@query
def digest_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest through Base64, hex and back."""
    coded = table(spark, sf_dir, "documents").select("doc_id", F.base64(F.unhex(F.md5("text"))).alias("b64"))
    hexed = coded.withColumn("digest", X.md5_b64_to_hex(F.col("b64")))
    return hexed.withColumn("again", X.hexify(X.dehexify(F.col("digest"))))


@query
def digest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.digest_chunks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query
def digest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of 512 bytes, digested by source and document."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("bytes"))
    return digests.digest_chunks(Q.chunk_binary(docs, "bytes", 512), ["source", "doc_id"], ["chunk_id"], "bytes", "SHA-256")


# --- audit of a store ---------------------------------------------------------------------------


def _expected_md5() -> Column:
    return F.md5(F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))


@query
def plan_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are wanted, the labelled ones are stored."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    wanted = docs.select(
        "doc_id", path.alias("dest_path"), F.col("n_chars").alias("expected_size"), _expected_md5().alias("expected_md5")
    )
    held = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    # The digest is taken where the payload is scanned; only names, sizes and digests are joined.
    stored = held.select(
        path.alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.md5("text").alias("md5")
    )
    return audit.plan_fetch(wanted, stored).select("doc_id", "dest_path", "need_fetch", "reason")


@query
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan against the first of three versions of a store, brought up to date from the other two."""
    log = scratch_dir(spark, "log")
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    wanted = docs.select("doc_id", F.col("path").alias("dest_path"), F.col("n_chars").alias("expected_size"), _expected_md5().alias("expected_md5"))
    held = docs.select("doc_id", "path", F.octet_length("text").cast("bigint").alias("length"), F.md5("text").alias("md5"))
    first = changes.append(held.filter("doc_id % 3 <> 0"), log)
    plan = spool(audit.plan_fetch(wanted, changes.state(spark, log)), scratch_dir(spark, "plan"))
    changes.append(held.filter("doc_id % 3 = 0 AND doc_id % 2 = 0"), log)
    changes.fold(spark, log)
    cut = held.withColumn("length", F.when(F.col("doc_id") % 7 == 1, F.col("length") - 1).otherwise(F.col("length")))
    changes.append(cut.filter("doc_id % 7 < 2").withColumn("deleted", F.col("doc_id") % 7 == 0), log)
    return changes.replan(wanted, plan, log, first).select("doc_id", "dest_path", "need_fetch", "reason")


@query
def verify_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    expected = docs.select("name", F.col("n_chars").alias("size"), _expected_md5().alias("md5_hex"))
    stored = docs.filter("lang <> 'fr'").select(
        F.col("name").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.md5("text").alias("md5")
    )
    return audit.verify_artifacts(expected, stored)


@query
def resize_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/r/"), "doc_id").alias("resized_path"))
    stored = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("/r/"), "doc_id").alias("path"), F.col("quality").alias("length")
    )
    return audit.resize_needed(rows, stored)


@query
def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return audit.not_done(rows, table(spark, sf_dir, "labels"), ["doc_id"])


@query
def join_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document, save result of the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    saved = labels.select("doc_id", "quality", F.when(F.col("toxic") == 1, "refused").alias("error"))
    digested = docs.select("doc_id", F.md5("text").alias("digest"), F.when(F.col("lang") == "de", "unread").alias("error"))
    return audit.join_results(saved, digested, ["doc_id"])


@query
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.quarantine(_classified(spark, sf_dir))


# --- ordered sequences --------------------------------------------------------------------------


@query
def unique_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return Q.unique_consecutive(events, ["event_type"], ["ts", "event_id"], ["user_id"])


def _cells(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, "window_start", *[F.get("window", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query
def sliding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Q.sliding(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"])
    return _cells(pairs, ["user_id"], ["a", "b"])


@query
def sliding_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = Q.sliding(table(spark, sf_dir, "events"), "event_id", ["ts", "event_id"], ["user_id"], 3, 2)
    return _cells(triples, ["user_id"], ["a", "b", "c"])


def _piece(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    size = F.octet_length(col).cast("bigint").alias("n_bytes")
    return df.select(*keys, F.col("chunk_id").cast("bigint").alias("chunk_id"), size, F.md5(col).alias("piece_md5"))


@query
def rechunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece(Q.chunk_binary(document_files(spark, sf_dir), "bytes", 512), ["doc_id"], "bytes")


@query
def rechunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("bytes", F.col("text").cast("binary"))
    return _piece(Q.rechunk(turns, ["conv_id"], ["turn"], "bytes", 64), ["conv_id"], "bytes")


@query
def rechunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows: the documents of a source as one byte sequence, in pieces of the default size."""
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.col("text").cast("binary"))
    return _piece(Q.rechunk(docs, ["source"], ["doc_id"], "bytes"), ["source"], "bytes")


@query
def split_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return Q.split_when(turns, F.col("role") == "user", ["turn"], ["conv_id"])


@query
def split_group_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of every group with the size of the group."""
    turns = table(spark, sf_dir, "conversations")
    grouped = Q.split_when(turns, F.col("role") == "user", ["turn"], ["conv_id"])
    head = F.max(F.when(F.col("is_first"), F.col("text"))).alias("head")
    return grouped.groupBy("conv_id", "group_id").agg(head, F.count(F.lit(1)).alias("n_rows"))


@query
def capped_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("bytes", F.col("text").cast("binary"))
    out = Q.capped_concat(turns, ["conv_id"], ["turn"], "bytes", 2000)
    return out.select("conv_id", F.md5("bytes").alias("digest"), "n_bytes")


@query
def head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.head_per_group(table(spark, sf_dir, "conversations"), ["turn"], ["conv_id"], 2)


def _upper_copy(turns: DataFrame) -> DataFrame:
    return turns.withColumn("text", F.concat(F.lit("copy: "), "text"))


@query
def switch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return Q.switch_source(turns, _upper_copy(turns), "turn", 2)


@query
def switch_source_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with an answer switches at its first answer, others not at all."""
    turns = table(spark, sf_dir, "conversations")
    at = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("at"))
    return Q.switch_source(turns, _upper_copy(turns), "turn", at, ["conv_id"])


@query
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("digest"))
    return Q.ordered_concat(docs, items)


# --- the same operators with their largest groups cut into slices --------------------------------

# No input counts as small and few rows fit a group, so the slices are used at any scale.
SLICED = SkewPolicy(max_rows=200)


@query
def sliced_unique_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows: runs of one user among the events of a type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return Q.unique_consecutive(events, ["user_id"], ["ts", "event_id"], ["event_type"], SLICED)


@query
def sliced_sliding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _cells(Q.sliding(events, "user_id", ["ts", "event_id"], ["event_type"], policy=SLICED), ["event_type"], ["a", "b"])


@query
def sliced_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.col("text").cast("binary"))
    return _piece(Q.rechunk(docs, ["lang"], ["doc_id"], "bytes", policy=SLICED), ["lang"], "bytes")


@query
def sliced_split_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return Q.split_when(events, F.col("value") > 20, ["ts", "event_id"], ["event_type"], SLICED)


@query
def sliced_capped_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.col("text").cast("binary"))
    out = Q.capped_concat(docs, ["lang"], ["doc_id"], "bytes", policy=SLICED)
    return out.select("lang", F.md5("bytes").alias("digest"), "n_bytes")


@query
def sliced_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of 16 bytes; those with many chunks are sorted in slices."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return digests.digest_chunks(Q.chunk_binary(docs, "bytes", 16), ["doc_id"], ["chunk_id"], "bytes", policy=SkewPolicy(max_rows=1000))


@query
def sliced_global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order over everything, no key at all."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return Q.unique_consecutive(events, ["event_type"], ["ts", "event_id"], policy=SLICED)


# --- routing ------------------------------------------------------------------------------------


@query
def if_then_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return route.if_then_else(
        docs,
        F.when(F.col("lang") != "de", F.col("n_chars") > 1000),
        lambda df: df.select("doc_id", F.lit("long").alias("branch"), F.md5("text").alias("value")),
        lambda df: df.select("doc_id", F.lit("short").alias("branch"), F.col("source").alias("value")),
    )


@query
def tee_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One computed result, two written tables, read back together."""
    folder = scratch_dir(spark, "tee")
    rows = _classified(spark, sf_dir).select("ImageID", "Subset", "failure_code")

    def writer(condition: str, name: str) -> Callable[[DataFrame], None]:
        return lambda df: df.filter(condition).select("ImageID", "Subset").write.parquet(f"{folder}/{name}")

    route.tee(rows, [writer("failure_code IS NULL", "good"), writer("failure_code IS NOT NULL", "bad")])
    parts = [spark.read.parquet(f"{folder}/{name}").withColumn("output", F.lit(name)) for name in ("good", "bad")]
    return parts[0].unionByName(parts[1])


# --- files, archives and lists ------------------------------------------------------------------


@query
def csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.csv_quote(F.col("text")).alias("quoted"))


def _document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image-list rows: free text in a CSV field, in both result tables."""
    docs = table(spark, sf_dir, "documents")
    values = {
        "ImageID": F.col("doc_id").cast("string"),
        "Subset": F.element_at(F.array(*[F.lit(s) for s in SUBSETS]), (F.col("doc_id") % 3 + 1).cast("int")),
        "Author": F.col("source"),
        "Title": F.col("text"),
    }
    rows = docs.select(*[values.get(c, F.lit("")).alias(c) for c in IMAGE_LIST_COLUMNS], "lang")
    failed = F.when(F.col("lang") == "en", "RequestFailed")
    return rows.withColumn("failure_code", failed).withColumn("failure_details", F.when(failed.isNotNull(), F.col("Title")))


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "csv")
    write_results(_document_rows(spark, sf_dir), folder, SUBSETS)
    parts = [
        read_image_list(spark, f"{folder}/outcome={name}").withColumn("outcome", F.lit(name))
        for name in ("success", "failure")
    ]
    return parts[0].unionByName(parts[1]).select("ImageID", "Subset", "Author", "Title", "outcome")


@query
def csv_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists, with the lines of every larger file cut into slices."""
    folder = scratch_dir(spark, "csv")
    write_results(_document_rows(spark, sf_dir).withColumn("failure_code", F.lit(None)), folder, SUBSETS)
    rows = read_image_list(spark, f"{folder}/outcome=success", policy=SkewPolicy(max_rows=50))
    return rows.select("ImageID", "Subset", "Author", "Title")


@query
def header_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every success file starts with the header line, no failure file with that of the success table."""
    folder = scratch_dir(spark, "headers")
    write_results(_document_rows(spark, sf_dir), folder, SUBSETS)
    checked = header_ok(spark, folder, IMAGE_LIST_COLUMNS)
    outcome = F.regexp_extract("path", "outcome=([a-z]+)", 1).alias("outcome")
    return checked.groupBy(outcome).agg(F.bool_and("header_ok").alias("all_ok"), F.bool_or("header_ok").alias("any_ok"))


@query
def repaired_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by source, of which some lack their header and some have another one, repaired and read."""
    folder = scratch_dir(spark, "heads")
    rows = _document_rows(spark, sf_dir).select(*IMAGE_LIST_COLUMNS, F.col("Author").alias("part"))
    wrong = rows.withColumnRenamed("OriginalMD5", "Checksum")
    for kind, part, header in (("sound", rows, "true"), ("bare", rows, "false"), ("wrong", wrong, "true")):
        nth = F.pmod(F.xxhash64("part"), F.lit(3)) == ("sound", "bare", "wrong").index(kind)
        part.filter(nth).write.options(**{**CSV_WRITE_OPTIONS, "header": header}).partitionBy("part").csv(f"{folder}/{kind}")
    done = spool(repair_headers(spark, folder, IMAGE_LIST_COLUMNS), scratch_dir(spark, "heads-log"))
    A.assert_no_failures(done)
    return read_image_list(spark, folder).select("ImageID", "Subset", "Author", "Title")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "tar")
    # Written once, before the archive scan plans its tasks.
    pack_tars(document_files(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return TAR.tar_index(spark, folder)


def _entry_id(col: str = "entry_name") -> Column:
    return F.regexp_extract(col, "([0-9]+)\\.txt$", 1).cast("bigint").alias("doc_id")


@query
def tar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = TAR.tar_entries(TAR.keep_files(_packed(spark, sf_dir)))
    return entries.select(_entry_id(), "entry_name", "entry_size", F.md5("bytes").alias("digest"))


@query
def tar_source_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives as a data source in windows of 128 KiB; the filter is decided on the headers."""
    folder = scratch_dir(spark, "tar")
    pack_tars(document_files(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    entries = read_archives(spark, folder, 128 * 1024).filter("entry_name LIKE 'en/%' AND entry_size BETWEEN 500 AND 3000")
    return entries.select(_entry_id(), "entry_name", "entry_size", F.md5("bytes").alias("digest"))


@query
def stream_tar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives arrive in two lots and the stream is resumed after each."""
    folder = scratch_dir(spark, "tar-stream")
    files = document_files(spark, sf_dir)
    for lot in range(2):
        part = files.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == lot).repartition(4, "doc_id")
        pack_tars(part, f"{folder}/in/lot-{lot}").write.format("noop").mode("overwrite").save()
        entries = stream_archives(spark, f"{folder}/in", per_trigger=3)
        found = entries.select(_entry_id(), "entry_name", "entry_size", F.md5("bytes").alias("digest"))
        sink = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query
def tar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = TAR.tar_chunks(_packed(spark, sf_dir))
    size = F.octet_length("bytes").cast("bigint").alias("n_bytes")
    return chunks.select(_entry_id(), "chunk_pos", size, F.md5("bytes").alias("piece_md5"), "first", "last")


@query
def tar_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive to files; the files are then read and digested."""
    folder = scratch_dir(spark, "extract")
    written = spool(extract_tar(_packed(spark, sf_dir), folder), scratch_dir(spark, "extract-log"))
    A.assert_no_failures(written)
    checked = audit.digest_paths(written, "path", F.lit(True), out="digest")
    return checked.select(_entry_id(), "bytes_written", "digest")


@query
def packed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in packs: stored, partly replaced and deleted, compacted, vacuumed and read back by range."""
    folder = scratch_dir(spark, "packs")
    files = document_files(spark, sf_dir).select("doc_id", "name", "bytes")
    packs.put(files, "name", "bytes", folder)
    later = F.when(F.col("doc_id") % 5 != 0, F.concat("bytes", F.lit(b"!")))
    packs.put(files.filter("doc_id % 5 = 0 OR doc_id % 2 = 0").withColumn("bytes", later), "name", "bytes", folder)
    packs.compact(spark, folder, least=0.9)
    packs.vacuum(spark, folder)
    found = packs.get(spark, folder)
    return found.select(_entry_id("path"), "path", "length", F.md5("bytes").alias("digest"), "error")


@query
def gunzip_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = gzip_column(document_files(spark, sf_dir).select("doc_id", "bytes"), "bytes")
    return gunzip(packed, "bytes").select("doc_id", F.md5("bytes").alias("digest"), "error")


@query
def gunzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a gzip member for each document, found in windows of 64 KiB and inflated in parallel."""
    folder = scratch_dir(spark, "members")
    packed = spool(pack_gzips(document_files(spark, sf_dir).repartition(4, "doc_id"), folder), scratch_dir(spark, "members-log"))
    index = spool(member_index(packed.select("path").distinct(), window=64 * 1024), scratch_dir(spark, "members-index"))
    pieces = read_members(index)
    digested = digests.digest_chunks(pieces, ["path", "member"], ["pos"], "bytes")
    # A member without bytes has no piece. The index is far smaller as a file than its rows are on the driver.
    held = index.join(digested.drop("n_bytes").hint("merge"), ["path", "member"], "left")
    digest = F.coalesce("digest", F.md5(F.lit(b"")))
    return packed.join(held, ["path", "start"], "left").select("doc_id", "n_bytes", digest.alias("digest"), "error")


@query
def cached_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that is built once and then read."""
    path = scratch_dir(spark, "stage")

    def build() -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))

    cached_stage(spark, path, build)
    return cached_stage(spark, path, build)


@query
def image_lists_from_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are fetched, unpacked, audited and read as lists, then counted by subset."""
    store = scratch_dir(spark, "archive-host")
    lists = image_responses(spark, sf_dir).select(*IMAGE_LIST_COLUMNS)
    manifest_rows = spool(pack_lists(lists, store), scratch_dir(spark, "archive-manifest"))
    cfg = JobConfig(root=scratch_dir(spark, "archive-root"), max_total_connections=16)
    fetcher = FileFetcher("https://archive.example.com/", store, "application/gzip")
    return image_list_from_archive(spark, cfg, fetcher, manifest_rows).select(*IMAGE_LIST_COLUMNS)


# --- fetch and whole jobs -----------------------------------------------------------------------


def _hosted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FileFetcher]:
    """Pages served by one host from a folder; every seventh page is gone."""
    folder = scratch_dir(spark, "host")
    name = F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".jpg"))
    pages = table(spark, sf_dir, "pages").withColumn("name", name)
    kept = pages.filter("page_id % 7 <> 3").select(
        F.concat(F.lit(f"{folder}/"), "name").alias("path"), F.col("html").cast("binary").alias("bytes")
    )
    A.assert_no_failures(spool(write_files(kept, "path", "bytes"), scratch_dir(spark, "host-log")))
    rows = image_responses(spark, sf_dir).select(*IMAGE_LIST_COLUMNS)
    page = F.col("ImageID").cast("bigint")
    return (
        rows.withColumn("OriginalURL", F.concat(F.lit(ASSET_HOST), F.substring("ImageID", 11, 6), F.lit(".jpg"))).withColumn(
            "OriginalSize",
            F.when(page % 11 == 0, F.concat("OriginalSize", F.lit("0"))).otherwise(F.col("OriginalSize")),
        ),
        FileFetcher(ASSET_HOST, folder),
    )


@query
def fetch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fetcher = _hosted(spark, sf_dir)
    got = fetch(rows.select("ImageID", F.col("OriginalURL").alias("url")), "url", fetcher, total=8)
    return got.select("ImageID", "status", "content_length", F.md5("body").alias("digest"), "attempts")


@query
def fetch_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests dealt out by the bytes that the list names."""
    rows, fetcher = _hosted(spark, sf_dir)
    wanted = rows.select("ImageID", F.col("OriginalURL").alias("url"), F.col("OriginalSize").cast("bigint").alias("size"))
    got = fetch(wanted, "url", fetcher, total=8, expected=F.col("size"))
    return got.select("ImageID", "status", "content_length", F.md5("body").alias("digest"), "attempts")


@dataclass(frozen=True)
class _FailsAtFirst:
    """Answers each URL with itself, but from pass `turn` on only where the URL's digest says so."""

    turn: int

    def __call__(self, url: str) -> Response:
        if int(hashlib.md5(url.encode()).hexdigest()[:2], 16) % 4 >= self.turn:
            raise TransportError("connection reset")
        return Response(200, "text/plain", len(url.encode()), None, io.BytesIO(url.encode()))


@query
def fetch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the page addresses, a minute and two minutes apart; in between one that finds nothing due."""
    folder, start = scratch_dir(spark, "ledger"), datetime(2024, 1, 1)
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    for turn, seconds in ((1, 0), (2, 30), (2, 60), (3, 180)):
        fetch_due(urls, "url", _FailsAtFirst(turn), folder, start + timedelta(seconds=seconds), max_attempts=3, total=8)
    got = answers(urls, "url", folder)
    return got.select("page_id", "status", "attempts", "transport_error", F.col("due").isNull().alias("closed"), F.md5("body").alias("digest"))


@query
def ingest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image job twice: the second run finds the stored copies of the first."""
    rows, fetcher = _hosted(spark, sf_dir)
    root = scratch_dir(spark, "assets")
    cfg = JobConfig(root=root, save_original_images=True, resize_images=False, max_total_connections=8)
    ingest_images(rows, cfg, TOP_DIR, fetcher, results=f"{root}/first")
    again = ingest_images(rows, cfg, TOP_DIR, fetcher, results=f"{root}/second")
    return again.select("ImageID", "Subset", "need_fetch", "reason", "bytes_written", "failure_code", "failure_details")


@query
def ingest_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image job twice over a packed store: the second run plans from the log, and what it holds is read back."""
    rows, fetcher = _hosted(spark, sf_dir)
    root = scratch_dir(spark, "assets")
    cfg = JobConfig(root=root, save_original_images=True, resize_images=False, max_total_connections=8, packed=True)
    ingest_images(rows, cfg, TOP_DIR, fetcher, results=f"{root}/first")
    again = ingest_images(rows, cfg, TOP_DIR, fetcher, results=f"{root}/second")
    held = packs.get(spark, packed_store_of(cfg)).select(F.col("path").alias("dest_path"), F.md5("bytes").alias("digest"))
    return again.join(held, "dest_path", "left").select("ImageID", "need_fetch", "reason", "bytes_written", "failure_code", "digest")


@query
def ingest_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image job over a third of its list, continued over the whole list in another number of waves."""
    rows, fetcher = _hosted(spark, sf_dir)
    root = scratch_dir(spark, "assets")
    cfg = JobConfig(root=root, save_original_images=True, resize_images=False, max_total_connections=8)
    part = rows.filter(F.col("ImageID").cast("bigint") % 3 == 0)
    ingest_images(part, cfg, TOP_DIR, fetcher, results=f"{root}/out", waves=3)
    done = ingest_images(rows, cfg, TOP_DIR, fetcher, results=f"{root}/out", waves=2)
    return done.select("ImageID", "Subset", "need_fetch", "reason", "bytes_written", "failure_code", "failure_details")


def _length_as_text(image: bytes) -> bytes:
    return str(len(image)).encode()


@query
def ingest_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image job with a plugged resizer: what it returns is stored beside the originals."""
    rows, fetcher = _hosted(spark, sf_dir)
    root = scratch_dir(spark, "assets")
    cfg = JobConfig(root=root, save_original_images=True, resize_output_format="txt", max_total_connections=8)
    out = ingest_images(rows, cfg, TOP_DIR, fetcher, _length_as_text, results=f"{root}/out")
    return audit.digest_paths(out, "resized_path", F.lit(True), out="resized_md5").select("ImageID", "failure_code", "resized_md5")


@query
def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail before or after their request: bad sizes, bad checksums, bodies over their size."""
    case = F.col("ImageID").cast("bigint") % 4
    rows = image_responses(spark, sf_dir).withColumns(
        {
            "OriginalURL": F.concat(F.lit(ASSET_HOST), F.substring("ImageID", 11, 6), F.lit(".jpg")),
            "body": F.when(case == 3, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")),
            "content_length": F.col("OriginalSize").cast("bigint"),
            "content_type": F.lit("image/jpeg"),
            "status": F.lit(200),
            "transport_error": F.lit(None).cast("string"),
        }
    )
    rows = rows.withColumn("OriginalSize", F.when(case == 1, "many").otherwise(F.col("OriginalSize")))
    rows = rows.withColumn("OriginalMD5", F.when(case == 2, "?").otherwise(F.base64(F.unhex(F.md5("body")))))
    out = classify.verify_digest(classify.classify_response(P.download_params(rows, CONFIG, TOP_DIR)), F.md5("body"))
    return out.select("ImageID", "failure_code", "failure_details")


@query
def gunzip_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth compressed value ends early."""
    packed = gzip_column(document_files(spark, sf_dir).select("doc_id", "bytes"), "bytes")
    short = F.expr("substring(bytes, 1, octet_length(bytes) - 5)")
    cut = packed.withColumn("bytes", F.when(F.col("doc_id") % 4 == 0, short).otherwise(F.col("bytes")))
    return gunzip(cut, "bytes").select("doc_id", F.md5("bytes").alias("digest"), F.col("error").isNotNull().alias("failed"))


# --- commands and images ------------------------------------------------------------------------


@query
def pipe_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through one run of a byte-wise command."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spread = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    out = pipe.pipe_through(spread, "text", "tr a-z A-Z")
    return out.select("doc_id", F.md5("out").alias("digest"), "exit_code", "stderr")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", (64 + F.col("page_id") * 37 % 1800).alias("w"), (64 + F.col("page_id") * 53 % 1300).alias("h")
    )


def _resize_plan(mode: str) -> Query:
    return lambda spark, sf_dir: images.resize_plan(_sized(spark, sf_dir), "w", "h", mode, 224)


_QUERIES["resize_plan_shrink"] = _resize_plan("ShrinkToFit")
_QUERIES["resize_plan_crop"] = _resize_plan("FillCrop")
_QUERIES["resize_plan_distort"] = _resize_plan("FillDistort")


def _resize(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_dir(spark, "images")
        page = F.col("page_id")
        sized = table(spark, sf_dir, "pages").select(
            F.concat(F.lit(f"{folder}/in/"), page, F.lit(".png")).alias("path"),
            (16 + page * 37 % 300).cast("int").alias("w"),
            (16 + page * 53 % 260).cast("int").alias("h"),
            (F.octet_length("html") % 256).cast("int").alias("v"),
        )
        spread = sized.repartition(spark.sparkContext.defaultParallelism, "path")
        log = scratch_dir(spark, "images-log")

        def stored(rows: DataFrame, name: str) -> DataFrame:
            """The pixels of each file that `rows` made, decoded in tasks whose number doesn't depend on that of the files."""
            made = spool(rows, f"{log}/{name}")
            A.assert_no_failures(made)
            n = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
            return images.decode_files(made.filter("bytes_written is not null").select("path").repartition(n, "path").distinct())

        resized = images.resize_images(stored(write_files(gray_images(spread), "path", "png"), "in"), mode, 64)
        resized = resized.withColumn("path", F.replace("path", F.lit("/in/"), F.lit("/out/")))
        found = stored(write_files(resized, "path", "resized"), "out")
        page_id = F.regexp_extract("path", "([0-9]+)\\.png$", 1).cast("bigint").alias("page_id")
        return found.select(page_id, "width", "height", F.md5("pixels").alias("pixel_md5"))

    return run


_QUERIES["resize_images_shrink"] = _resize("ShrinkToFit")
_QUERIES["resize_images_crop"] = _resize("FillCrop")
_QUERIES["resize_images_distort"] = _resize("FillDistort")


# --- streams ------------------------------------------------------------------------------------


@query
def stream_unique_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in three slices of time and the stream is resumed after each; equals the batch operator."""
    folder = scratch_dir(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / 3 for i in (1, 2)]
    slices = [F.col("ts") < cuts[0], F.col("ts").between(*cuts), ~F.coalesce(F.col("ts") <= cuts[1], F.lit(False))]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        for part in slices:
            events.filter(part).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            kept = unique_consecutive_stream(source, "event_type", ["ts", "event_id"], ["user_id"])
            sink = kept.writeStream.format("parquet").option("path", f"{folder}/out")
            sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(events.schema).parquet(f"{folder}/out")


@query
def stream_unique_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive out of order over four batches and wait for the watermark; a kind (text) and a level (number) are compared."""
    folder = scratch_dir(spark, "stream")
    level = F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") / 40).cast("double"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", level.alias("level"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    days = (last - first).days + 1
    # A row far ahead moves the watermark past all events.
    ahead = events.limit(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(last + timedelta(days=2 * days)).cast(events.schema["ts"].dataType).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("level"),
    )
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for batch in range(5):
            rows = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch) if batch < 4 else ahead
            rows.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            kept = unique_consecutive_stream(source, ["event_type", "level"], ["ts", "event_id"], ["user_id"], ("ts", f"{days} days"))
            sink = kept.writeStream.format("parquet").option("path", f"{folder}/out")
            sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(events.schema).parquet(f"{folder}/out").filter("user_id >= 0")


@query
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as a stream: routed, classified and written per micro-batch."""
    folder = scratch_dir(spark, "stream")
    rows = image_responses(spark, sf_dir)
    rows.repartition(3, "ImageID").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    params = P.download_params(source, CONFIG, TOP_DIR)
    out = classify.verify_digest(classify.classify_response(params), F.md5("body"))
    marked = route.if_then_else(
        out,
        F.col("failure_code").isNull(),
        lambda df: df.withColumn("License", F.concat(F.lit("kept: "), "License")),
        lambda df: df,
    )
    writer = stream_results(marked, f"{folder}/out", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    parts = [
        read_image_list(spark, f"{folder}/out/batch=*/outcome={name}").select(
            "ImageID", "Subset", "License", F.lit(name).alias("outcome")
        )
        for name in ("success", "failure")
    ]
    return parts[0].unionByName(parts[1])
