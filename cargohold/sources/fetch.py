"""Remote assets: one request per row, spread over tasks under per-host and total limits."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cargohold.functions.paths import url_host
from cargohold.schemas import RESPONSE
from cargohold.sources.schedule import schedule
from cargohold.storage import (
    append_columns,
    blocks,
    column_values,
    in_parallel,
    new_hash,
    payload_batches,
    resolve,
    with_columns,
    write_atomic,
)

RETRY_BASE_SECONDS = 0.1
RETRY_MAX_SECONDS = 30.0
RESPONSE_KINDS = {f.name: to_arrow_type(f.dataType) for f in RESPONSE.fields}


class TransportError(Exception):
    """The request got no response; worth another attempt."""


class SizeLimitExceeded(Exception):
    """The body is longer than allowed."""


@dataclass
class Response:
    """What a fetcher returns: headers and an open body."""

    status: int
    content_type: str | None = None
    content_length: int | None = None
    location: str | None = None
    stream: BinaryIO | None = None


Fetcher = Callable[[str], Response]


@dataclass(frozen=True)
class FileFetcher:
    """Serve `prefix...` URLs from a folder that all workers can read."""

    prefix: str
    folder: str
    content_type: str = "image/jpeg"

    def __call__(self, url: str) -> Response:
        if not url.startswith(self.prefix):
            return Response(404)
        filesystem, name = resolve(self.folder + "/" + url[len(self.prefix) :])
        info = filesystem.get_file_info(name)
        if not info.is_file:
            return Response(404)
        stream = filesystem.open_input_stream(name, compression=None)
        return Response(200, self.content_type, info.size, None, stream)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        return None


@dataclass(frozen=True)
class HttpFetcher:
    """GET with the standard library. Redirects are reported, not followed."""

    timeout: float = 60.0
    headers: dict[str, str] = field(default_factory=dict)

    def __call__(self, url: str) -> Response:
        opener = urllib.request.build_opener(_NoRedirect())
        request = urllib.request.Request(url, headers=self.headers)
        try:
            reply = opener.open(request, timeout=self.timeout)
        except urllib.error.HTTPError as exc:
            reply = exc
        except OSError as exc:
            raise TransportError(str(exc)) from exc
        length = reply.headers.get("Content-Length")
        kind = reply.headers.get("Content-Type")
        size = int(length) if length and length.isdigit() else None
        return Response(reply.status, kind, size, reply.headers.get("Location"), reply)


def with_retries(fetcher: Fetcher, url: str, retries: int, consume: Callable[[Response], Any]):
    """(result, error, attempts). Only transport errors are tried again; a GET can be repeated.

    Anything else that a fetcher raises, such as for a malformed URL, is final but stays with its row.
    """
    delay = RETRY_BASE_SECONDS
    for attempt in range(1, retries + 2):
        try:
            response = fetcher(url)
            try:
                return consume(response), None, attempt
            finally:
                if response.stream is not None:
                    with suppress(OSError):
                        response.stream.close()
        except (TransportError, OSError, http.client.HTTPException) as exc:
            error = f"{type(exc).__name__}: {exc}"
            if attempt <= retries:
                time.sleep(delay)
                delay = min(delay * 2, RETRY_MAX_SECONDS)
        except Exception as exc:  # noqa: BLE001 - a plugged function must not fail the job for one row
            return None, f"{type(exc).__name__}: {exc}", attempt
    return None, error, retries + 1


def spread_by_host(df: DataFrame, url: str, per_host: int, total: int, threads: int = 1) -> DataFrame:
    """At most `total` requests under way; those of one host in at most `per_host` places.

    A task works `threads` requests at a time, so the rows lie in `total / threads` partitions and those
    of a host in `per_host / threads` of them: both limits hold however the hosts are distributed. A
    host with many rows is split by a salt over its full allowance.
    """
    salt = F.pmod(F.xxhash64(url), F.lit(max(1, per_host // threads)))
    return df.repartition(max(1, total // threads), url_host(F.col(url)), salt)


def limited(data: Iterator[bytes], limit: int | None) -> Iterator[bytes]:
    seen = 0
    for block in data:
        seen += len(block)
        if limit is not None and seen > limit:
            raise SizeLimitExceeded(f"body is over the limit of {limit} bytes")
        yield block


def fetch(
    df: DataFrame,
    url: str,
    fetcher: Fetcher,
    retries: int = 15,
    per_host: int = 5,
    total: int = 128,
    max_bytes: Column | int | None = None,
    keep_body: Callable[[Response], bool] | None = None,
    threads: int = 1,
    expected: Column | None = None,
) -> DataFrame:
    """Add the response columns (schema `RESPONSE`). One bad row never fails the job.

    A body over `max_bytes` is dropped with `size_limit_hit`; `keep_body` decides on the headers
    whether the body is read at all. With `threads`, a task overlaps that many requests. With `expected` (bytes of each
    body) the partitions are even in bytes (`schedule`), otherwise rows are dealt by hash.
    """
    threads = min(threads, per_host)
    limit = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)
    dealt = spread_by_host(df, url, per_host, total, threads) if expected is None else schedule(df, url, expected, per_host, total, threads)
    prepared = dealt.withColumn("_limit", limit.cast("bigint"))
    schema = with_columns(df.schema, *RESPONSE.fields)
    kept = df.columns

    def read(response: Response, limit: int | None) -> tuple[Response, bytes | None, bool]:
        if response.stream is None or (keep_body and not keep_body(response)):
            return response, None, False
        try:
            return response, b"".join(limited(blocks(response.stream), limit)), False
        except SizeLimitExceeded:
            return response, None, True

    def one(target: str | None, limit: int | None) -> tuple:
        if target is None:
            return None, None, None, None, None, "no url", 0, False
        result, error, attempts = with_retries(fetcher, target, retries, lambda r: read(r, limit))
        if error:
            return None, None, None, None, None, error, attempts, False
        response, body, hit = result
        head = (response.status, response.content_type, response.content_length, response.location)
        return (*head, body, None, attempts, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(column_values(batch, url), column_values(batch, "_limit"))
            yield from payload_batches(batch.select(kept), RESPONSE_KINDS, in_parallel(one, pairs, threads))

    return prepared.mapInArrow(run, schema)


def fetch_table(df: DataFrame, responses: DataFrame, url: str = "url", order_by: str | None = None) -> DataFrame:
    """Responses from a table keyed by URL, for replays and tests; a missing URL is a transport error.

    Of several responses to one URL the one that is greatest in `order_by` (a time or attempt number) counts. Without
    it, a success comes before other answers and these before transport errors; among equals the one with the least
    hash counts. The choice is made on narrow columns, so bodies of other answers are not shuffled twice.
    """
    fields = [c for c in responses.columns if c not in (url, order_by)]
    mark = F.xxhash64(*[F.col(c) for c in fields])
    answered = F.when(F.col("status") == 200, 2).when(F.col("status").isNotNull(), 1).otherwise(0)
    rank = F.struct((F.col(order_by) if order_by else answered).alias("o"), (-F.abs(mark % 2**62)).alias("h"))
    ranked = responses.select(F.col(url).alias("_url"), *fields, rank.alias("_rank"))
    best = ranked.groupBy("_url").agg(F.max("_rank").alias("_best"), F.count(F.lit(1)).alias("_n"))
    many = best.filter("_n > 1").select(F.col("_url").alias("_u"), "_best")
    single = ranked.join(many, (F.col("_url") == F.col("_u")) & (F.col("_rank") != F.col("_best")), "left_anti").drop("_rank")
    single = single.dropDuplicates(["_url"]) if not many.isEmpty() else single
    joined = df.join(single, F.col(url) == F.col("_url"), "left").select(df["*"], F.col("_url"), *fields)
    error = F.when(F.col("_url").isNull(), "no response recorded").otherwise(F.col("transport_error"))
    return joined.withColumn("transport_error", error).drop("_url")


def fetch_to_store(
    df: DataFrame,
    url: str,
    dest: str,
    fetcher: Fetcher,
    retries: int = 15,
    per_host: int = 5,
    total: int = 128,
    max_bytes: str | None = None,
) -> DataFrame:
    """Stream each body into file `dest`: adds `status, bytes_written, md5, error`.

    Saving and digesting share one pass over the blocks, so archives of any size need constant memory.
    """
    schema = with_columns(
        df.schema,
        T.StructField("status", T.IntegerType()),
        T.StructField("bytes_written", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("error", T.StringType()),
    )

    def save(response: Response, target: str, limit: int | None) -> tuple:
        if response.status != 200 or response.stream is None:
            return response.status, None, None, f"RequestFailed: status {response.status}"
        state = new_hash("MD5")

        def tapped() -> Iterator[bytes]:
            for block in limited(blocks(response.stream), limit):
                state.update(block)
                yield block

        try:
            written = write_atomic(target, tapped())
        except SizeLimitExceeded as exc:
            return response.status, None, None, f"SizeLimit: {exc}"
        return response.status, written, state.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = column_values(batch, max_bytes) if max_bytes else [None] * batch.num_rows
            for i, row in enumerate(zip(column_values(batch, url), column_values(batch, dest), limits)):
                source, target, limit = row
                result, error, _ = with_retries(fetcher, source, retries, lambda r: save(r, target, limit))
                cells = result or (None, None, None, f"RequestError: {error}")
                kinds = [pa.int32(), pa.int64(), pa.string(), pa.string()]
                names = ["status", "bytes_written", "md5", "error"]
                yield append_columns(
                    batch.slice(i, 1), {n: pa.array([v], k) for n, v, k in zip(names, cells, kinds)}
                )

    return spread_by_host(df, url, per_host, total).mapInArrow(run, schema)
