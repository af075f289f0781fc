"""Outcome of every row: response classification, digest verdict, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.functions.text import utf8

# Limits, and below the failure messages, that result tables are compared by.
SMALL_IMAGE_LIMIT = 1_200_000
FAILURE_BODY_LIMIT = 1024 * 1024
UNAVAILABLE_PATH = "/photo_unavailable(_l)?\\.png$"


def size_limit(small: bool) -> Column:
    expected = F.col("expected_size")
    return F.greatest(F.lit(SMALL_IMAGE_LIMIT).cast("bigint"), expected) if small else expected


def is_redirect() -> Column:
    return F.col("status").between(300, 399)


def is_unavailable_redirect() -> Column:
    """A redirect to the host's 'photo unavailable' picture."""
    path = F.try_parse_url(F.col("location"), F.lit("PATH"))
    return F.coalesce(is_redirect() & path.rlike(UNAVAILABLE_PATH), F.lit(False))


def input_failure(small: bool = False) -> Column:
    """Failures that a row carries before any request is made."""
    code = F.when(F.col("dest_path").isNull(), "BadPath").when(F.col("expected_size").isNull(), "BadSize")
    return code if small else code.when(F.col("expected_md5").isNull(), "BadChecksumField")


def header_failure(small: bool = False) -> Column:
    """Verdict on status and headers alone; NULL means that the body is wanted."""
    ok = F.col("status") == 200
    jpeg = F.coalesce(F.lower(F.trim("content_type")) == "image/jpeg", F.lit(False))
    length = F.col("content_length")
    code = (
        F.when(F.col("transport_error").isNotNull() | F.col("status").isNull(), "RequestError")
        .when(ok & ~jpeg, "ContentTypeNotJpeg")
        .when(ok & length.isNull(), "NoContentLength")
    )
    if not small:
        code = code.when(ok & (length != F.col("expected_size")), "InvalidSize")
    return code.when(is_redirect(), "Redirect").when(~ok, "RequestFailed")


def body_failure(small: bool = False) -> Column:
    """Verdict on the body of an accepted response."""
    too_long = F.octet_length("body") > size_limit(small)
    return F.when(F.coalesce(too_long, F.lit(False)), "ImageUnknown")


def failure_message(small: bool = False) -> Column:
    """Message for the code in `failure_code`."""
    code, url = F.col("failure_code"), F.col("url")
    body = F.when(F.octet_length("body") <= FAILURE_BODY_LIMIT, utf8(F.col("body"))).otherwise("")
    return (
        F.when(code == "BadPath", F.concat(F.lit("no usable file name in url: "), url))
        .when(code == "BadSize", F.concat(F.lit("size is not a number: "), F.col("OriginalSize")))
        .when(code == "BadChecksumField", F.concat(F.lit("checksum is not Base64: "), F.col("OriginalMD5")))
        .when(
            code == "RequestError",
            F.format_string("request to %s failed: %s", url, F.coalesce("transport_error", F.lit("no response"))),
        )
        .when(code.isin("ContentTypeNotJpeg", "NoContentLength"), url)
        .when(
            code == "InvalidSize",
            F.format_string(
                "%s: server size (%d) doesn't match expected size (%d)!", url, "content_length", "expected_size"
            ),
        )
        .when(
            code == "ImageUnknown",
            F.format_string("body of %d bytes is over the limit of %d", F.octet_length("body"), size_limit(small)),
        )
        .when(code == "Redirect", F.concat(F.lit("photo is unavailable: "), url))
        .when(code == "RequestFailed", F.format_string("http request to %s failed: %s", url, F.coalesce(body, F.lit(""))))
        .when(code == "MD5SumMismatch", "md5 sum mismatch")
    )


def classify_response(df: DataFrame, small: bool = False) -> DataFrame:
    """Add `failure_code` (NULL when accepted) and `failure_details` from the response columns."""
    code = F.coalesce(input_failure(small), header_failure(small), body_failure(small))
    coded = df.withColumn("failure_code", code)
    return coded.withColumn("failure_details", failure_message(small))


def verify_digest(df: DataFrame, actual: Column, small: bool = False, io_error: str | None = None) -> DataFrame:
    """Fold save errors and the digest comparison into `failure_code`; earlier failures pass through."""
    code, details = F.col("failure_code"), F.col("failure_details")
    late, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    if io_error:
        late = F.when(F.col(io_error).isNotNull(), "ImageIO")
        message = F.col(io_error)
    if not small:
        mismatch = ~actual.eqNullSafe(F.col("expected_md5"))
        late = F.coalesce(late, F.when(mismatch, "MD5SumMismatch"))
    return df.withColumn("_late", F.when(code.isNull(), late)).select(
        *[c for c in df.columns if c not in ("failure_code", "failure_details")],
        F.coalesce(code, "_late").alias("failure_code"),
        F.when(F.col("_late") == "ImageIO", message)
        .when(F.col("_late") == "MD5SumMismatch", "md5 sum mismatch")
        .otherwise(details)
        .alias("failure_details"),
    )


def outcome(code: Column | None = None) -> Column:
    """`Success` or the failure code."""
    return F.coalesce(F.col("failure_code") if code is None else code, F.lit("Success"))
