"""Column names and schemas shared by the sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_LIST_COLUMNS = [
    "ImageID",
    "Subset",
    "OriginalURL",
    "OriginalLandingURL",
    "License",
    "AuthorProfileURL",
    "Author",
    "Title",
    "OriginalSize",
    "OriginalMD5",
    "Thumbnail300KURL",
]
SUBSETS = ["train", "validation", "test"]
FAILURE_DETAILS = "FailureDetails"
FAILURE_COLUMNS = IMAGE_LIST_COLUMNS + [FAILURE_DETAILS]

IMAGE_LIST = T.StructType([T.StructField(c, T.StringType()) for c in IMAGE_LIST_COLUMNS])

MANIFEST = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("top_dir", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("uri", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("md5_hex", T.StringType(), False),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("transport_error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("size_limit_hit", T.BooleanType()),
    ]
)

TAR_INDEX = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("entry_ord", T.LongType()),
        T.StructField("entry_name", T.StringType()),
        T.StructField("entry_size", T.LongType()),
        T.StructField("entry_type", T.StringType()),
        T.StructField("data_offset", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Closed list of failure codes, in the order in which a row is checked.
FAILURE_CODES = [
    "BadPath",
    "BadSize",
    "BadChecksumField",
    "RequestError",
    "ContentTypeNotJpeg",
    "NoContentLength",
    "InvalidSize",
    "ImageUnknown",
    "ImageIO",
    "MD5SumMismatch",
    "Redirect",
    "RequestFailed",
]
