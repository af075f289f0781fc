"""URL choice and the storage layout derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.config import JobConfig
from cargohold.functions.text import md5_b64_to_hex

SHARD_LENGTH = 3


def choose_url(original: Column, thumbnail: Column, small: bool = False) -> Column:
    """The thumbnail when small copies are wanted and there is one, else the original."""
    if not small:
        return original
    return F.when(F.length(thumbnail) > 0, thumbnail).otherwise(original)


def url_filename(url: Column) -> Column:
    """Last path segment; query, fragment and trailing slashes do not count."""
    return F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "([^/]+)/*$", 1)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def shard(name: Column, length: int = SHARD_LENGTH) -> Column:
    """First characters of the file name; NULL when the name is shorter."""
    return F.when(F.length(name) >= length, F.substring(name, 1, length))


def output_dir(root: str, top_dir: str, subset: Column, subdirectory: str) -> Column:
    return F.concat(F.lit(f"{root}/{top_dir}/"), subset, F.lit(f"/{subdirectory}"))


def resized_path(dest: Column, subdirectory: str, output_format: str) -> Column:
    """Same shard and name under a sibling directory, `.jpg` swapped for the output format."""
    layout = "^(.*)/[^/]+/([^/]+)/([^/]+)$"
    stem = F.regexp_replace(F.regexp_extract(dest, layout, 3), "\\.jpg$", "")
    return F.when(
        dest.isNotNull(),
        F.concat(
            F.regexp_extract(dest, layout, 1),
            F.lit(f"/{subdirectory}/"),
            F.regexp_extract(dest, layout, 2),
            F.lit("/"),
            stem,
            F.lit(f".{output_format}"),
        ),
    )


def download_params(df: DataFrame, cfg: JobConfig, top_dir: str) -> DataFrame:
    """Add `url`, `dest_path`, `expected_size` and `expected_md5` to image-list rows.

    A name too short for a shard leaves `dest_path` NULL and a bad number leaves `expected_size`
    NULL; `operators.classify` turns both into failures of the row.
    """
    small = cfg.download_300k
    with_url = df.withColumn("url", choose_url(F.col("OriginalURL"), F.col("Thumbnail300KURL"), small))
    named = with_url.withColumn("_name", url_filename(F.col("url")))
    folder = output_dir(cfg.root, top_dir, F.col("Subset"), cfg.original_images_subdirectory)
    return named.select(
        *with_url.columns,
        F.concat(folder, F.lit("/"), shard(F.col("_name")), F.lit("/"), F.col("_name")).alias("dest_path"),
        F.col("OriginalSize").try_cast("bigint").alias("expected_size"),
        md5_b64_to_hex(F.col("OriginalMD5")).alias("expected_md5"),
    )
