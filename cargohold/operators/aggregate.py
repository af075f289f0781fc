"""Counts, totals and checks over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cargohold.functions.paths import url_host


class JobFailed(RuntimeError):
    """A job-level check found failed rows."""


def count_by_subset(df: DataFrame, subset: str = "Subset") -> DataFrame:
    return df.groupBy(subset).agg(F.count(F.lit(1)).alias("n_rows"))


def bytes_written(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("n_bytes"))


def host_count(df: DataFrame, url: str = "url", approximate: bool = False) -> DataFrame:
    """Distinct hosts. The distinct runs as a two-step aggregate: hosts are merged before the shuffle."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(url_host(F.col(url))).alias("n_hosts"))


def entry_size_errors(chunks: DataFrame, keys: list[str], expected: str, col: str) -> DataFrame:
    """Entries whose chunks do not add up to the declared size, with the message of the check."""
    sums = chunks.groupBy(*keys, expected).agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("n_bytes"))
    message = F.format_string("expected %d bytes, got %d", expected, "n_bytes")
    return sums.filter(F.col(expected) != F.col("n_bytes")).withColumn("error", message)


def assert_no_failures(df: DataFrame, error: str = "error", order_by: str | None = None) -> int:
    """Raise with the first error, else return the number of rows. One aggregate row reaches the driver."""
    failed = F.col(error).isNotNull()
    first = F.min_by(error, F.when(failed, F.col(order_by or error)))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"), first.alias("first")).first()
    if row["bad"]:
        raise JobFailed(f"{row['bad']} of {row['n']} rows failed, first: {row['first']}")
    return row["n"]


def observed(df: DataFrame, name: str, code: str = "failure_code") -> tuple[DataFrame, Observation]:
    """Count rows and failures as a side metric of whatever action runs next."""
    metrics = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(code).isNotNull()).alias("failures")]
    return df.observe(metrics, *counts), metrics
