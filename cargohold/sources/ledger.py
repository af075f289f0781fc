"""Requests over several passes: every attempt is a row of a table that says when the next one is due."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.schemas import RESPONSE
from cargohold.sources.fetch import Fetcher, fetch
from cargohold.storage import file_size

BASE_SECONDS, MAX_SECONDS = 60, 24 * 3600
LEDGER = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("at", T.TimestampType()), T.StructField("due", T.TimestampType())]
    + [f for f in RESPONSE.fields if f.name != "attempts"]
)


def attempts(df: DataFrame, folder: str) -> DataFrame:
    """All attempts in the ledger; a pass that did not end has none."""
    spark, done, nth = df.sparkSession, [], 0
    while file_size(f"{folder}/pass={nth}/_SUCCESS") is not None:
        done.append(f"{folder}/pass={nth}")
        nth += 1
    return spark.read.schema(LEDGER).parquet(*done) if done else spark.createDataFrame([], LEDGER)


def latest(df: DataFrame, folder: str) -> DataFrame:
    """(url, attempt, due) of the last attempt at each URL, from narrow columns only."""
    return attempts(df, folder).groupBy("url").agg(F.max(F.struct("attempt", "due")).alias("m")).select("url", "m.attempt", "m.due")


def fetch_due(
    df: DataFrame, url: str, fetcher: Fetcher, folder: str, now: datetime, max_attempts: int = 15, base_seconds: float = BASE_SECONDS, max_seconds: float = MAX_SECONDS, **limits
) -> int:
    """One pass: a single request for each URL of `df` that is new or due; returns how many there were.

    The pass is one written folder of the ledger, so a broken pass is repeated and an ended one is not. An answer of
    any status closes its URL (`due` is NULL), as does the last attempt; a transport error is due again after `base_seconds`,
    doubled with each attempt up to `max_seconds`, counted from `now` and kept over runs. `limits` go to `fetch`.
    """
    known = latest(df, folder).select(F.col("url").alias("_url"), F.col("attempt").alias("_attempt"), F.col("due").alias("_due"))
    at = F.lit(now).cast("timestamp")
    urls = df.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    open_ = urls.join(known, F.col("url") == F.col("_url"), "left").filter(F.col("_url").isNull() | (F.col("_due") <= at))
    work = open_.select("url", (F.coalesce("_attempt", F.lit(0)) + 1).cast("int").alias("attempt"))
    got = fetch(work, "url", fetcher, retries=0, **limits)
    wait = F.least(F.lit(float(max_seconds)), F.lit(float(base_seconds)) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    again = F.col("transport_error").isNotNull() & (F.col("attempt") < max_attempts)
    due = F.when(again, F.timestamp_millis(F.unix_millis(at) + (wait * 1000).cast("long")))
    nth = 0
    while file_size(f"{folder}/pass={nth}/_SUCCESS") is not None:
        nth += 1
    rows = got.withColumn("at", at).withColumn("due", due).select(*LEDGER.fieldNames())
    rows.write.mode("overwrite").parquet(f"{folder}/pass={nth}")
    return df.sparkSession.read.schema(LEDGER).parquet(f"{folder}/pass={nth}").count()


def answers(df: DataFrame, url: str, folder: str) -> DataFrame:
    """`df` with the columns of the last attempt at its URL, `attempts` and `due` (NULL: closed).

    The last attempts are chosen on narrow columns; bodies of earlier ones are not shuffled.
    """
    last = latest(df, folder).select(F.col("url").alias("_u"), F.col("attempt").alias("_a"))
    rows = attempts(df, folder).join(last, (F.col("url") == F.col("_u")) & (F.col("attempt") == F.col("_a"))).drop("_u", "_a", "at")
    rows = rows.withColumnRenamed("url", "_url").withColumnRenamed("attempt", "attempts")
    joined = df.join(rows, F.col(url) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("attempts", F.coalesce("attempts", F.lit(0)))
