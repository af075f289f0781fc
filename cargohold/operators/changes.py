"""What a store holds, as a log of versions that are merged when read."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.operators.audit import plan_fetch
from cargohold.session import qualify
from cargohold.storage import file_size, resolve

#: A row says what lies under `path` from its version on; `pack` and `offset` are NULL where `path` is a file of its own.
CHANGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("pack", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)
_STORED = T.StructType([*CHANGE.fields, T.StructField("version", T.IntegerType())])


def _complete(folder: str, kind: str) -> list[int]:
    filesystem, name = resolve(folder)
    if filesystem.get_file_info(name).type != fs.FileType.Directory:
        return []
    numbers = (re.fullmatch(rf"{kind}=(\d+)", i.base_name) for i in filesystem.get_file_info(fs.FileSelector(name)))
    return sorted(n for n in (int(m[1]) for m in numbers if m) if file_size(f"{folder}/{kind}={n}/_SUCCESS") is not None)


def latest_version(spark: SparkSession, folder: str) -> int:
    """Number of the last complete version, -1 before the first."""
    folder = qualify(spark, folder).rstrip("/")
    return max([*_complete(folder, "version"), *_complete(folder, "base")], default=-1)


def append(rows: DataFrame, folder: str) -> int:
    """Store `rows` (`path` and any other columns of `CHANGE`) as the next version; returns its number.

    A version counts once it is complete: a broken write is overwritten by the next. One job appends at a time.
    """
    spark, folder = rows.sparkSession, qualify(rows.sparkSession, folder).rstrip("/")
    given = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType) for f in CHANGE.fields]
    version = latest_version(spark, folder) + 1
    named = rows.select(*[c.alias(f.name) for c, f in zip(given, CHANGE.fields)]).filter("path IS NOT NULL")
    named.fillna(False, ["deleted"]).write.mode("overwrite").parquet(f"{folder}/version={version}")
    return version


def entries(spark: SparkSession, folder: str, after: int, upto: int) -> DataFrame:
    """All rows of the versions behind `after`, up to `upto`, with their `version`."""
    paths = [f"{folder}/version={n}" for n in _complete(folder, "version") if after < n <= upto]
    if not paths:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", folder).parquet(*paths)


def _last(entries: DataFrame) -> DataFrame:
    """One row for each path; of several in one version a stored one comes before a deleted, then the greatest counts."""
    ranked = F.struct("version", (~F.col("deleted")).alias("held"), "length", "md5", "pack", "offset")
    merged = entries.groupBy("path").agg(F.max(ranked).alias("m"))
    cells = [(~F.col("m.held")).alias("deleted") if f.name == "deleted" else F.col(f"m.{f.name}") for f in _STORED.fields[1:]]
    return merged.select("path", *cells)


def changes(spark: SparkSession, folder: str, since: int, upto: int | None = None) -> DataFrame:
    """The last entry of every path that versions after `since` name, deletions too; older versions aren't opened."""
    folder = qualify(spark, folder).rstrip("/")
    return _last(entries(spark, folder, since, latest_version(spark, folder) if upto is None else upto))


def state(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """What is stored after version `upto` (the last), one row for each path.

    The newest base up to there has a row for each path already: it isn't grouped again, only the paths that later
    versions name are taken out, by an anti join whose right side is those versions.
    """
    folder = qualify(spark, folder).rstrip("/")
    upto = latest_version(spark, folder) if upto is None else upto
    base = max((n for n in _complete(folder, "base") if n <= upto), default=-1)
    late = _last(entries(spark, folder, base, upto))
    if base >= 0:
        held = spark.read.schema(_STORED).parquet(f"{folder}/base={base}")
        late = held.join(late.select("path"), "path", "left_anti").select(*_STORED.fieldNames()).unionByName(late)
    return late.filter("NOT deleted")


def fold(spark: SparkSession, folder: str) -> int:
    """Write the state as a base, so that reading opens no version up to there; returns its version.

    Versions stay: `changes` and `state` of earlier ones can still be asked for.
    """
    folder = qualify(spark, folder).rstrip("/")
    upto = latest_version(spark, folder)
    if upto >= 0 and file_size(f"{folder}/base={upto}/_SUCCESS") is None:
        state(spark, folder, upto).write.mode("overwrite").parquet(f"{folder}/base={upto}")
    return upto


def replan(
    wanted: DataFrame, plan: DataFrame, folder: str, since: int, check_md5: bool = True, path: str = "dest_path"
) -> DataFrame:
    """`plan_fetch` of `wanted` against the last version, from the `plan` made against version `since`.

    `plan` is what was returned then, its expected columns included. Rows that are in it and whose path hasn't changed
    since keep their reason, those whose path has changed are compared with the changes, and rows that are new or
    expect other contents with the state. No file is asked for.
    """
    fresh = changes(wanted.sparkSession, folder, since)
    keys = [path, "expected_size", "expected_md5"]
    before = plan.groupBy(*[F.col(k).alias(f"_was_{k}") for k in keys]).agg(F.min("reason").alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_was_{k}")) for k in keys]
    marked = wanted.join(before, same[0] & same[1] & same[2], "left").drop(*[f"_was_{k}" for k in keys])
    marked = marked.join(fresh.select(F.col("path").alias("_touched")), F.col(path) == F.col("_touched"), "left")
    known = plan_fetch(marked.filter("_before IS NOT NULL"), fresh.filter("NOT deleted"), check_md5, path=path)
    reason = F.when(F.col("_touched").isNull(), F.col("_before")).otherwise(F.col("reason"))
    known = known.select(*wanted.columns, reason.alias("reason")).withColumn("need_fetch", F.col("reason") != "valid")
    new = marked.filter("_before IS NULL").select(*wanted.columns)
    return known.unionByName(plan_fetch(new, state(wanted.sparkSession, folder), check_md5, path=path))
