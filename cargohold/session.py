"""Session defaults, scratch space and size checks."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call sites of every column expression are for debugging; collecting them dominates small queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Payload rows are wide: bound an Arrow batch by bytes rather than by rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


#: Bytes of an Arrow batch on its way to a Python worker, which holds a few times as much.
BATCH_BYTES = 4 << 20


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; tasks import it by name."""
    context = spark.sparkContext
    if getattr(context, "_cargohold_shipped", False):
        return
    source = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='cargohold-')}/cargohold", "zip", source, base_dir=Path(__file__).resolve().parent.name
    )
    context.addPyFile(archive)
    context._cargohold_shipped = True


_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared `spark.checkpoint.dir`.

    Where that is unset, a local session gets a temporary folder; on a cluster executors would each write their own,
    so there it is an error. `clear_scratch` deletes what a job has left.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        path = f"{qualify(spark, shared).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.split("[")[0] == "local":
        path = tempfile.mkdtemp(prefix=f"{label}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _SCRATCH.append(path)
    return path


def qualify(spark: SparkSession, path: str) -> str:
    """The path with the scheme and store that Spark takes by default, so that workers open the same place; local files stay plain."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path):
        context = spark.sparkContext
        jpath = context._jvm.org.apache.hadoop.fs.Path(path)
        path = jpath.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return re.sub("^file:/+", "/", path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders of this driver; nothing that reads them may be used afterwards."""
    context = spark.sparkContext
    while _SCRATCH:
        jpath = context._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        jpath.getFileSystem(context._jsc.hadoopConfiguration()).delete(jpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches by bytes while a job runs, so that rows with long payloads don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)
