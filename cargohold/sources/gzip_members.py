"""Gzip files of several members, whose members are inflated in parallel."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargohold.session import shuffle_partitions
from cargohold.sources.tar import OpenArchive
from cargohold.storage import BLOCK, GROUP_BYTES, column_values, file_size, resolve

WINDOW_BYTES = 64 * 1024 * 1024
#: Fixed values of the format: two magic bytes, deflate, and the flags in use.
MEMBER_HEAD = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
HEAD_BYTES = 4
#: The first read of a member, most of which are far shorter than BLOCK; each further one is twice as long, up to BLOCK.
FIRST_READ = 4096
#: Pieces and bytes of one Arrow batch.
BATCH_PIECES = 1024
_INFLATED = "path string, start bigint, end bigint, n_bytes bigint"


class Member:
    """Inflated blocks of the member at `start` of a stream; raises where there is none. `end` is set behind the last."""

    def __init__(self, stream, start: int) -> None:
        self.stream, self.start, self.end = stream, start, None

    def __iter__(self) -> Iterator[bytes]:
        self.stream.seek(self.start)
        state, size = zlib.decompressobj(31), FIRST_READ
        while not state.eof:
            block = self.stream.read(size)
            if not block:
                raise EOFError("gzip stream ends early")
            size = min(2 * size, BLOCK)
            while block and not state.eof:
                if out := state.decompress(block, BLOCK):
                    yield out
                block = state.unconsumed_tail
        self.end = self.stream.tell() - len(state.unused_data)


def _heads(path: str, first: int, last: int) -> Iterator[int]:
    """Where a member may begin, in [first, last)."""
    filesystem, name = resolve(path)
    with filesystem.open_input_file(name) as stream:
        stream.seek(first)
        at, held = first, b""
        while at - len(held) < last and (block := stream.read(min(BLOCK, last - at + HEAD_BYTES - 1))):
            data, base = held + block, at - len(held)
            at += len(block)
            # What begins in the last bytes is seen whole with the next block.
            yield from (base + m.start() for m in MEMBER_HEAD.finditer(data) if base + m.start() < last)
            held = data[-(HEAD_BYTES - 1) :]


def member_index(files: DataFrame, source: str = "path", window: int = WINDOW_BYTES) -> DataFrame:
    """`path, member, start, end, n_bytes, error` of every gzip member, in order.

    Windows of the files are searched for member heads in parallel, and what begins there is inflated to its checksum.
    Bytes that only look like a head fail that; a whole gzip file inside a member's data lies within it and is passed
    over. The members of a file must join without a gap from its first byte to its last (zeros may follow); else the
    one behind the gap, or the last, has an `error`. A file without a member, or one that can't be opened, is one row
    with `error`. A file listed twice is read once; a NULL path is passed over.
    """
    spark = files.sparkSession
    n = shuffle_partitions(spark)
    paths = files.select(F.col(source).alias("path")).filter("path IS NOT NULL").distinct()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = column_values(batch, "path")
            yield pa.record_batch([pa.array(named, pa.string()), pa.array(map(file_size, named), pa.int64())], names=["path", "size"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, size in zip(*[column_values(batch, c) for c in ("path", "first", "size")]):
                starts = list(_heads(path, first, min(size, first + window)))
                yield pa.record_batch([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64())], names=["path", "start"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = OpenArchive()
        for batch in batches:
            found = []
            for path, start in zip(column_values(batch, "path"), column_values(batch, "start")):
                try:
                    member = Member(file.at(path, start), start)
                    n_bytes = sum(map(len, member))
                    found.append((path, start, member.end, n_bytes))
                except (zlib.error, EOFError):
                    pass
            cells = zip(*found) if found else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cells, kinds)], names=["path", "start", "end", "n_bytes"])
        file.close()

    sized = paths.repartition(n, "path").mapInArrow(size, "path string, size bigint")
    last = F.greatest(F.lit(0), F.col("size") - 1)
    windows = sized.filter("size IS NOT NULL").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(window).cast("bigint"))).alias("first"))
    begins = windows.repartition(n, "path", "first").mapInArrow(heads, "path string, start bigint")
    members = begins.repartition(n, "path", "start").sortWithinPartitions("path", "start").mapInArrow(measure, _INFLATED)
    return _chained(members, sized, window)


def _chained(members: DataFrame, sized: DataFrame, window: int) -> DataFrame:
    """Members that lie in no other, with their number and whether they join. Ordered within windows, then over windows.

    Spark takes the members for as few as the files, so that unhinted joins would broadcast them all. They meet their
    window's row, never their file's, and what is known of the file comes with that.
    """
    part = F.floor(F.col("start") / window)
    inner = Window.partitionBy("path", "part").orderBy("start")
    outer = Window.partitionBy("path").orderBy("part")
    upto = Window.unboundedPreceding
    parted = members.withColumn("part", part)
    reach = parted.groupBy("path", "part").agg(F.max("end").alias("reach"))
    reach = reach.select("path", "part", F.max("reach").over(outer.rowsBetween(upto, -1)).alias("before"))
    own = F.max("end").over(inner.rowsBetween(upto, -1))
    placed = parted.withColumn("own", own).join(reach.hint("merge"), ["path", "part"])
    placed = placed.withColumn("reached", F.coalesce(F.greatest("own", "before"), F.lit(0))).filter("start >= reached")
    counts = placed.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("to"))
    over = outer.rowsBetween(upto, -1)
    whole = Window.partitionBy("path")
    counts = counts.select("path", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("behind"), F.max("to").over(whole).alias("to"))
    tail = counts.select("path", "to").distinct()
    ended = sized.join(tail.hint("merge"), "path", "left").mapInArrow(_tails, "path string, size bigint, to bigint, trailing boolean")
    parts = ended.join(counts.drop("to").hint("merge"), "path", "left")
    numbered = placed.withColumn("nth", F.row_number().over(inner) - 1)
    joined = parts.join(numbered.hint("merge"), ["path", "part"], "left")
    error = F.when(F.col("size").isNull(), "NotFound").when(F.col("to").isNull(), "no gzip member")
    error = error.when(F.col("start") > F.col("reached"), F.concat(F.lit("no member at byte "), F.col("reached").cast("string")))
    error = error.when((F.col("end") == F.col("to")) & F.col("trailing"), F.concat(F.lit("no member at byte "), F.col("to").cast("string")))
    return joined.select("path", (F.col("behind") + F.col("nth")).alias("member"), "start", "end", "n_bytes", error.alias("error"))


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether anything but zeros follows the last member."""
    for batch in batches:
        found = []
        for path, size, to in zip(*[column_values(batch, c) for c in ("path", "size", "to")]):
            rest = False
            if size is not None and to is not None and to < size:
                filesystem, name = resolve(path)
                with filesystem.open_input_file(name) as stream:
                    stream.seek(to)
                    while not rest and (block := stream.read(BLOCK)):
                        rest = any(block)
            found.append(rest)
        yield pa.record_batch([*batch.select(["path", "size", "to"]).columns, pa.array(found, pa.bool_())], names=["path", "size", "to", "trailing"])


def read_members(index: DataFrame) -> DataFrame:
    """`path, member, pos, bytes` (pieces of up to 1 MiB) of indexed members; of several small or one large file alike.

    One row of the index is one piece of work. Rows with an `error` or without a member give nothing: check the index first.
    """
    sound = index.filter("error IS NULL").select("path", "member", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "member", "pos", "bytes"], (pa.string(), pa.int64(), pa.int64(), pa.binary())
        file, rows, held = OpenArchive(), [], 0
        for batch in batches:
            for path, member, start in zip(*[column_values(batch, c) for c in ("path", "member", "start")]):
                for pos, data in enumerate(Member(file.at(path, start), start)):
                    rows.append((path, member, pos, data))
                    held += len(data)
                    if len(rows) == BATCH_PIECES or held >= GROUP_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        file.close()

    n = shuffle_partitions(index.sparkSession)
    placed = sound.repartition(n, "path", "start").sortWithinPartitions("path", "start")
    return placed.mapInArrow(run, "path string, member bigint, pos bigint, bytes binary")
