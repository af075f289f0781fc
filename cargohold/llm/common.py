"""Staging, what workers keep between tasks, and vectorised words and shingles over Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from contextlib import suppress
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.session import scratch_dir, small_batches

#: Java pattern of a word; its separators are the bytes of SEPARATORS.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised step handles; longer texts are cut at separators.
STEP_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and the table survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """`make()`, which this worker keeps for its next tasks until a task of another operator calls `let_go`."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it for this worker otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """At the start of a task: drop what tasks of other operators kept. Spark hands a worker on from stage to stage and
    from job to job, so it would hold that beside what this task needs."""
    _KEPT.clear()
    give_back()


#: Numbers given to rows lie below this; ids there are numbered too.
NUMBERS_BELOW = -(1 << 62)


def identified(docs: DataFrame, label: str, id_col: str = "doc_id") -> tuple[DataFrame, str, DataFrame | None]:
    """`docs` with a column that tells its rows apart, that column's name, and (number, id) of the rows that were given a number.

    That is the id where it is neither null nor repeated. Only the other rows are written, with a number each.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    odd = docs.groupBy(F.col(id_col).alias("_odd")).agg(F.count("*").alias("_n"))
    odd = staged(odd.filter(F.col("_odd").isNull() | (F.col("_n") > 1) | (F.col("_odd") < NUMBERS_BELOW)).select("_odd"), f"{label}-odd")
    if odd.isEmpty():
        return docs.withColumn(name, F.col(id_col)), name, None
    same, known = F.col(id_col).eqNullSafe(F.col("_odd")), broadcast_if(odd, 100_000)
    rows = docs.join(known, same, "left_semi").withColumn(name, F.lit(NUMBERS_BELOW) - 1 - F.monotonically_increasing_id())
    rows = staged(rows, label)
    rest = docs.join(known, same, "left_anti").withColumn(name, F.col(id_col))
    return rest.union(rows), name, rows.select(F.col(name).alias("number"), F.col(id_col).alias("id"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a check of the size; above it the join shuffles, with the same result."""
    return F.broadcast(df) if small_enough(df, rows) else df


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        more = np.ones(max(n, 2 * len(_POWERS)), np.uint64)
        more[1:] = _BASE
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


_powers(65)


def _hash_words(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes; `fresh` marks bytes that begin a text."""
    word = ~_SPACE[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | fresh))
    at = np.flatnonzero(word)
    nth = np.cumsum((word & (~before | fresh))[at]) - 1
    place = at - starts[nth]
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    first = np.searchsorted(at, starts)
    return mix(np.add.reduceat(terms, first)), starts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) UTF-8 bytes of all rows and their offsets; null counts as empty."""
    data, offsets = utf8(column)
    return _LOWER[data], offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one entry more at the end)."""
    hashes, starts, begin, end = [], [], 0, len(data)
    while begin < end:
        stop = min(end, begin + STEP_BYTES)
        if stop < end:
            gap = np.flatnonzero(_SPACE[data[begin:stop]])
            row = int(np.searchsorted(offsets, stop, "right")) - 1
            inside = offsets[row] if begin < offsets[row] else 0
            cut = max(int(gap[-1]) + 1 + begin if len(gap) else 0, int(inside))
            if cut <= begin:  # one word longer than a step
                rest = np.flatnonzero(_SPACE[data[stop:]])
                after = int(rest[0]) + stop if len(rest) else end
                cut = min(after, int(offsets[row + 1])) if row + 1 < len(offsets) else after
            stop = cut
        fresh = np.zeros(stop - begin, bool)
        heads = offsets[(offsets >= begin) & (offsets < stop)] - begin
        fresh[heads] = True
        h, s = _hash_words(data[begin:stop], fresh)
        hashes.append(h)
        starts.append(s + begin)
        begin = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; shorter texts give their whole sequence."""
    data, offsets = texts(column)
    words, first = word_hashes(data, offsets)
    salts = mix(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = len(words)
        sums = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            sums += words[j : n - k + 1 + j] * salts[j] if len(sums) else np.zeros(0, np.uint64)
        sums = mix(sums + salts[k])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(sums[a : b - k + 1])
            elif b > a:
                whole = np.sum(words[a:b] * salts[: b - a], dtype=np.uint64)
                yield mix(np.array([whole + salts[b - a] * np.uint64(3)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about `limit` bytes, one row at least."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)
