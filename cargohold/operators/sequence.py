"""Operators on ordered rows: the order is an explicit list of columns.

Rows of a key that are equal in all of them stand in some order between each other, none is lost or doubled. Where
a result depends on that order, it follows the values that the operator looks at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.operators.skew import DEFAULT_POLICY, SkewPolicy, running_sums, slice_hot_keys

CHUNK = 8192
#: Pieces of one Arrow batch; of CHUNK bytes they are 32 MiB, of larger ones there are fewer.
PIECES = 4096


def unique_consecutive(
    df: DataFrame,
    cols: list[str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Drop a row when `cols` equal those of the row before it; the first row stays, NULL or not."""
    s = slice_hot_keys(df, partition_by or [], [*order_by, *[c for c in cols if c not in order_by]], policy)
    w = s.window()
    before = [F.lag(c).over(w).alias(f"_before{i}") for i, c in enumerate(cols)]
    # NULL only where there is no row before: tells a first row from one that follows NULLs.
    marked = s.df.select("*", F.lag(F.lit(True)).over(w).alias("_follows"), *before)
    previous = [F.col(f"_before{i}") for i in range(len(cols))]
    follows = F.col("_follows")
    if s.sliced:
        tails = s.summaries(F.max_by(F.struct(*cols), s.position()).alias("_tail"))
        by_slice = Window.partitionBy(*s.keys).orderBy("_slice")
        carried = tails.select(*s.keys, "_slice", F.lag("_tail").over(by_slice).alias("_tail"))
        marked = s.attach(marked, carried)
        previous = [F.when(follows, p).otherwise(F.col("_tail")[c]) for p, c in zip(previous, cols)]
        follows = F.coalesce(follows, F.col("_tail").isNotNull())
    same = F.coalesce(follows, F.lit(False))
    for p, c in zip(previous, cols):
        same = same & p.eqNullSafe(F.col(c))
    return marked.filter(~same).select(*df.columns)


def sliding(
    df: DataFrame,
    value: str,
    order_by: list[str],
    partition_by: list[str],
    n: int = 2,
    step: int = 1,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Windows of `n` rows every `step` rows: keys, `window_start` (from 0) and array `window`.

    A short last window appears only when it holds a row that no full window has shown.
    """
    s = slice_hot_keys(df, partition_by, order_by, policy)
    if not s.sliced:
        w = s.window()
        cells = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(0, n - 1))
        numbered = s.df.select(
            *s.keys,
            (F.row_number().over(w) - 1).cast("bigint").alias("window_start"),
            cells.alias("_cells"),
        )
        starts = numbered.filter(F.col("window_start") % step == 0)
    else:
        # A row joins every window that covers it; groups have at most n rows, whatever the key size.
        numbered = running_sums(s, s.df, {"_rn": F.lit(1)}).withColumn("_rn", F.col("_rn") - 1)
        first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - (n - 1)) / step) * step).cast("bigint")
        last = (F.floor(F.col("_rn") / step) * step).cast("bigint")
        covering = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))
        exploded = numbered.select(*s.keys, "_rn", F.col(value).alias("_v"), F.explode(covering).alias("window_start"))
        cells = F.array_sort(F.collect_list(F.struct("_rn", F.col("_v").alias("v"))))
        starts = exploded.groupBy(*s.keys, "window_start").agg(cells.alias("_cells"))
    full = F.size("_cells") == n
    # Rows of a short window that the window before has not covered: none when the sizes overlap fully.
    fresh = (F.col("window_start") == 0) | (F.size("_cells") > max(n - step, 0))
    kept = starts.filter(full | fresh)
    return kept.select(*partition_by, "window_start", F.transform("_cells", lambda c: c["v"]).alias("window"))


def _pieces(payload: Column, first: Column, last: Column, offset: Column, n: int) -> Column:
    """Array of (chunk_id, at, bytes): the payload at `offset` cut at multiples of `n`."""

    def piece(i: Column) -> Column:
        start = F.greatest(i * n, offset)
        stop = F.least((i + 1) * n, offset + F.octet_length(payload))
        cut = F.substring(payload, (start - offset + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(i.alias("chunk_id"), start.alias("at"), cut.alias("bytes"))

    return F.transform(F.sequence(first, last), piece)


def chunk_binary(df: DataFrame, col: str, n: int = CHUNK) -> DataFrame:
    """Split one binary value per row into pieces of `n` bytes: adds `chunk_id`, replaces the value."""
    rest = [c for c in df.columns if c != col]
    kind = df.schema[col].dataType
    fields = [df.schema[c] for c in rest] + [T.StructField("chunk_id", T.LongType()), T.StructField(col, T.BinaryType())]

    per_batch = max(1, min(PIECES, PIECES * CHUNK // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            sizes = np.diff(offsets)
            count = -(-sizes // n)
            until = np.cumsum(count)
            # The pieces lie behind each other in the batch as the values do: only offsets are made.
            for first in range(0, int(until[-1]) if len(until) else 0, per_batch):
                nth = np.arange(first, min(first + per_batch, int(until[-1])))
                row = np.searchsorted(until, nth, "right")
                chunk = nth - (until - count)[row]
                edges = np.append(offsets[row] + chunk * n, min(offsets[row[-1]] + (chunk[-1] + 1) * n, offsets[row[-1] + 1]))
                data = values.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0]))
                cut = pa.Array.from_buffers(pa.binary(), len(nth), [None, pa.py_buffer((edges - edges[0]).astype(np.int32)), data])
                others = [batch.column(i).take(pa.array(row)) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*others, pa.array(chunk), cut], names=[f.name for f in fields])

    valued = df.filter(F.octet_length(col) > 0).select(*rest, F.col(col).cast("binary").alias(col))
    return valued.mapInArrow(run, T.StructType(fields)).select(*rest, "chunk_id", F.col(col).cast(kind).alias(col))


def rechunk(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    col: str,
    n: int = CHUNK,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Join and cut ordered byte rows of a key into pieces of exactly `n` bytes, the last may be short.

    Offsets come from running lengths; every row is cut at multiples of `n` and the parts of a piece
    meet in one group of at most `n` bytes. A payload is never assembled in one row.
    """
    s = slice_hot_keys(df, keys, order_by, policy)
    sized = s.df.select(*s.keys, "_slice", "_hot", *order_by, F.col(col).alias("_b"))
    placed = running_sums(s, sized, {"_off": F.octet_length("_b").cast("bigint")}, inclusive=False)
    first, last = F.expr(f"_off div {n}"), F.expr(f"(_off + octet_length(_b) - 1) div {n}")
    cut = F.explode(_pieces(F.col("_b"), first, last, F.col("_off"), n)).alias("_piece")
    parts = placed.filter(F.octet_length("_b") > 0).select(*s.keys, cut)
    flat = parts.select(*s.keys, "_piece.chunk_id", F.col("_piece.at").alias("_at"), F.col("_piece.bytes").alias("_p"))
    joined = F.expr("listagg(_p) WITHIN GROUP (ORDER BY _at)").alias(col)
    return flat.groupBy(*s.keys, "chunk_id").agg(joined).select(*keys, "chunk_id", col)


def split_when(
    df: DataFrame,
    flag: Column,
    order_by: list[str],
    partition_by: list[str],
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Number the sub-sequences that start at a flagged row: adds `group_id` (from 0) and `is_first`.

    The first row always starts group 0, flagged or not.
    """
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    s = slice_hot_keys(flagged, partition_by, [*order_by, "_flag"], policy)
    counted = running_sums(s, s.df, {"_rn": F.lit(1), "_flags": F.col("_flag")})
    first_flag = F.first_value("_flag").over(s.window())
    if s.sliced:
        heads = s.summaries(F.min_by("_flag", s.position()).alias("_head"))
        by_slice = Window.partitionBy(*s.keys).orderBy("_slice")
        carried = heads.select(*s.keys, "_slice", F.first_value("_head").over(by_slice).alias("_head"))
        counted = s.attach(counted, carried)
        first_flag = F.coalesce(F.col("_head"), first_flag)
    grouped = counted.withColumn("group_id", F.col("_flags") - first_flag)
    is_first = (F.col("_rn") == 1) | (F.col("_flag") == 1)
    return grouped.select(*df.columns, "group_id", is_first.alias("is_first"))


def head_per_group(df: DataFrame, order_by: list[str], partition_by: list[str], n: int = 1) -> DataFrame:
    """First `n` rows of each key. Spark limits every group before the shuffle, so a large key is no problem."""
    rank = F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def capped_concat(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    col: str,
    cap: int = 1024 * 1024,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Ordered concatenation of the leading rows whose total stays within `cap` bytes.

    The first row is taken even when it is longer. The cap is the operator: it bounds the group.
    """
    # Only lengths and digests are sorted; the payload of the kept rows alone is shuffled. The digest tells rows of one
    # position apart, and equal ones are counted instead of joined one by one.
    order = [c for c in order_by if c not in keys]
    at = [*keys, *order, "_hash"]
    hashed = df.select(*keys, *order, F.md5(F.col(col).cast("binary")).alias("_hash"), F.col(col).alias("_b"))
    s = slice_hot_keys(hashed.select(*at, F.octet_length("_b").cast("bigint").alias("_size")), keys, [*order_by, "_hash"], policy)
    counted = running_sums(s, s.df, {"_rn": F.lit(1), "_total": F.col("_size")})
    kept = counted.filter((F.col("_total") <= cap) | (F.col("_rn") == 1)).groupBy(*at).agg(F.count("*").alias("_copies"), F.min("_rn").alias("_first"))
    kept = kept.select("_copies", "_first", *[F.col(c).alias(f"_at_{c}") for c in at])
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    rows = hashed.join(kept, same).dropDuplicates(at)
    copies = F.explode(F.array_repeat("_b", F.col("_copies").cast("int"))).alias("_b")
    rows = rows.filter("_b IS NOT NULL").select(*keys, "_first", copies).union(rows.filter("_b IS NULL").select(*keys, "_first", "_b"))
    joined = F.expr("listagg(_b) WITHIN GROUP (ORDER BY _first)").alias(col)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(joined, F.sum(F.octet_length("_b")).alias("n_bytes")).select(*keys, col, "n_bytes")


def switch_source(
    primary: DataFrame, fallback: DataFrame, pos: str, at: int | DataFrame | None, keys: list[str] | None = None
) -> DataFrame:
    """Rows of `primary` before position `at`, rows of `fallback` from there on.

    `at` is one position, None for no switch, or a table (keys, at) with a position per key, the first
    one if there are several; keys without a position stay on `primary`.
    """
    if at is None:
        return primary
    if isinstance(at, int):
        return primary.filter(F.col(pos) < at).unionByName(fallback.filter(F.col(pos) >= at))
    points = at.groupBy(*keys).agg(F.min("at").alias("_at"))
    before = primary.join(points, keys, "left").filter(F.col("_at").isNull() | (F.col(pos) < F.col("_at")))
    after = fallback.join(points, keys).filter(F.col(pos) >= F.col("_at"))
    return before.drop("_at").unionByName(after.drop("_at"))


def ordered_concat(*parts: DataFrame) -> DataFrame:
    """One input after the other: UNION ALL with `source_ord`, to be sorted by the reader if it cares."""
    tagged = [part.withColumn("source_ord", F.lit(i)) for i, part in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out
