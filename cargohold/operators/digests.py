"""Digest of a payload that is spread over ordered chunk rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.functions.digest import check_algorithm
from cargohold.operators.skew import DEFAULT_POLICY, SkewPolicy, Sliced, slice_hot_keys
from cargohold.session import shuffle_partitions
from cargohold.storage import BLOCK, new_hash


def digest_chunks(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    col: str,
    algorithm: str = "MD5",
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """`keys`, `digest` (hex) and `n_bytes` of the ordered concatenation of each key's chunks.

    Partitions are sorted, so one pass with one running hash per task is enough; no payload is ever
    assembled. A hash is serial within a key: for keys too large for one task the chunks are sorted in slices and joined
    to blocks of up to 1 MiB, and the task that owns the key only puts these in order.
    """
    check_algorithm(algorithm)
    narrow = df.select(*keys, *[c for c in order_by if c not in keys], F.col(col).cast("binary").alias("_b"))
    s = slice_hot_keys(narrow, keys, order_by, policy)
    if not s.sliced:
        return _digest_sorted(s.df, keys, order_by, algorithm)
    ordinary = _digest_sorted(s.df.filter(~F.col("_hot")), keys, order_by, algorithm)
    return ordinary.unionByName(_digest_hot(s, keys, order_by, algorithm))


def _digest_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(fields + [T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType())])


def _digest_sorted(df: DataFrame, keys: list[str], order_by: list[str], algorithm: str) -> DataFrame:
    schema = _digest_schema(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, size = None, None, 0
        done: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys] + [pa.string(), pa.int64()]
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for *key, value in zip(*columns, batch.column(batch.num_columns - 1).to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        done.append((*current, state.hexdigest(), size))
                    current, state, size = key, new_hash(algorithm), 0
                if value is not None:
                    state.update(value)
                    size += len(value)
            if len(done) >= 4096:
                yield _rows(done, kinds, schema)
                done = []
        if state is not None:
            done.append((*current, state.hexdigest(), size))
        if done:
            yield _rows(done, kinds, schema)

    partitions = shuffle_partitions(df.sparkSession)
    ordered = df.repartition(partitions, *keys).sortWithinPartitions(*keys, *order_by)
    return ordered.select(*keys, "_b").mapInArrow(run, schema)


def _rows(rows: list[tuple], kinds: list[pa.DataType], schema: T.StructType) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())


def _digest_hot(s: Sliced, keys: list[str], order_by: list[str], algorithm: str) -> DataFrame:
    hot = s.df.filter("_hot")
    schema = T.StructType([hot.schema[k] for k in keys] + [T.StructField("_slice", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, parts, held = None, 0, [], 0
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys] + [pa.int32(), pa.int64(), pa.binary()]
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *at, value in zip(*columns, batch.column(batch.num_columns - 1).to_pylist()):
                if at != current or held >= BLOCK:
                    if current is not None:
                        yield _rows([(*current, number, b"".join(parts))], kinds, schema)
                    number = number + 1 if at == current else 0
                    current, parts, held = at, [], 0
                if value is not None:
                    parts.append(value)
                    held += len(value)
        if current is not None:
            yield _rows([(*current, number, b"".join(parts))], kinds, schema)

    # One block at least for each (key, slice): the slice is the unit of this shuffle, never the key.
    placed = hot.repartition(3 * shuffle_partitions(hot.sparkSession), *keys, "_slice")
    ordered = placed.sortWithinPartitions(*keys, "_slice", *order_by)
    blocks = ordered.select(*keys, "_slice", "_b").mapInArrow(run, schema)
    return _digest_sorted(blocks, keys, ["_slice", "_block"], algorithm)


def with_empty(keys_table: DataFrame, digests: DataFrame, keys: list[str], algorithm: str = "MD5") -> DataFrame:
    """Digest rows for every key, with the digest of no bytes for keys without chunks."""
    empty = new_hash(algorithm).hexdigest()
    joined = keys_table.select(*keys).join(digests, keys, "left")
    return joined.select(
        *keys, F.coalesce("digest", F.lit(empty)).alias("digest"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")
    )
