"""Whitening of embeddings from an exact covariance: bit planes across rows, weighted AND-popcounts, eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.llm.common import small_batches, staged

#: An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries whose integer would lie beyond this bound can't be held as a long; their rows have no place.
LIMIT = float(1 << 61)
COMPONENTS = 16
#: Rows whose bit planes one task holds at a time, and words of planes that it combines at a time.
BLOCK_ROWS, STEP_WORDS = 32_768, 1 << 19
#: Bits of a limb: sums of exact integers travel as limbs, whose totals fit a long.
LIMB = 32


@dataclass(frozen=True)
class Whitening:
    """A fit over `n` distinct vectors: y = x - low, sums of y, components (dim x m), eigenvalues, shares of the trace."""

    dim: int
    n: int
    low: tuple[int, ...]
    high: tuple[int, ...]
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """n * x - sum for each row and dimension as doubles (exact below 2^53), and the exact sums of their squares."""
        reach = [max(s, self.n * (b - a) - s, 1) for a, b, s in zip(self.low, self.high, self.sums, strict=True)]
        y = x - np.array(self.low, np.int64)
        if max(self.n * (b - a) for a, b in zip(self.low, self.high, strict=True)) < 1 << 62 and sum(r * r for r in reach) < 1 << 63:
            d = self.n * y - np.array(self.sums, np.int64)
            return d.astype(np.float64), (d * d).sum(axis=1)
        d = y.astype(object) * self.n - np.array(self.sums, object)
        return d.astype(np.float64), [int(v) for v in (d * d).sum(axis=1)] if len(d) else []

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return deviations @ (self.components / (self.n * np.sqrt(self.eigenvalues)))


def _pack(vectors: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows with finite entries only as (vec_id, dim, q): a byte width and the integers below SHIFT in that width.

    The width is the least that holds the row, so equal vectors have equal bytes.
    """
    sizes = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = np.append(0, np.cumsum(~(np.abs(scaled) < LIMIT)))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    fine = (sizes > 0) & (bad[ends] == bad[starts])
    for dim in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == dim))
        whole = scaled[starts[rows, None] + np.arange(dim)].astype(np.int64)
        top = np.maximum(whole.max(axis=1), -1 - whole.min(axis=1))
        width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            cells = np.empty((len(at), 1 + dim * w), np.uint8)
            cells[:, 0] = w
            cells[:, 1:] = whole[at].astype(f"<i{w}").view(np.uint8).reshape(len(at), dim * w)
            q = pa.Array.from_buffers(pa.binary(1 + int(dim * w)), len(at), [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
            yield pa.record_batch({"vec_id": ids.take(pa.array(rows[at])), "dim": pa.array(np.full(len(at), dim, np.int32)), "q": q})


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _pack(batch.column("vec"), batch.column("vec_id"))


def unpack(q: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers below SHIFT as an int64 matrix), for each width in the column."""
    if not len(q):
        return
    q = q.cast(pa.large_binary())
    offsets = np.frombuffer(q.buffers()[1], np.int64)[q.offset : q.offset + len(q) + 1]
    data = np.frombuffer(q.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows, w = np.flatnonzero(sizes == size), int(size - 1) // dim
        cells = data[offsets[rows, None] + 1 + np.arange(dim * w)]
        yield rows, np.ascontiguousarray(cells).view(f"<i{w}").astype(np.int64)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, least and greatest integer of each dimension, by length of the vectors."""
    seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for rows, x in unpack(part.column("q"), dim):
                n, low, high = seen.get(dim, (0, x[0], x[0]))
                seen[dim] = n + len(rows), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    for dim, (n, low, high) in seen.items():
        yield pa.record_batch(
            {"dim": pa.array(np.full(dim, dim, np.int32)), "j": pa.array(np.arange(dim, dtype=np.int32)), "n": pa.array(np.full(dim, n)), "low": pa.array(low), "high": pa.array(high)}
        )


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers, dimension by dimension from the lowest bit: one row of 64-bit words for each."""
    words = -(-len(y) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for j, n in enumerate(bits):
        column = np.ascontiguousarray(y[:, j])
        for b in range(n):
            packed = np.packbits((column >> b) & 1 == 1)
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def and_counts(p: np.ndarray, into: np.ndarray) -> None:
    """Add the popcounts of every plane ANDed with itself and each later one to the upper triangle of `into`."""
    for i in range(len(p)):
        step = max(1, STEP_WORDS // max(1, p.shape[1]))
        for k in range(i, len(p), step):
            into[i, k : k + step] += np.bitwise_count(p[k : k + step] & p[i]).sum(axis=1, dtype=np.int64)


def _limbs(j: int, k: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    limb = 0
    while value:
        yield j, k, limb, value & ((1 << LIMB) - 1)
        value, limb = value >> LIMB, limb + 1


def weighted(counts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Cross-products of all dimensions from the counts of their planes' ANDs, as exact integers."""
    full = np.triu(counts) + np.triu(counts, 1).T
    powers = np.array([1 << b for n in bits for b in range(n)], object)
    used = np.flatnonzero(bits)
    out = np.zeros((len(bits), len(bits)), object)
    if len(used):
        first = (np.cumsum(bits) - bits)[used]
        products = full.astype(object) * powers[:, None] * powers[None, :]
        out[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(products, first, axis=0), first, axis=1)
    return out


def _scatter(dim: int, low: tuple[int, ...], high: tuple[int, ...]):
    """Row count, sums and cross-products of y = x - low over a partition, as limbs."""
    bits = np.array([(b - a).bit_length() for a, b in zip(low, high, strict=True)], np.int64)
    first = np.cumsum(bits) - bits
    base = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, counts = 0, [], np.zeros((int(bits.sum()), int(bits.sum())), np.int64)

        def work(blocks: list[np.ndarray]) -> None:
            y = np.concatenate(blocks)
            for at in range(0, len(y), BLOCK_ROWS):
                and_counts(planes(y[at : at + BLOCK_ROWS], bits), counts)

        for batch in batches:
            for rows, x in unpack(batch.column("q"), dim):
                held.append(x - base)
                n += len(rows)
            if sum(map(len, held)) >= BLOCK_ROWS:
                work(held)
                held = []
        if held:
            work(held)
        if not n:
            return
        found = list(_limbs(-1, -1, n))
        for j in range(dim):
            planes_of = range(int(first[j]), int(first[j] + bits[j]))
            found += _limbs(j, -1, sum(int(counts[i, i]) << (i - int(first[j])) for i in planes_of))
        products = weighted(counts, bits)
        for j in range(dim):
            for k in range(j, dim):
                found += _limbs(j, k, int(products[j, k]))
        j, k, limb, v = (np.array(c, np.int64) for c in zip(*found, strict=True))
        yield pa.record_batch({"j": pa.array(j.astype(np.int32)), "k": pa.array(k.astype(np.int32)), "limb": pa.array(limb.astype(np.int32)), "v": pa.array(v)})

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, q) of the rows whose vector is not null or empty and has finite entries only; written once."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("dim", T.IntegerType()), T.StructField("q", T.BinaryType())])
    return staged(rows.mapInArrow(_quantise, schema), "quantised")


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of `rows` (as of `quantised`), and the list it is fitted to: each distinct vector once.

    Cross-products come from the popcounts of ANDed bit planes (the integers shifted by each dimension's least one, so
    that there are few planes), are centred as integers, n Q - S S', and only then become doubles for `eigh`. What comes
    to the driver is a matrix of dim x dim, whatever the number of rows. Vectors of another than the most frequent
    length (the longer one of two) have no place. Eigenvalues that are zero to double precision give no component.
    None if there is no vector.
    """
    lengths = staged(rows.mapInArrow(_ranges, "dim int, j int, n long, low long, high long").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    chosen = lengths.orderBy(F.desc("n"), F.desc("dim")).select("dim").first()
    if chosen is None:
        return None
    dim = chosen[0]
    limits = sorted(lengths.filter(F.col("dim") == dim).select("j", "low", "high").collect())
    low, high = tuple(r[1] for r in limits), tuple(r[2] for r in limits)
    distinct = staged(rows.filter(F.col("dim") == dim).select("q").distinct(), "distinct")
    parts = distinct.mapInArrow(_scatter(dim, low, high), "j int, k int, limb int, v long")
    totals: dict[tuple[int, int], int] = {}
    for j, k, limb, v in parts.groupBy("j", "k", "limb").agg(F.sum("v")).collect():
        totals[j, k] = totals.get((j, k), 0) + (v << (LIMB * limb))
    n = totals[-1, -1]
    sums = [totals.get((j, -1), 0) for j in range(dim)]
    centred = [[n * totals.get((min(j, k), max(j, k)), 0) - sums[j] * sums[k] for k in range(dim)] for j in range(dim)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    rank = int((values > max(values[0], 0.0) * dim * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    m = min(components, rank)
    vectors = vectors[:, :m] * np.where(np.take_along_axis(vectors[:, :m], np.abs(vectors[:, :m]).argmax(axis=0)[None], 0) < 0, -1.0, 1.0) if m else vectors[:, :0]
    trace = sum(centred[j][j] for j in range(dim)) / (n * n)
    share = values[:m] / trace if m else values[:0]
    return Whitening(dim, n, low, high, tuple(sums), np.ascontiguousarray(vectors), values[:m], share), distinct


def _moments(model: Whitening):
    """Sums and cross-products of the whitened values of a partition's distinct vectors, by pairs of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.eigenvalues)
        one, two = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for _, x in unpack(batch.column("q"), model.dim):
                z = model.project(model.deviations(x)[0])
                one += z.sum(axis=0)
                two += z.T @ z
        i, k = np.divmod(np.arange(m * m), max(m, 1))
        yield pa.record_batch(
            {"i": pa.array(np.append(i, np.arange(m)).astype(np.int32)), "k": pa.array(np.append(k, np.full(m, -1)).astype(np.int32)), "v": pa.array(np.append(two.ravel(), one))}
        )

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened list's covariance minus the identity; 0 without components."""
    m = len(model.eigenvalues)
    sums = distinct.mapInArrow(_moments(model), "i int, k int, v double").groupBy("i", "k").agg(F.sum("v")).collect()
    found = {(i, k): v / model.n for i, k, v in sums}
    # The deviations are centred before they are projected, so the means are zero but for rounding.
    errors = [abs(found[i, k] - found[i, -1] * found[k, -1] - (i == k)) for i in range(m) for k in range(m)]
    return float(max(errors, default=0.0))


def _whiten(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.eigenvalues)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for rows, x in unpack(batch.column("q"), model.dim):
                    d, squares = model.deviations(x)
                    exact = [int(v) for v in squares]
                    long = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                    take = pa.array(np.repeat(np.arange(len(rows)), m))
                    yield pa.record_batch(
                        {
                            "vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, m))),
                            "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                            "n": pa.array(np.full(len(rows) * m, model.n)),
                            "deviation": long.take(take),
                            "whitened": pa.array(model.project(d).ravel()),
                            "explained": pa.array(np.tile(model.explained, len(rows))),
                            "identity_error": pa.array(np.full(len(rows) * m, error)),
                            "deviation_digits": pa.array([str(v) for v in exact], pa.string()).take(take),
                        }
                    )

    return run


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: one row for each vector and component.

    Rows whose vector is null or empty, holds null or non-finite entries, entries beyond LIMIT / SCALE or has another
    than the most frequent length are dropped. The rest become integers, floor(SCALE * c) + SHIFT; each distinct integer vector
    counts once in the fit, however many rows have it. `deviation` is exact; where it exceeds a long it is null, and
    `deviation_digits` holds it in decimal digits either way.

    Null and repeated ids each give their rows; other columns are ignored. There are fewer than `components` components
    where the covariance has a lower rank: none, and so no rows, for an empty table or a single distinct vector.
    """
    with small_batches(vectors.sparkSession):
        rows = quantised(vectors, id_col, vec_col)
        fitted = fit(rows, components)
        schema = T.StructType(
            [
                rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
                T.StructField("deviation_digits", T.StringType()),
            ]
        )
        if fitted is None:
            return vectors.sparkSession.createDataFrame([], schema)
        model, distinct = fitted
        error = identity_error(distinct, model)
    return rows.filter(F.col("dim") == model.dim).mapInArrow(_whiten(model, error), schema)
