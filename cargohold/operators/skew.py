"""Cut very large groups into order-contiguous slices.

A window over a key puts all rows of the key into one task. `slice_hot_keys` finds the few keys that
are too large for that and gives their rows a slice number that rises with the order columns, so a
window over (key, slice) stays bounded. What has to cross a slice border (a running total, the row
before) is carried by one summary row a slice, a table with about a row for every `max_rows` rows.

Cut points are computed once and become literals of the plan, so every branch of a query sees the
same slices. They only decide balance; any cut points give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES_PER_SLICE = 100
#: A key with very many slices is sampled more thinly: about this many rows in all, but LEAST_SAMPLES for each slice.
SAMPLES_PER_KEY, LEAST_SAMPLES = 200_000, 8
#: Cut points in one node of the search tree, which every row of a cut key carries while it is placed.
FAN_OUT = 64


@dataclass(frozen=True)
class SkewPolicy:
    """`max_rows`: the largest group kept whole, and about the size of a slice of a larger one."""

    max_rows: int = 2_000_000


DEFAULT_POLICY = SkewPolicy()


@dataclass(frozen=True)
class Sliced:
    """Rows with `_slice` (0 for ordinary keys) and `_hot`; `keys` and `order_by` as given."""

    df: DataFrame
    keys: list[str]
    order_by: list[str]
    sliced: bool

    def window(self) -> WindowSpec:
        groups = [*self.keys, "_slice"] if self.sliced else self.keys
        return Window.partitionBy(*groups).orderBy(*self.order_by)

    def position(self) -> Column:
        return F.struct(*self.order_by)

    def summaries(self, *aggregates: Column) -> DataFrame:
        """One row for each slice of the cut keys."""
        return self.df.filter("_hot").groupBy(*self.keys, "_slice").agg(*aggregates)

    def attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Left join with a summary of about one row for every `max_rows` rows; Spark broadcasts it only if it is small."""
        renamed = summary.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
            F.col("_slice").alias("_s"),
            *[c for c in summary.columns if c not in (*self.keys, "_slice")],
        )
        same = F.col("_slice") == F.col("_s")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = df.join(renamed, same, "left")
        return joined.drop("_s", *[f"_k{i}" for i in range(len(self.keys))])


def _hot_keys(df: DataFrame, keys: list[str], policy: SkewPolicy) -> list:
    """All groups over the limit: at most rows / max_rows of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > policy.max_rows).collect()


def _cut_points(df: DataFrame, keys: list[str], order_by: list[str], hot: list, max_rows: int) -> tuple[list, T.StructType]:
    """Sampled, evenly spaced order positions for every hot key, about rows / max_rows in all; rows and their schema."""
    spark = df.sparkSession
    fields = [df.schema[k] for k in keys]
    fields += [T.StructField("_pieces", T.LongType()), T.StructField("_fraction", T.DoubleType())]
    rows = []
    for row in hot:
        pieces = max(2, -(-row["_n"] // max_rows))
        wanted = max(LEAST_SAMPLES * pieces, min(SAMPLES_PER_SLICE * pieces, SAMPLES_PER_KEY))
        rows.append((*[row[k] for k in keys], pieces, min(1.0, wanted / row["_n"])))
    wanted = spark.createDataFrame(rows, T.StructType(fields))
    narrow = df.select(*keys, F.struct(*order_by).alias("_at"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    renamed = wanted.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_pieces", "_fraction"
    )
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    # About a hundred rows for every slice, fewer for a key with thousands of them.
    sample = narrow.join(F.broadcast(renamed), condition).filter(F.rand(7) < F.col("_fraction"))
    by_key = Window.partitionBy(*keys)
    ranked = sample.select(
        *keys,
        "_at",
        "_pieces",
        F.row_number().over(by_key.orderBy("_at")).alias("_rn"),
        F.count(F.lit(1)).over(by_key).alias("_seen"),
    )
    step = F.floor(F.col("_rn") * F.col("_pieces") / F.col("_seen"))
    before = F.floor((F.col("_rn") - 1) * F.col("_pieces") / F.col("_seen"))
    cuts = ranked.filter((step > before) & (F.col("_rn") < F.col("_seen")))
    grouped = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    return grouped.collect(), grouped.schema


def _place(df: DataFrame, keys: list[str], at: Column, cuts: list, schema: T.StructType) -> DataFrame:
    """Add `_slice`, how many cut points of the key are at or before `at`, and `_hot`.

    A search tree over the sorted cut points: on each level a row meets one node of at most FAN_OUT of them, so what a row
    carries does not grow with the number of slices. The n-th node of a level holds, from the level below, the first
    cut point of every node but the leftmost.
    """
    kept = df.columns
    node = T.StructType([*schema.fields[: len(keys)], T.StructField("_node", T.LongType()), schema["_cuts"]])
    level = {tuple(row[k] for k in keys): row["_cuts"] for row in cuts}
    levels = []
    while level:
        nodes = [(*key, i // FAN_OUT, at_key[i : i + FAN_OUT]) for key, at_key in level.items() for i in range(0, len(at_key), FAN_OUT)]
        levels.append(df.sparkSession.createDataFrame(nodes, node))
        level = {key: at_key[FAN_OUT::FAN_OUT] for key, at_key in level.items() if len(at_key) > FAN_OUT}
    out = df.withColumn("_slice", F.lit(0).cast("bigint")).withColumn("_hot", F.lit(False))
    for nodes in reversed(levels):
        renamed = nodes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_node", "_cuts")
        same = F.col("_slice") == F.col("_node")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        # A key that has no node here has few cut points, all in the leftmost node below.
        found = F.when(F.col("_cuts").isNull(), F.col("_slice")).otherwise(F.col("_slice") * FAN_OUT + _at_or_before(F.col("_cuts"), at))
        joined = out.join(F.broadcast(renamed), same, "left")
        out = joined.select(*kept, found.alias("_slice"), F.col("_cuts").isNotNull().alias("_hot"))
    return out.withColumn("_slice", F.col("_slice").cast("int"))


def _at_or_before(cuts: Column, value: Column) -> Column:
    """How many of at most FAN_OUT sorted cut points are at or before `value`: binary search."""
    steps = [1 << i for i in reversed(range(FAN_OUT.bit_length()))]

    def advance(found: Column, step: Column) -> Column:
        probe = found + step
        inside = probe <= F.size(cuts)
        return F.when(inside & (F.get(cuts, probe - 1) <= value), probe).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def slice_hot_keys(
    df: DataFrame, keys: list[str], order_by: list[str], policy: SkewPolicy = DEFAULT_POLICY
) -> Sliced:
    """Add `_slice` and `_hot`. Without keys the whole input is one ordered group.

    Counts rows per key first, on the key columns; groups over `policy.max_rows` are cut, whatever the input's size.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    whole = df.withColumn("_slice", F.lit(0)).withColumn("_hot", F.lit(False))
    hot = _hot_keys(df, keys, policy)
    if not hot:
        return Sliced(whole, keys, order_by, False)
    cuts, schema = _cut_points(df, keys, order_by, hot, policy.max_rows)
    return Sliced(_place(df, keys, F.struct(*order_by), cuts, schema), keys, order_by, True)


def running_sums(
    s: Sliced, df: DataFrame, values: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add running totals over (keys, order): within the slice, plus the totals of the slices before."""
    frame = s.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.select(
        *df.columns, *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(name) for name, v in values.items()]
    )
    if not s.sliced:
        return out
    totals = df.filter("_hot").groupBy(*s.keys, "_slice").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*s.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*s.keys, "_slice", *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values])
    joined = s.attach(out, carried)
    return joined.select(
        *df.columns, *[(F.col(n) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in values]
    )
