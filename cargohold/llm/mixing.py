"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import WORD, broadcast_if, staged

#: The share of all words that the mix holds; weights by place of the source, repeating; the most often a document is taken.
RATIO, WEIGHTS, REPEATS = 1.5, (3, 1, 2), 2
#: Documents of one source that are summed up in one window partition (about; ids are dealt by hash).
BUCKET_ROWS = 2000
#: Bins of one look at the finish times, and the entries around the budget that may come to the driver.
BINS, LAST_ENTRIES = 1024, 10_000
#: Places in the mix that may be broadcast to the documents; with more the texts are shuffled to them.
BROADCAST_PLACES = 1_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of `total` by weight; a share stops at `repeats` times its size and the excess is shared again."""
    result, fixed = [0.0] * len(sizes), [n == 0 for n in sizes]
    while not all(fixed):
        free = [i for i, done in enumerate(fixed) if not done]
        left = total - sum(result[i] for i in range(len(sizes)) if fixed[i])
        scale = left / sum(weights[i] for i in free)
        over = [i for i in free if scale * weights[i] > repeats * sizes[i]]
        for i in over or free:
            result[i], fixed[i] = (repeats * sizes[i] if over else scale * weights[i]), True
    return [float(x) for x in result]


def _cut(entries: DataFrame, budget: int) -> tuple[float, int, int, int, int] | None:
    """(finish, sid, copy, cum, words) of the entry with which the mix is full; none if all entries fit.

    The order is found by counting: histograms of words over ever narrower ranges of finish times, then the few
    entries in the last range. The driver sees BINS sums and LAST_ENTRIES rows.
    """
    total, low, high, n = entries.agg(F.sum("size"), F.min("finish"), F.max("finish"), F.count("*")).first()
    if not total or total <= budget:
        return None
    before = 0
    while n > LAST_ENTRIES and high > low:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1))
        inside = entries.filter(F.col("finish").between(low, high))
        bins = inside.groupBy(place.alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):
            if before + row["s"] >= budget:
                narrower = (row["lo"], row["hi"]) != (low, high)
                low, high, n = row["lo"], row["hi"], row["n"]
                break
            before += row["s"]
        if not narrower:
            break
    last = entries.filter(F.col("finish").between(low, high)).select("finish", "sid", "copy", "cum", "size")
    for row in sorted(map(tuple, last.collect())):
        if before + row[4] >= budget:
            return (*row[:4], budget - before)
        before += row[4]
    return None


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ratio: float = RATIO,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = 0,
    shuffle_by: Sequence[str] | None = None,
) -> DataFrame:
    """doc_id, size, source, source_size, target, finish and taken of each row of `docs`.

    A source's documents stand in a shuffled queue (by a hash of the id, or of the columns `shuffle_by`), the whole queue `repeats` times over. An
    entry's virtual finish time is the words of its source up to its end divided by the source's target. The mix
    takes entries by finish time, over all sources, until it holds `ratio` of all words; the last one is cut. `finish`
    is that of the first copy. Running sums are kept per source and hash range, with the ranges' totals before them,
    so no source is one task. To the driver come the totals of each source.

    Null texts have size 0, as have texts without words; these are taken 0 times (finish null). A null source is a
    source of its own, the last. Rows that repeat an id are queued one by one. Long texts are counted whole. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(c).cast("string") for c in shuffle_by or [id_col]], F.lit(seed)), 11)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), hashed.alias("h")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    sums = sorted((tuple(r) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    own = [weights[i % len(weights)] for i in range(len(sums))]
    total = sum(r[1] for r in sums)
    goal = targets([r[1] for r in sums], own, ratio * total, repeats)
    plan = [(r[0], i, int(r[1]), goal[i], max(1, r[2] // BUCKET_ROWS)) for i, r in enumerate(sums)]
    known = spark.createDataFrame(plan, "of string, sid int, source_size long, target double, buckets long")
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.floor(F.col("h") / float(1 << 53) * F.col("buckets")))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    before = staged(before.select("sid", "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead")), "ahead")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.join(before, ["sid", "bucket"]).withColumn("cum", F.col("ahead") + F.sum("size").over(inside))
    queue = staged(queue.select("doc_id", "source", "size", "source_size", "target", "sid", "cum"), "queue")
    finish = lambda copy: (F.col("cum") + copy * F.col("source_size")) / F.col("target")
    live = queue.filter("size > 0")
    entries = live.select("sid", "size", "cum", F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(repeats)])).alias("e"))
    cut = _cut(entries.select("sid", "size", "cum", "e.copy", "e.finish"), int(ratio * total))
    taken = F.lit(0).cast("long")
    for copy in range(repeats):
        place = F.struct(finish(copy).alias("finish"), F.col("sid").alias("sid"), F.lit(copy).alias("copy"), F.col("cum").alias("cum"))
        if cut is None:
            words = F.col("size")
        else:
            end = F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).alias("sid"), F.lit(cut[2]).alias("copy"), F.lit(cut[3]).cast("long").alias("cum"))
            words = F.when(place < end, F.col("size")).when(place == end, F.lit(cut[4]).cast("long")).otherwise(0)
        taken = taken + F.when(F.col("size") > 0, words).otherwise(0)
    return queue.select(
        "doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, finish(0)).alias("finish"), taken.cast("long").alias("taken")
    )


def sequence(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", repeats: int = REPEATS) -> DataFrame:
    """Rows of `docs` as the mix takes them: once for each copy, in the order of the finish times.

    `mix` is the result of `mixed` over the same rows. An entry that the budget cuts stays whole. Ids must be unique.
    """
    at = mix.filter("taken > 0").select(F.col("doc_id").alias("_id"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("_copy"), "finish", "source_size", "target")
    at = at.select("_id", (F.col("finish") + F.col("_copy") * F.col("source_size") / F.col("target")).alias("_finish"))
    found = docs.join(broadcast_if(staged(at, "places"), BROADCAST_PLACES), F.col(id_col) == F.col("_id"))
    return found.repartitionByRange("_finish").sortWithinPartitions("_finish").select(*[docs[c] for c in docs.columns])
