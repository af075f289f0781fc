"""Deal requests out by what they will cost: even partitions under the limits of each host and of the whole."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargohold.functions.paths import url_host

#: What a request costs beside its body, in bytes.
REQUEST_BYTES = 64 * 1024
#: A host is placed by its size if it has more than 1 / HEAVY of a partition's share of all bytes; others by hash.
HEAVY = 4
#: Requests of a host that are ranked together.
BUCKET_ROWS = 20_000


def place_hosts(sizes: Sequence[tuple[str | None, int]], total_bytes: int, places: int, most: int) -> dict[str | None, list[int]]:
    """The partitions of each host, at most `most`: largest shares first, each on the least loaded partitions."""
    share = max(1.0, total_bytes / places)
    cuts = {host: min(most, places, max(1, -int(-HEAVY * size // share))) for host, size in sizes}
    loads = [((total_bytes - sum(s for _, s in sizes)) / places, i) for i in range(places)]
    heapq.heapify(loads)
    placed = {}
    for host, size in sorted(sizes, key=lambda r: (-r[1] / cuts[r[0]], r[0] or "")):
        chosen = [heapq.heappop(loads) for _ in range(cuts[host])]
        placed[host] = [i for _, i in chosen]
        for load, i in chosen:
            heapq.heappush(loads, (load + size / cuts[host], i))
    return placed


def schedule(df: DataFrame, url: str, expected: Column, per_host: int, total: int, threads: int = 1) -> DataFrame:
    """`df` in `total / threads` partitions that are even in expected bytes, the largest requests of each first.

    The rows of a host lie in at most `per_host / threads` partitions. Heavy hosts (at most HEAVY for each partition, so
    their table is small) are packed largest first onto the least loaded partitions; their rows are dealt by size, back and forth, in
    buckets that keep a large host out of one task. A light host is one partition. `expected` may be NULL. The input is
    read three times: put a `spool` in front of an expensive one.
    """
    places, most = max(1, total // threads), max(1, per_host // threads)
    cost = F.greatest(F.coalesce(expected.cast("long"), F.lit(0)), F.lit(0)) + REQUEST_BYTES
    sized = df.select("*", url_host(F.col(url)).alias("_host"), cost.alias("_cost"))
    hosts = sized.groupBy("_host").agg(F.sum("_cost").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = hosts.agg(F.sum("bytes")).first()[0] or 0
    heavy = hosts.filter(F.col("bytes") * (HEAVY * places) > whole).collect()
    placed = place_hosts([(r["_host"], r["bytes"]) for r in heavy], whole, places, most)
    rows = [(r["_host"], placed[r["_host"]], max(1, r["n"] // BUCKET_ROWS)) for r in heavy]
    plan = F.broadcast(df.sparkSession.createDataFrame(rows, "_h string, _places array<int>, _buckets bigint"))
    same = F.col("_host").eqNullSafe(F.col("_h"))
    bucket = F.pmod(F.xxhash64(url), F.col("_buckets"))
    known = sized.join(plan, same).withColumn("_bucket", bucket)
    nth = F.row_number().over(Window.partitionBy("_host", "_bucket").orderBy(F.desc("_cost"), url)) - 1 + F.col("_bucket")
    turn = F.pmod(nth, 2 * F.size("_places"))
    slot = F.least(turn, 2 * F.size("_places") - 1 - turn)
    dealt = known.select(*df.columns, "_cost", F.get("_places", slot.cast("int")).alias("_place"))
    light = sized.join(plan, same, "left_anti").select(*df.columns, "_cost", F.pmod(F.xxhash64("_host"), F.lit(places)).cast("int").alias("_place"))
    out = dealt.union(light).repartitionById(places, "_place").sortWithinPartitions(F.desc("_cost"))
    return out.select(*df.columns)
