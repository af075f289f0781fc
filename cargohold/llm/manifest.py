"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, proofs by octopus multiproofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import broadcast_if, staged

#: Children of a node, as a power of two.
ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
#: Levels that one pass folds: a block of ARITY ** FOLD consecutive nodes is one group.
FOLD = 2
#: Consecutive leaves for which one multiproof is fetched.
PART_LEAVES = 10_000
#: The number of the tree whose leaves are the sources' roots; those of the sources count from 0.
TOP = -1
#: Coordinates to fetch that may be broadcast; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(parts: list[bytes]) -> bytes:
    """Lower-case hex sha256 of hex digests one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(text: Column, rest: list[Column]) -> Column:
    """Hex sha256 of a row's fields: `-` for null, else byte count, colon, value."""
    values = [c.cast("string") for c in (*rest, text)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, altered): each row's digest, and that of its altered form where the id's crc32 is a multiple of 5."""
    rest = [F.col(c) for c in FIELDS[:-1]]
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest(lower, rest))
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(text, rest).alias("leaf"), altered.alias("altered"))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows sorted by source: p (partition), i (place in it), s (which of its sources), j (place in that one)."""
    part, i, s, j, last = TaskContext.get().partitionId(), 0, 0, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        source = batch.column("source")
        fresh = np.ones(n, bool)
        same = pc.fill_null(pc.equal(source[1:], source[:-1]), False).to_numpy(zero_copy_only=False)
        null = source.is_null().to_numpy(zero_copy_only=False)
        fresh[1:] = ~(same | (null[1:] & null[:-1]))
        fresh[0] = last is None or last[0] != source[0].as_py()
        nth = s + np.cumsum(fresh) - (last is None)
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        place = np.where(heads >= 0, np.arange(n) - heads, np.arange(n) + j)
        yield pa.record_batch(
            {
                "p": pa.array(np.full(n, part, np.int32)), "i": pa.array(np.arange(i, i + n)), "s": pa.array(nth), "j": pa.array(place),
                **{c: batch.column(c) for c in ("doc_id", "source", "leaf", "altered")},
            }
        )
        i, s, j, last = i + n, int(nth[-1]), int(place[-1]) + 1, (source[n - 1].as_py(),)


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, tree, rank, doc_id, leaf, altered), and (tree, n): every leaf's place in its source's tree.

    Rows are sorted over ranges, so that a source is never one task; ties in doc_id follow the digest. Each partition
    starts where those before it end: one row for each Spark partition goes to the driver, none for documents or sources.
    """
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("source", "doc_id", "leaf").sortWithinPartitions("source", "doc_id", "leaf")
    placed = staged(ordered.mapInArrow(_place, f"p int, i long, s long, j long, doc_id {kind}, source string, leaf string, altered string"), "placed")
    parts = staged(placed.groupBy("p", "s", "source").agg(F.count("*").alias("n")), "segments")
    ends = lambda f: f(F.struct("source", "n"), "s")
    summary = parts.groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("k"), ends(F.min_by).alias("first"), ends(F.max_by).alias("last"))
    at, trees, last, carried, offsets = 0, 0, None, 0, []
    for r in sorted(summary.collect(), key=lambda r: r["p"]):
        goes_on = last is not None and last[0] == r["first"]["source"]
        offsets.append((r["p"], at, trees - goes_on, carried if goes_on else 0))
        at, trees = at + r["n"], trees - goes_on + r["k"]
        carried = r["last"]["n"] + (carried if goes_on and r["k"] == 1 else 0)
        last = (r["last"]["source"],)
    known = F.broadcast(spark.createDataFrame(offsets, "p int, at long, ahead long, carried long"))
    tree = (F.col("ahead") + F.col("s")).alias("tree")
    rank = F.col("j") + F.when(F.col("s") == 0, F.col("carried")).otherwise(0)
    part = F.floor((F.col("at") + F.col("i")) / PART_LEAVES)
    found = placed.join(known, "p").select(part.alias("part"), tree, rank.alias("rank"), "doc_id", "leaf", "altered")
    sizes = parts.join(known, "p").select(tree, "n").groupBy("tree").agg(F.sum("n").alias("n"))
    return found, staged(sizes, "trees")


def fold(level: list[bytes]) -> list[bytes]:
    return [_hash(level[k : k + ARITY]) for k in range(0, len(level), ARITY)]


def _fold(below: int):
    """Nodes of the next FOLD levels from rows sorted by (tree, block, idx). Block 0 stops at a tree's only node."""

    def up(tree: int, block: int, digests: list[bytes]) -> Iterator[tuple[int, int, int, str]]:
        for k in range(1, FOLD + 1):
            if block == 0 and len(digests) == 1:
                return
            digests = fold(digests)
            first = block << (ARITY_BITS * (FOLD - k))
            yield from ((tree, below + k, first + x, d.decode()) for x, d in enumerate(digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            found = []
            for tree, block, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "digest")), strict=True):
                if group != (tree, block):
                    if held:
                        found += up(*group, held)
                    group, held = (tree, block), []
                held.append(digest.encode())
            yield _nodes(found)
        if held:
            yield _nodes(list(up(*group, held)))

    return run


def _nodes(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    tree, level, idx, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch({"tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()), "digest": pa.array(digest, pa.string())})


def interior(level0: DataFrame, largest: int) -> list[DataFrame]:
    """All nodes above `level0` (tree, idx, digest), as tables (tree, level, idx, digest); `largest` is the largest tree's size."""
    found, now, below = [], level0, 0
    while largest > 1:
        block = now.select("tree", F.expr(f"idx >> {ARITY_BITS * FOLD}").alias("block"), "idx", "digest")
        dealt = block.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        found.append(staged(dealt.mapInArrow(_fold(below), "tree long, level int, idx long, digest string"), "nodes"))
        below += FOLD
        now = found[-1].filter(F.col("level") == below)
        largest = -(-largest // (1 << (ARITY_BITS * FOLD)))
    return found


def _height(n: Column) -> Column:
    """Levels above a tree's leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x * ARITY_BITS) < n))


def missing(ranges: DataFrame) -> DataFrame:
    """(part, tree, level, idx): the least set of nodes that lets a partition prove each of its leaves.

    `ranges` has the first and last leaf of each partition in each tree and the tree's size (part, tree, lo, hi, n).
    On each level the nodes over the partition's leaves are known; of the runs at both ends the others are missing.
    All proofs of the partition share them, and what lies between is derived.
    """
    by_level = ranges.select("part", "tree", "lo", "hi", "n", F.explode(F.sequence(F.lit(0), _height(F.col("n")) - 1)).alias("level"))
    width = f"(level * {ARITY_BITS})"
    at = by_level.select(
        "part", "tree", F.col("level").cast("int").alias("level"), F.expr(f"lo >> {width}").alias("a"), F.expr(f"hi >> {width}").alias("b"),
        F.expr(f"((n - 1) >> {width})").alias("end"),
    )
    left = F.expr(f"sequence((a >> {ARITY_BITS}) << {ARITY_BITS}, a)")
    right = F.expr(f"sequence(b, least(end, ((b >> {ARITY_BITS}) << {ARITY_BITS}) + {ARITY - 1}))")
    beside = F.filter(F.concat(left, right), lambda x: (x < F.col("a")) | (x > F.col("b")))
    return at.select("part", "tree", "level", F.explode(beside).alias("idx"))


def _expand(kind: str):
    """Proofs of each leaf from a partition's leaves and the nodes fetched for it; rows sorted by (part, step, tree, idx)."""

    def prove(sizes: dict[int, int], nodes: dict[tuple[int, int], dict[int, bytes]], rows: list[tuple]) -> Iterator[tuple]:
        own: dict[int, list[tuple]] = {}
        for r in rows:
            own.setdefault(r[0], []).append(r)

        def climb(tree: int, known: list[int]) -> tuple[list[dict[int, bytes]], bytes]:
            """All nodes over `known` leaves, derived once for all of them, and the tree's root."""
            levels, level, size = [nodes[tree, 0]], 0, sizes[tree]
            while size > 1:
                here, above = levels[-1], nodes.setdefault((tree, level + 1), {})
                size, runs = -(-size // ARITY), sorted({k >> ARITY_BITS for k in known})
                end = sizes[tree] - 1 >> (ARITY_BITS * level)
                for run in runs:
                    first = run << ARITY_BITS
                    above[run] = _hash([here[k] for k in range(first, min(first + ARITY - 1, end) + 1)])
                known, level = runs, level + 1
                levels.append(above)
            return levels, levels[-1][0]

        def beside(levels: list[dict[int, bytes]], tree: int, k: int) -> list[tuple[bytes, bytes]]:
            """The siblings left and right of leaf k, level by level."""
            out = []
            for level, here in enumerate(levels[:-1]):
                at, end = k >> (ARITY_BITS * level), sizes[tree] - 1 >> (ARITY_BITS * level)
                first = at >> ARITY_BITS << ARITY_BITS
                out.append((b"".join(here[x] for x in range(first, at)), b"".join(here[x] for x in range(at + 1, min(first + ARITY - 1, end) + 1))))
            return out

        trees, roots = {}, {}
        for tree, mine in own.items():
            nodes.setdefault((tree, 0), {}).update((r[1], r[3]) for r in mine)
            trees[tree], roots[tree] = climb(tree, [r[1] for r in mine])
        top = nodes.setdefault((TOP, 0), {})
        top.update(roots)
        over, root = climb(TOP, list(roots))
        for tree, mine in own.items():
            upper: dict[int, list[tuple[bytes, bytes]]] = {}
            on_top = beside(over, TOP, tree)
            for _, k, doc, leaf, altered in mine:
                run = k >> ARITY_BITS
                if run not in upper:
                    upper[run] = beside(trees[tree], tree, k)[1:] + on_top
                siblings = beside(trees[tree][:2], tree, k) + upper[run] if len(trees[tree]) > 1 else on_top
                folded = reduce(lambda d, side: hashlib.sha256(side[0] + d + side[1]).hexdigest().encode(), siblings, altered or leaf)
                proof = hashlib.sha256(b"".join(left + right for left, right in siblings)).hexdigest()
                yield doc, leaf.decode(), roots[tree].decode(), root.decode(), proof, folded.decode(), folded == root

    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None

        def done() -> pa.RecordBatch:
            columns = list(zip(*prove(sizes, nodes, rows), strict=True)) or [()] * len(names)
            types = [ids, *[pa.string()] * 5, pa.bool_()]
            return pa.record_batch({c: pa.array(v, t) for c, v, t in zip(names, columns, types, strict=True)})

        part, sizes, nodes, rows = None, {}, {}, []
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("part", "step", "tree", "level", "idx", "doc_id", "leaf", "altered")]
            for p, step, tree, level, idx, doc, leaf, altered in zip(*columns, strict=True):
                if p != part:
                    if rows:
                        yield done()
                    part, sizes, nodes, rows = p, {}, {}, []
                if step == 0:
                    sizes[tree] = idx
                elif step == 1:
                    nodes.setdefault((tree, level), {})[idx] = leaf.encode()
                else:
                    rows.append((tree, idx, doc, leaf.encode(), altered.encode() if altered is not None else None))
        if rows:
            yield done()

    return run


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of `docs`.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The leaves of a source ascend by doc_id and fold,
    ARITY at a time, to the source's subroot; the subroots, ordered by source, fold to the root. `folded_root` is what a
    leaf and its proof give: for rows whose id's crc32 is a multiple of 5, the leaf of a text with A-Z lower-cased.

    Every PART_LEAVES consecutive leaves are a partition with one multiproof: the nodes that its proofs need beyond its
    own leaves (at most 30 for each level of a tree whose ends it holds), each fetched once. Interior nodes over its
    leaves are derived in place and shared, and every single proof is expanded from both. Folding reads blocks of
    ARITY ** FOLD nodes, so neither a large source nor the upper levels meet in one task.

    Nulls in any column count as such in the digest; a null source is the first one, a null id the first of its source
    and never altered. Rows that repeat an id stand side by side, by digest; each gives a row. An empty table gives no
    rows. Texts are digested whole; columns beyond the five are ignored.
    """
    spark = docs.sparkSession
    rows, trees = ranked(staged(leaves(docs), "leaves"))
    count, largest = trees.agg(F.count("*"), F.max("n")).first()
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not count:
        return spark.createDataFrame([], names)
    level0 = rows.select("tree", F.col("rank").alias("idx"), F.col("leaf").alias("digest"))
    inner = interior(level0, largest)
    ends = reduce(DataFrame.union, [n.filter("idx = 0") for n in inner], level0.filter("idx = 0").select("tree", F.lit(0).alias("level"), "idx", "digest"))
    subroots = staged(ends.groupBy("tree").agg(F.max_by("digest", "level").alias("digest")).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), "subroots")
    upper = interior(subroots, count)

    held = rows.groupBy("part", "tree").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).join(trees, "tree")
    over = held.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi"))
    over = over.select("part", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", F.lit(count).alias("n"))
    ranges = staged(held.select("part", "tree", "lo", "hi", "n").union(over), "ranges")
    needed = staged(missing(ranges.filter("n > 1")), "missing")
    needed = broadcast_if(needed, BROADCAST_NODES)
    zero = lambda df: df.select("tree", F.lit(0).alias("level"), "idx", "digest")
    stored = reduce(DataFrame.union, [*inner, *upper, zero(subroots), zero(level0)])
    fetched = stored.join(needed, ["tree", "level", "idx"])

    none = F.lit(None)
    header = ranges.select("part", F.lit(0).alias("step"), "tree", F.lit(0).alias("level"), F.col("n").alias("idx"), none.cast(kind).alias("doc_id"), none.cast("string").alias("leaf"), none.cast("string").alias("altered"))
    nodes = fetched.select("part", F.lit(1), "tree", "level", "idx", none.cast(kind), "digest", none.cast("string"))
    own = rows.select("part", F.lit(2), "tree", F.lit(0), F.col("rank"), "doc_id", "leaf", "altered")
    dealt = header.union(nodes).union(own).repartition("part").sortWithinPartitions("part", "step", "tree", "idx")
    return dealt.mapInArrow(_expand(kind), names)
