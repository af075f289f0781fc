"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import broadcast_if, small_enough, staged

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits in BLOCKS blocks. Two that differ in at most RADIUS bits differ in at most FLIPS bits of some block.
#: At SIMILARITY s the angle's cosine is 2s / (1 + s) or more, so a bit differs with a chance of 0.152: 9.7 bits, standard deviation 2.9.
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of the benchmark's side, or of flagged texts, that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
_MASKS = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(BLOCK_BITS), n)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(n: Column, k: Column | int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))


def shingles(w: Column, k: Column | int) -> Column:
    """The distinct k-word shingles as text."""
    return F.array_distinct(F.transform(_starts(F.size(w), k), lambda i: F.array_join(F.slice(w, i, k), " ")))


def simhash(parts: Column) -> Column:
    """64 bits; each shingle votes with the root of its length on every bit of its hash, so that cosines follow weighted Jaccard."""
    votes = F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("h"), F.round(F.sqrt(F.length(x)) * 1000).cast("int").alias("c")))

    def bits(v: Column) -> Column:
        def bit(b: Column) -> Column:
            sign = lambda s, x: s + F.when(F.call_function("getbit", x["h"], b) == 1, x["c"]).otherwise(-x["c"])
            return F.aggregate(v, F.lit(0), sign) > 0

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda acc, b: acc.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        )

    return F.get(F.transform(F.array(votes), bits), F.lit(0))  # the votes are made once, not for every bit


def _block(fp: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, j * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def contaminated_windows(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """(text_hash, item_id, start_word, similarity) of every window that holds an item; text_hash is xxhash64 of the text.

    A window has as many words as the item and lies where a shared shingle puts the item (moved inside the text at
    its ends). Windows without a shared shingle can't reach the similarity. Windows and items are matched by
    SimHash of their shingles: one of the BLOCKS blocks of fingerprints within RADIUS bits agrees up to FLIPS bits. The
    candidates' weighted Jaccard similarity is exact: shingles of SHINGLE_WORDS words (all words of a shorter item),
    weighted by length. RADIUS is 4.6 standard deviations beyond the mean distance at SIMILARITY. It is no guarantee: see
    the README for the measured recall, and for a `similarity` below SIMILARITY it loses more.

    Null and empty texts hold nothing; an item without words is ignored; repeated texts are searched once.
    """
    w, n = F.col("w"), F.col("len")
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).withColumn("len", F.size("w"))
    items = items.filter("len > 0").withColumn("k", F.least(n, F.lit(SHINGLE_WORDS)))
    items = staged(items.select("item_id", "w", "len", "k", simhash(shingles(w, F.col("k"))).alias("item_fp"), shingles(w, F.col("k")).alias("item_shingles")), "items")
    hashed = lambda a, k: F.transform(_starts(F.size(a), k), lambda i: F.xxhash64(F.slice(a, i, k)))
    marks = staged(items.select("k", "len", F.posexplode(hashed(w, F.col("k"))).alias("q", "mark")).distinct(), "marks")
    marks_are_small = small_enough(marks, BROADCAST_ROWS)
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), words(F.col(text_col)).alias("w"))
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # SHINGLE_WORDS values at most
        mine = marks.filter(F.col("k") == k).drop("k")
        here = texts.select("text_hash", F.posexplode(hashed(w, F.lit(k))).alias("p", "mark"))
        hit = here.join(F.broadcast(mine) if marks_are_small else mine, "mark").select("text_hash", "len", (F.col("p") - F.col("q")).alias("at"))
        found = hit if found is None else found.union(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], "text_hash long, item_id long, start_word int, similarity double")
    spots = staged(found.distinct().groupBy("text_hash").agg(F.collect_list(F.struct("len", "at")).alias("spots")), "spots")
    chosen = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("text"))
    chosen = chosen.join(broadcast_if(spots.select("text_hash"), BROADCAST_ROWS), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    size = F.size("w")
    inside = lambda s: F.greatest(F.lit(0), F.least(s["at"], size - s["len"]))
    cuts = F.array_distinct(F.transform("spots", lambda s: F.struct(s["len"].alias("len"), inside(s).alias("start"))))
    rows = chosen.join(spots, "text_hash").select("text_hash", "spots", words(F.col("text")).alias("w"))
    rows = rows.select("text_hash", F.explode(F.transform(cuts, lambda c: F.struct(c["len"].alias("len"), c["start"].alias("start"), F.slice(w, c["start"] + 1, c["len"]).alias("w")))).alias("c"))
    windows = staged(rows.select("text_hash", "c.*").withColumn("fp", simhash(shingles(w, F.least(F.size(w), F.lit(SHINGLE_WORDS))))), "windows")
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")
    left = windows.select("text_hash", "len", "start", "fp", block).withColumn("v", _block(F.col("fp"), F.col("j")))
    right = items.select("item_id", "len", "item_fp", block).withColumn("v", _block(F.col("item_fp"), F.col("j")))
    flips = F.array(*[F.lit(m) for m in _MASKS])
    right = right.select("item_id", "len", "item_fp", "j", F.explode(F.transform(flips, lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
    near = left.join(broadcast_if(right, BROADCAST_ROWS), ["j", "v", "len"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = staged(near.select("text_hash", "len", "start", "item_id").distinct(), "near-windows")
    known = items.select("item_id", "k", "item_shingles")
    pairs = near.join(windows.select("text_hash", "len", "start", "w"), ["text_hash", "len", "start"]).join(broadcast_if(known, BROADCAST_ROWS // 10), "item_id")
    pairs = pairs.withColumn("s", shingles(w, F.least(F.size("w"), F.col("k"))))
    weight = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + F.length(x))
    score = weight(F.array_intersect("s", "item_shingles")) / weight(F.array_union("s", "item_shingles"))
    return pairs.select("text_hash", "item_id", F.col("start").alias("start_word"), score.alias("similarity")).filter(F.col("similarity") >= similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start_word and similarity of the best window of each item in each contaminated document.

    The earliest window wins a tie. Rows that repeat an id give one row; a null id is shown as such.
    """
    best = contaminated_windows(docs, benchmark, text_col, **options).groupBy("text_hash", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start_word")).alias("s"))).alias("m")
    )
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    rows = ids.join(broadcast_if(staged(best, "leaks"), BROADCAST_ROWS), "text_hash").groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return rows.select("doc_id", "item_id", (-F.col("m.s")).alias("start_word"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text holds no item, with their columns."""
    flagged = staged(contaminated_windows(docs, benchmark, text_col, **options).select(F.col("text_hash").alias("_flagged")).distinct(), "leaks")
    return docs.join(broadcast_if(flagged, BROADCAST_ROWS), F.xxhash64(F.col(text_col).cast("string")) == F.col("_flagged"), "left_anti")
