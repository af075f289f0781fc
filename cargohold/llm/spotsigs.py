"""SpotSigs fingerprints: chains of content words behind common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import staged

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from had has have he in is it its not of on or that the this to was were which with "
    "als am auf aus bei das dem den der des die ein eine einen einer es für im ist mit nicht sich sie und von war wie zu zum zur "
    "au aux avec ce ces dans de du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el ella las lo los no para por se su sus una y"
).split()
#: Content words in a chain; parts into which the range of ids between two quantiles is cut, and quantiles.
CHAIN, PARTS, QUANTILES = 2, 64, 64


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_spots(df: DataFrame, chain: int = CHAIN, **texts: str) -> DataFrame:
    """Add, for each `name=column`, the sorted distinct signatures of a text column.

    A signature is an anchor and the `chain` content words behind it, anchors in between left out, hashed. A text
    without a full chain has one signature, the hash of all its words; so equal texts have equal signatures.
    Words and chains are columns of steps of their own: what an expression uses twice is evaluated once.
    """
    kept = df.columns
    split = df.select(*kept, *[_words(F.col(c)).alias(f"_w_{n}") for n, c in texts.items()])
    chained = split.select(*split.columns, *[_chains(F.col(f"_w_{n}"), chain).alias(f"_c_{n}") for n in texts])

    def whole(n: str) -> Column:
        return F.array(_short_hash(F.array_join(F.col(f"_w_{n}"), " ")))

    return chained.select(*kept, *[F.when(F.size(f"_c_{n}") > 0, F.col(f"_c_{n}")).otherwise(whole(n)).alias(n) for n in texts])


def _chains(w: Column, chain: int) -> Column:
    anchor = lambda x: x.isin(*ANCHORS)
    content = F.filter(w, lambda x: ~anchor(x))
    at = F.filter(F.transform(w, lambda x, i: F.when(anchor(x), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    # Before the j-th anchor at word i stand i - j content words. The one-element array binds the three lists once.
    row = F.struct(w.alias("w"), content.alias("c"), at.alias("at"))
    one = F.transform(
        F.array(row),
        lambda r: F.filter(
            F.transform(r["at"], lambda i, j: F.struct(F.element_at(r["w"], i + 1).alias("a"), F.slice(r["c"], i - j + 1, chain).alias("c"))),
            lambda s: F.size(s["c"]) == chain,
        ),
    )
    hashed = F.transform(F.element_at(one, 1), lambda s: _short_hash(F.concat(s["a"], F.lit(" "), F.array_join(s["c"], " "))))
    return F.array_sort(F.array_distinct(hashed))


def _short_hash(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, 12)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their sizes alone rule out `least`."""
    possible = F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(possible, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text, the text of the row that follows in descending order of ids; the first follows the last.

    Ids are cut into ranges: quantiles, and equal parts between two of them. Each range is a window of its own, and
    the first row of each range also stands as a guest at the end of the range before. Null ids come last; rows that
    repeat an id follow each other by text. A single row follows itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    bounds = rows.select(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 1000).alias("q")).first()["q"] or [0]
    bounds = sorted(set(bounds))

    def place(lo: int, hi: int) -> Column:
        """Index of the last bound not above the id, as a search tree."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(F.col("doc_id") < bounds[mid], place(lo, mid - 1)).otherwise(place(mid, hi))

    parts = max(1, min(PARTS, n // (QUANTILES * 64)))
    low = F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), F.col("q") + 1)
    high = F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in [*bounds[1:], bounds[-1] + 1]]), F.col("q") + 1)
    inner = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0)) * parts)
    cut = F.col("q") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inner))
    ranged = rows.withColumn("q", place(0, len(bounds) - 1)).withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(cut).cast("long")).drop("q")
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))  # at most QUANTILES * PARTS + 2 rows
    order = Window.orderBy("range")
    heads = heads.select("head", "range", F.lead("range").over(order).alias("up"), F.min("range").over(Window.partitionBy()).alias("least"), F.max("range").over(Window.partitionBy()).alias("most"))
    guests = heads.select("range", "head", F.coalesce("up", "least").alias("host"))
    known = ranged.join(F.broadcast(guests), "range")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.when(is_head, F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))))
    spread = known.select("doc_id", "text", F.explode(F.array_compact(places)).alias("p")).select("doc_id", "text", "p.*")
    follow = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return spread.select("doc_id", "text", "guest", F.lead("text").over(follow).alias("next_text")).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """One row per row of `docs`: the fingerprint (its signatures in order, joined by blanks), that of an edited text, and how like they are.

    The edited text ends in as many characters of the next text (see `with_next`) as it loses, a third. A null text
    counts as empty. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_spots(rows.select("*", edited.alias("edited")), chain, own="text", other="edited", next="next_text")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("own", " ").alias("fingerprint"),
        F.array_join("other", " ").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def near_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of the pairs of distinct signature sets with a likeness of `least` or more.

    `sets` has doc_id and spots; equal sets stand for each other (the least id). Sets are partitioned by length: the
    bounds of partition i grow by 1 / least, so a partner lies in the same or the next one. Within a partition, a
    set's rarest signatures (enough of them that a partner must share one) meet in a join; lengths and then the exact
    likeness prune the pairs.
    """
    unique = staged(sets.groupBy("spots").agg(F.min("doc_id").alias("doc_id")), "spots")
    counts = unique.select(F.explode("spots").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    each = unique.select("doc_id", F.size("spots").alias("n"), F.explode("spots").alias("s")).join(counts, "s")
    ranked = each.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"))
    prefix = F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    part = F.floor(F.log("n") / -F.log(F.lit(least)) if least < 1 else F.col("n")).cast("int")
    keys = staged(ranked.select("doc_id", "n", part.alias("part"), F.explode(prefix).alias("e")).select("doc_id", "n", "part", "e.s"), "prefixes")
    left = keys.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "s", "part")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["s", "part"]).filter(shorter & (F.col("na") >= least * F.col("nb"))).select("a", "b").distinct()
    full = lambda i, s: unique.select(F.col("doc_id").alias(i), F.col("spots").alias(s))
    rows = pairs.join(full("a", "sa"), "a").join(full("b", "sb"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least))
    return rows.filter(F.col("likeness") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
