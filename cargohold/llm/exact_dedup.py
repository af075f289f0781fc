"""Exact duplicates with a split for heavy hitters: frequent digests are decided on the map side, the rest by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import staged

#: Digests on more than this share of the rows are heavy. A Misra-Gries summary holds 1 / SUPPORT counters, which bounds
#: what is broadcast; every other group has at most SUPPORT of all rows and is one window group.
SUPPORT = 1e-3


def heavy_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(hot, keep_id, keep_row, group_size): the digests of `rows` (digest, doc_id, row) on more than `support` of them.

    `freqItems` is the Misra-Gries summary, kept by each task and merged: it misses no digest above `support`, but also
    names some below. Counting its candidates verifies them: 1 / support groups at most, summed up before the shuffle.
    """
    found = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("hot"))
    named = rows.join(F.broadcast(found), F.col("digest") == F.col("hot"))
    last = F.max(F.struct("doc_id", "row"))
    counted = named.groupBy("hot").agg(last.alias("keep"), F.count("*").alias("group_size")).filter(F.col("group_size") > support * rows.count())
    return counted.select("hot", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of `docs`, dropped ones too.

    Texts are equal if they are identical, without any change; of equal texts the row with the largest id stays.
    Rows are first cut to their id and digest. Digests on more than `support` of all rows are found by a Misra-Gries
    summary; their exact winners and sizes, 1 / `support` rows at most, are broadcast, and their rows are decided where
    they are. Only the others are shuffled by digest, in groups of at most `support` of all rows.

    A null text counts as empty. A null id is below all others: it stays only in a group without ids (keep_id null).
    Rows that repeat an id and a text are one group, of which exactly one row is kept. Long texts are digested whole.
    An empty table gives no rows; other columns are ignored.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    # The row number is stored, so that one of several rows with one id and text can be told from the others.
    rows = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "digests")
    heavy = staged(heavy_digests(rows, support), "heavy")
    at = F.col("digest") == F.col("hot")
    easy = rows.join(F.broadcast(heavy), at)
    group = Window.partitionBy("digest")
    keep = F.max(F.struct("doc_id", "row")).over(group)
    rest = rows.join(F.broadcast(heavy.select("hot")), at, "left_anti").select("*", keep.alias("keep"), F.count("*").over(group).alias("group_size"))
    rest = rest.select("doc_id", "digest", "row", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    both = easy.select(rest.columns).union(rest)
    return both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))

