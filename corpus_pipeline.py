"""A training corpus from `documents`: each stage works on what the one before kept, written as Parquet and read again.

Languages that can't be told go, one document of each near-duplicate group (five-word shingles, similarity 0.8) stays,
documents that hold benchmark items go, sources are mixed to their target weights (a document may come twice), and
what remains is written as token ids in ORC, of which the last stage returns the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.llm import decontaminate, language_id, mixing, near_dedup, orc_tokens
from cargohold.llm.common import broadcast_if, identified, read_table, staged
from cargohold.llm.queries import TOKENIZER
from cargohold.session import scratch_dir, ship_package

#: No SQL: the classifier, MinHash and the tokenizer have none. tests/llm holds the stages against plain versions.
ORACLE_SQL = None
#: Row ids to drop that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (1). Texts without a letter and ambiguous ones go."""
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (2), the one with the least id; a null id is the last. Rows whose id is null or
    repeated are told apart by numbers, so of rows with one id and different texts only those linked to another row go."""
    ship_package(spark)
    rows, row, given = identified(docs, "near-rows")
    found = near_dedup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("_n"), F.col("component_id").alias("_c"))
    named = found.withColumn("_id", F.col("_n"))
    if given is not None:
        named = found.join(given, F.col("_n") == F.col("number"), "left")
        named = named.select("_n", "_c", F.when(F.col("number").isNull(), F.col("_n")).otherwise(F.col("id")).alias("_id"))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_n").alias("n")))
    first = named.groupBy("_c").agg(least.alias("m"), F.count("*").alias("rows")).filter("rows > 1")
    # Fewer rows go than stay: their ids are the smaller side.
    gone = named.join(first, "_c").filter(F.col("_n") != F.col("m.n"))
    gone = staged(gone.select(F.col("_n").alias("_gone")), "near-gone")
    return rows.join(broadcast_if(gone, BROADCAST_ROWS), F.col(row) == F.col("_gone"), "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark` (5)."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them (10), once for each copy. Null and repeated ids are queued row by row."""
    ship_package(spark)
    rows, row, _ = identified(docs, "mix-rows")
    mix = mixing.mixed(rows, id_col=row, shuffle_by=["doc_id", "text"])
    return mixing.sequence(rows, mix, id_col=row).select(docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in the ORC files (6)."""
    ship_package(spark)
    path = scratch_dir(spark, "corpus")
    orc_tokens.write_tokens(docs, path, TOKENIZER)
    return orc_tokens.token_index(spark, path)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
