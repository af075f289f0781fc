"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cargohold.llm import decontaminate, language_id, mixing, orc_tokens, secrets, site_lines, site_templates, spotsigs, url_filter, whitening
from cargohold.llm.common import read_table
from cargohold.llm.exact_dedup import exact_duplicates
from cargohold.llm.manifest import manifest
from cargohold.llm.near_dedup import near_duplicates
from cargohold.llm.sql import ORACLE_SQL
from cargohold.session import scratch_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2)


def op3_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(read_table(spark, sf_dir, "documents")))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    orc_tokens.write_tokens(read_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return orc_tokens.token_index(spark, path)


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read_table(spark, sf_dir, "pages"))


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(read_table(spark, sf_dir, "pages"))


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.page_lines(read_table(spark, sf_dir, "pages"))


def op10_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def op13_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_ecoc, op2_minhash_hamming, op3_secret_randomness, op4_spotsigs, op5_simhash_windows,
        op6_orc_tokens, op7_link_graph, op8_site_templates, op9_site_lines, op10_fair_queue,
        op11_bit_sliced_whitening, op12_octopus_manifest, op13_heavy_hitter_dedup,
    )
    return {f.__name__: f for f in found}


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
