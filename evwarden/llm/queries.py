"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.llm import fill_middle, licences, merkle
from evwarden.llm.chat_tree import conversation_digests, prefix_tree, with_control_strings
from evwarden.llm.common import table
from evwarden.llm.decontaminate import benchmark_passages
from evwarden.llm.disclosure import KINDS, private_spans
from evwarden.llm.extract import extracted
from evwarden.llm.hilbert import shard_table
from evwarden.llm.lattice import lattice_scores
from evwarden.llm.lines import COUNTS, line_rules
from evwarden.llm.mixing import mixed
from evwarden.llm.simhash import simhash_duplicates
from evwarden.llm.variants import variant_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_control_strings(table(spark, sf, "conversations"), spark)
    return conversation_digests(*prefix_tree(rows))


def op2_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = extracted(table(spark, sf, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_disclosure_control(spark: SparkSession, sf: str) -> DataFrame:
    rows = private_spans(table(spark, sf, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op4_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rules(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "removed_words")


def op5_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_table(table(spark, sf, "documents"))


def op6_lattice_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return lattice_scores(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op7_cgk_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = benchmark_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


def op8_licence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_matches(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op9_simhash_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash_duplicates(table(spark, sf, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_entropy_balancing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixed(table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "source", "copies")


def op11_merkle_tree(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.fingerprint_table(table(spark, sf, "documents"))


def op12_trie_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return variant_table(table(spark, sf, "documents"))


def op13_block_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.middle_digests(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_chat_prefix_tree, op2_line_blocks, op3_disclosure_control, op4_line_frequency, op5_hilbert_shards,
        op6_lattice_likelihood, op7_cgk_decontamination, op8_licence_sentences, op9_simhash_multi_index, op10_entropy_balancing,
        op11_merkle_tree, op12_trie_frontier, op13_block_rotation,
    )
}
ORACLES: dict[str, str] = {
    "op8_licence_sentences": licences.ORACLE, "op11_merkle_tree": merkle.ORACLE, "op13_block_rotation": fill_middle.ORACLE,
}
