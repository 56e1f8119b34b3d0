"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import backoff_lm, bitpack, crf_quality, feistel, group_jaccard, latent_decontam, periodic_runs, pfair, prefix_tokens, prefix_trie, simhash_gray, suffix_dedup, toxic_knn
from marketloom.llm.common import ship, table
from marketloom.session import scratch_path

# For the test tables; a deployment passes its own secret to the operator.
PII_KEY = "key of the test tables"


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    bitpack.write_packed(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return bitpack.read_ids(spark, path, digest=True)


def op3_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return pfair.mix(slim, size="n_bytes")


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = prefix_tokens.prefix_counts(table(spark, sf_dir, "documents"), path)
    return prefix_tokens.over_limit(counts, 2048).drop("changes")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op6_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = crf_quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return crf_quality.judge(docs, field)


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = toxic_knn.training_rows(table(spark, sf_dir, "labels"), "toxic")
    index, vectors = toxic_knn.build(docs, train)
    scored = toxic_knn.score_vectors(vectors, index)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


def op11_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_jaccard.similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def trie_rows(turns: DataFrame, block: int | None) -> DataFrame:
    """A row per node, with the hash of the conversations that end there."""
    nodes, ends = prefix_trie.prefix_trie(turns, block)
    hashed = nodes.join(prefix_trie.ends_digest(ends), ["a", "b"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return hashed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_rows(table(spark, sf_dir, "conversations"), 20)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by the hash of its id repeats its end, as the query's rule has it."""
    rule = periodic_runs.planted
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rule)
    return periodic_runs.digest(found, rule)


_QUERIES = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_packed_ids": op2_packed_ids,
    "op3_mixed_order": op3_mixed_order,
    "op4_prefix_token_counts": op4_prefix_token_counts,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quality_lines": op6_quality_lines,
    "op7_simhash_components": op7_simhash_components,
    "op8_toxicity": op8_toxicity,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_backoff_scores": op10_backoff_scores,
    "op11_group_jaccard": op11_group_jaccard,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
