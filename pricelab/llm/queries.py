"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricelab.llm import bin_packing, collocations, divergence_rules, exact_dedup, hard_negatives, language_id, ngram_join, piece_sampling, quality_gam, quote_threads, suffix_dedup, toxicity, vector_dedup
from pricelab.llm.common import table
from pricelab.llm.oracle import ORACLE_SQL  # noqa: F401
from pricelab.plans.session import ship_package

#: Vocabulary file of the packing query.
PACKING_TOKENIZER = "word_bpe_49k.json"


#: Vocabulary file of the sampling query.
SAMPLING_MODEL = "piece_bpe_32k.model"


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vector_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings of 400 bytes cover."""
    return suffix_dedup.removed_spans(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_gam.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return ngram_join.groups_of(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return bin_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    return divergence_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a sampled segmentation of every document."""
    return piece_sampling.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(SAMPLING_MODEL))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op10_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all conversations in reply order, without quotes."""
    return quote_threads.conversations(table(spark, sf_dir, "conversations"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    return hard_negatives.default_mine(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z, with their digests."""
    return exact_dedup.digest_rows(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to five words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package has been sent to the executors."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_ngram_join": op4_ngram_join,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_divergence_rules": op7_divergence_rules,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_language": op9_language,
    "op10_quote_threads": op10_quote_threads,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}

QUERIES = {name: _shipped(query) for name, query in _ALL.items()}
