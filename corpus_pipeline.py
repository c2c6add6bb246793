"""Corpus preparation as five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each stage's
result as Parquet to the shared scratch folder and reads it back as the next one's documents.  All but the
last return the columns of ``documents``, and further columns of their input unchanged: what a stage adds for itself has a
private name.

Defined results, for each stage: rows with null or shared ids, repeated rows and clashing column names are kept as
the stage's rule says; null, empty and letterless texts go in the first stage; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.llm import bin_packing, language_id, ngram_join, suffix_dedup, toxicity
from pricelab.llm.common import Scratch, id_bucket, stored, table
from pricelab.plans.session import ship_package

TOKENIZER = "word_bpe_49k.json"


def _private(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


def _kept(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without text or letters go.

    Only the verdict comes back from Python; the rows wait in the JVM."""
    ship_package(spark)
    model = language_id.fit(docs.where(id_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "lang", "text"))
    verdict = _private("verdict")
    return docs.withColumn(verdict, language_id.verdict(docs, model)["lang_pred"]).where(F.col(verdict) != language_id.UNDETERMINED).select(_kept(docs))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels outside the held-out fold train the model."""
    ship_package(spark)
    model = toxicity.fit_held_out(docs, table(spark, sf_dir, "labels"))
    score = _private("score")
    return docs.withColumn(score, toxicity.score_of(docs, model)).where(F.col(score) < toxicity.THRESHOLD).select(_kept(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows are grouped by their own text under a hash of (doc_id, text), so rows that share an id but not a text
    stand for themselves.  Rows with a null id are grouped like the rest and come after all ids; rows equal in
    doc_id and text are one document, no others are merged; texts without words all stay."""
    ship_package(spark)
    row = _private("row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = ngram_join.groups_of(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    members = groups.join(keyed.select(row, "doc_id").distinct(), row)
    firsts = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)).alias("first")).select(f"first.{row}")
    return keyed.join(firsts, row, "left_semi").dropDuplicates(["doc_id", "text"]).select(_kept(docs))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that repeat among or within them; ``n_chars`` follows the text."""
    ship_package(spark)
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(_kept(docs)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 4096 tokens."""
    ship_package(spark)
    return bin_packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("toxicity", harmless),
    ("ngram_jaccard_join", distinct_texts),
    ("suffix_array_dedup", without_passages),
    ("best_fit_packing", packed),
]

#: SQL can't train the models or tokenise; each stage is tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; a stage's stored result goes when the next one is stored."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
        scratch.drop(keep_last=1)
    pieces = stored(STAGES[-1][1](spark, docs, sf_dir), "sequences")
    scratch.drop()
    return pieces
