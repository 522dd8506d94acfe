"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``, and others that the table has besides, whatever their names. Rows with null doc_id are kept by
the dedup stages; rows that repeat a doc_id are one document to them, which stays or goes as a whole; an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm import bpe_automaton, language_id, simhash_dedup, source_mixing, suffix_dedup
from liftline.llm.common import discard, materialise, prepare, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null or letterless texts) go; where lang is null it is filled in."""
    prepare(spark)
    judged = language_id.judged(docs, language_id.learn(docs), docs.columns).where(F.col("lang_pred") != language_id.UNKNOWN)
    return judged.select(*((F.coalesce("kept_row.lang", "lang_pred") if c == "lang" else F.col(f"kept_row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (5-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays."""
    prepare(spark)
    found = simhash_dedup.similar(docs)
    gone = materialise(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller doc_id has too are cut out; a letter that a cut splits goes as a whole. Documents of which nothing is left go."""
    prepare(spark)
    return suffix_dedup.dedup_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order and repeat documents as the mix takes them: one row per copy, by training position.

    A source's target may end within one document, which then counts as a whole copy if at least half of it is taken.
    """
    prepare(spark)
    mixed = source_mixing.placed(docs, docs.columns)
    copies = F.when(F.col("mix_size") > 0, F.floor(F.col("taken") / F.col("mix_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return mixed.select("kept_row", F.explode(F.array_repeat(F.lit(1), copies))).select(*(F.col(f"kept_row.`{c}`") for c in docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for every row."""
    prepare(spark)
    return bpe_automaton.digests(docs, bpe_automaton.default_path())


STAGES = [
    ("identify_languages", identify_languages),
    ("drop_near_copies", drop_near_copies),
    ("drop_repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("encode_texts", encode_texts),
]

#: Hyperdimensional cosines, fingerprints and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        was, docs = docs, materialise(stage(spark, docs, sf_dir))
        if k:
            discard(was)  # its only reader has been written; the last stage's input stays
    return STAGES[-1][1](spark, docs, sf_dir)
