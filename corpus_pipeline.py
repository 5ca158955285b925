"""A training corpus from documents, in five stages; each is written as Parquet and read again by the next.

Every stage works on all rows that the one before kept and returns the columns of documents, but for the last, which
returns one row a packed piece. Columns other than doc_id and text pass through unchanged, whatever their names; n_chars follows the text.
Rows with a null doc_id pass the stages that need an id; an empty table passes all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontamination, language_id, line_dedup, ngram_join, packing
from lodestream.session import load, written

#: Packing is no SQL.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns that stages read or write; all others step aside while a stage works, so that no operator's name meets them.
OWN = ("doc_id", "text", "lang", "n_chars")


def shielded(stage: Stage) -> Stage:
    """The stage with the columns of documents as they were, whatever their names."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_aside_{k}" for k, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select(*[aside.get(c, c) for c in docs.columns]).toDF(*docs.columns)

    return run_stage


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that was learned go: without a letter, or next to nothing shared with any profile."""
    found = language_id.identified(docs)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.MIN_SCORE))


@shielded
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document that has no word left goes with them."""
    left = line_dedup.dedup_lines(docs)
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left


@shielded
def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once."""
    heads = ngram_join.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id IS NULL"))


@shielded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    found = decontamination.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return decontamination.judged(found).where(~F.col("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
