"""A corpus pipeline of stages, each calling one operator on what the last one kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantframe.llm.decontaminate import find_contamination
from slantframe.llm.jaccard import Similarity, keep_one_each
from slantframe.llm.piece_codec import encode_documents
from slantframe.llm.scratch import BATCH, TEXTS, Scratch
from slantframe.llm.suffix_dedup import strip_repeats
from slantframe.llm.toxicity import fit_toxicity, held_out, score_toxicity

#: The tokenizer's file; a parameter of the last stage.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def few_rows(stage):
    """stage with batches of few rows, also where its result is written: the texts of a batch are in memory at once."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, str(TEXTS))
        return stage(spark, docs, sf_dir)

    return run


@few_rows
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier rejects (score of 0.7 or more)."""
    learn, _ = held_out(3, 1)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)
    scored = score_toxicity(docs, model, threshold=0.7, keep=True)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


@few_rows
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8)."""
    return keep_one_each(docs, Similarity(words=5, num=80, den=100))


@few_rows
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every string of 200 bytes that also stands elsewhere, and counts characters anew."""
    return strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


@few_rows
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold half of a benchmark item or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, keep=True)
    return found.where(F.col(found.columns[-1]) == 0).select(*docs.columns)


@few_rows
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests."""
    return encode_documents(docs, MODEL, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: None: the stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
