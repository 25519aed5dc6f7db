"""The corpus pipeline: documents in, encoded training rows out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

1. toxicity: documents that score TOXIC_AT or more go. The grammar is fitted on
   the labelled documents of the folds that may be learned from.
2. line_dedup: lines that a smaller doc_id also has go; documents stay.
3. simhash: one document of each group of near copies stays, the smallest
   doc_id.
4. mixing: sources are mixed to target weights; a document is there once for
   each of its repetitions.
5. bpe: the token digest of every row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import queries as Q
from parley.llm.bpe import bpe_round_trip
from parley.llm.common import written
from parley.llm.line_dedup import dedup_lines
from parley.llm.mixing import apply_mix
from parley.llm.simhash import keep_one
from parley.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, Q.toxicity_grammar(spark, sf_dir), Q.TOXIC_AT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    kept = dedup_lines(docs, Q.LINE_MIN_CHARS)
    return kept.select(*[
        F.col("kept").alias("text") if c == "text" else
        F.char_length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col(f"`{c}`") for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, Q.SIMHASH_WORDS, Q.SIMHASH_BITS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text (of fractional repetitions)."""
    mixed = apply_mix(docs, Q.MIX_WEIGHTS, Q.MIX_BUDGET, Q.MIX_EPOCHS, Q.MIX_SEED)
    return mixed.select(*[
        F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col(f"`{c}`") for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, Q.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash),
          ("mixing", mixing), ("bpe", bpe)]

# The toxicity model, SimHash components and the tokenizer are beyond SQL; the
# stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
