"""The corpus pipeline: five stages of the training-data operators over documents, each on what the one before kept.

Stages pass all columns of documents through, whatever further ones there are. Rows with null or empty texts stay in all of
them; rows equal in doc_id and text stay or go together, but for the n-gram stage, where they count as one document too. Of
ties, the smallest doc_id stays. Texts are read whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm import decontam, line_dedup, ngram_join, spm, toxicity
from lexweft.llm.common import discard, made, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go; others stay as they are."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words are cut from texts; documents of which no words are left go. n_chars follows.

    Shorter runs within lines stay, so that near copies with few changes reach the next stage whole. Columns that are
    named as the operator's own counts keep the user's values.
    """
    own = {c: f"__lexweft_own_{c}" for c in ("n_lines", "n_removed", "share_left") if c in docs.columns}
    cut = line_dedup.dedup(docs.withColumnsRenamed(own), long=50)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link at a Jaccard similarity of 0.8 over five words, one stays."""
    return ngram_join.keep_one(docs, ngram_join.Join(n=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, the SentencePiece ids of the text (null for a null one), and n_tokens (0 for it); columns of these names go."""
    return spm.encode(docs).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the learnt grammar and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written, and goes with all that led to it when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
        discard(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
