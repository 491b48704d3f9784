"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, line_dedup, mixing, ngram_join, quality, resampling, sharding, spm, token_counts, toxicity, url_filters, whitening
from .common import table
from .oracles import ORACLES  # noqa: F401


#: The stated rules of op1, as (verdict, rule).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.match(pages, URL_RULES, url_filters.mine(pages, table(spark, sf_dir, "labels")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), ngram_join.Join(n=4, percent=85)).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, before and after two edits: a cut in its middle, words put at its front."""
    middle = F.expr("cast(char_length(text) div 2 as int)")
    cut = F.struct(middle.alias("start"), (middle + 12).alias("stop"), F.lit(" - ").alias("new"))
    put = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("Revised edition. ").alias("new"))
    kept = token_counts.trees(table(spark, sf_dir, "documents"))
    kept = kept.withColumns({"edits": F.array(cut, put), "before": F.col("n_tokens"), "before_pre": F.col("n_pretokens")})
    out = token_counts.update(kept, "edits")
    return out.select("doc_id", F.col("before").alias("n_tokens"), F.col("before_pre").alias("n_pretokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_ngram_join, op3_toxicity, op4_decontamination, op5_sharding, op6_line_dedup, op7_nearest_neighbours, op8_sentencepiece, op9_quality, op10_token_counts, op11_embedding_whitening, op12_source_mixing, op13_importance_resampling)}
