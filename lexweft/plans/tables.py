"""Query and reference documents made of the synthetic tables.

Blocks are conversation turns, elements are documents grouped by source, vectors come from embeddings by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..operators.embed import LookupProvider

#: The tables' vectors have 64 components; half of them are used, so that cutting shows.
DIM = 32
FULL = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_vectors(spark: SparkSession, sf_dir: str, df: DataFrame, role: str) -> DataFrame:
    known = read(spark, sf_dir, "embeddings")
    n = known.count()
    keyed = df.withColumn("vec_id", F.pmod(F.col("key"), F.lit(n))).drop("key")
    made = LookupProvider(known.select("vec_id", "embedding"), ["vec_id"], FULL).embed(keyed, role)
    return made.withColumn("vec", vectors.truncate(F.col("vec"), DIM)).drop("vec_id")


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    name = F.concat(F.lit("conv-"), F.col("conv_id"), F.lit("_src"), F.col("conv_id") % 20)
    return read(spark, sf_dir, "conversations").select(name.alias("query_id"), rank.cast("int").alias("pos"), F.concat_ws("/", "conv_id", "turn").alias("block_id"), "text", (F.col("conv_id") * 7 + F.col("turn")).alias("key"))


def plain_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within a source are ranks of doc_id, counted in slices so that a large source isn't one task."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("ref_id"), "doc_id", F.col("doc_id").cast("string").alias("element_id"), "text", F.col("doc_id").alias("key"))
    docs = docs.withColumn("slice", F.expr("doc_id div 4096"))
    sizes = docs.groupBy("ref_id", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ref_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("ref_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("ref_id", "slice").orderBy("doc_id")) - 1
    return docs.withColumn("rank", rank).join(starts, ["ref_id", "slice"]).withColumn("pos", (F.col("start") + F.col("rank")).cast("int")).drop("slice", "rank", "start", "doc_id")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_vectors(spark, sf_dir, plain_blocks(spark, sf_dir), "query")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_vectors(spark, sf_dir, plain_elements(spark, sf_dir), "document")
