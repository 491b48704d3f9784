"""Gapless row numbers without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``keys``, which must tell rows apart.

    Rows are dealt by range and sorted there, and places within a range follow from the order; counts of ranges (as
    many rows as ranges) are summed up. So rows are shuffled once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition above 33 bits of row number
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__lexweft_at", place).persist()
    bucket = F.shiftrightunsigned("__lexweft_at", 33).alias("__lexweft_bucket")
    counts = ranged.groupBy(bucket).agg(F.count("*").alias("n"))
    before = Window.orderBy("__lexweft_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__lexweft_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lexweft_start"))
    out = ranged.withColumn("__lexweft_bucket", bucket).join(F.broadcast(starts), "__lexweft_bucket")
    at = F.col("__lexweft_start") + F.col("__lexweft_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, at).drop("__lexweft_bucket", "__lexweft_at", "__lexweft_start")
