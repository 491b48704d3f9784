"""Statistics of text sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def size_statistics(df: DataFrame, by: str) -> DataFrame:
    """Least, largest and upper median byte length of the texts by group.

    The upper median is found from counts of lengths, so a large group isn't gathered: lengths are few.
    """
    counts = df.groupBy(by, F.octet_length("text").alias("size")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(by))})
    middle = F.expr("total div 2 + 1")
    return ranked.groupBy(by).agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.min(F.when(F.col("upto") >= middle, F.col("size"))).alias("median_size"))
