"""What the nearest-neighbour search sends through the driver."""

from pyspark.sql import functions as F

from lexweft.llm import ann


def test_queries_are_not_broadcast(spark):
    made = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)]).alias("embedding"))
    found = ann.search(made, ann.Settings(sample=400, per_list=20))
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().toString()
