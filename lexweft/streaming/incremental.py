"""Alignment of query documents as their files arrive.

A file stream hands each new file to one micro-batch; the batch is aligned with the reference documents by the
same plans as in batch runs. What batches write are versions: of one query document the report of the latest batch
counts (``latest``), so a file that arrives later under the same stem replaces the earlier one's report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import AlignmentEngine
from ..sources import documents


def align_arriving(engine: AlignmentEngine, elements: DataFrame, output: str, checkpoint: str, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Starts aligning arriving *_processed.json files with ``elements`` (read_reference's frame).

    Each micro-batch's reports are written to ``output``/batch=<id>, so a batch that is run again replaces its
    own. Files that aren't arrays of the expected objects go to ``output``_malformed/batch=<id> (name, path, text) and
    don't hold up the others. What a batch keeps is released when it is written. once: stop when all present files are
    done.
    """
    embedded = engine.embedded(elements, "document").persist()

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()
        bad = documents.malformed(batch, documents.QUERY_FIELDS).persist()
        try:
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{output}_malformed/batch={batch_id}")
            good = batch.join(bad.select("path"), "path", "left_anti")
            if good.isEmpty():
                return
            blocks = documents.parse(good, documents.QUERY_FIELDS, "query_id", strict=False).withColumnRenamed("id", "block_id")
            engine.align(engine.embedded(blocks, "query"), embedded).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        finally:
            engine.release()
            bad.unpersist()
            batch.unpersist()

    reader = engine.spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    arriving = documents.files(reader, engine.config.query_dir, "*_processed.json", "query_id")
    writer = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The reports that count, with ``batch``: of each query document that of the latest batch it came in.

    Only ids and batches are read to find them.
    """
    held = spark.read.option("basePath", output).parquet(output)
    last = held.groupBy("pdf_document_id").agg(F.max("batch").alias("batch"))
    return held.join(last, ["pdf_document_id", "batch"], "left_semi")


def fold(spark: SparkSession, output: str, target: str) -> None:
    """Writes the reports that count as one table; the batches may go then."""
    latest(spark, output).drop("batch").write.mode("overwrite").parquet(target)
