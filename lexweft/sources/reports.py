"""Report sinks."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def write_dataset(reports: DataFrame, path: str, format: str = "parquet") -> None:
    """The canonical form: one nested row for each query document."""
    reports.write.mode("overwrite").format(format).save(path)


def write_files(lines: DataFrame, folder: str, suffix: str = "_matches.json") -> None:
    """One JSON file <query>_matches.json for each query document, in any file system that Spark writes to.

    ``lines`` has the pieces of each file (query_id, section, place, body). A file's pieces meet in one task, which sorts
    them (spilling where it must) and streams them out, so a report is never held whole. Executors write through
    Spark's commit protocol to a folder beside, so that tasks that are run again leave whole files; the driver then
    moves each file to its name, replacing one that is there. Only names pass the driver.
    """
    spark = lines.sparkSession
    folder, jvm = folder.rstrip("/"), spark.sparkContext._jvm
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    # A name that can't be null keeps its rows' order: Spark would otherwise sort them again by the name alone.
    named = lines.select(F.coalesce("query_id", F.lit("")).alias("name"), "section", "place", "body")
    order = ["name", "section", "place"]
    named.repartition("name").sortWithinPartitions(*order).select("name", "body").write.option("maxRecordsPerFile", 0).partitionBy("name").text(staged)
    path = jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for each in files.listStatus(path(staged)):
        own = each.getPath().getName()
        if own.startswith("name="):
            target = path(path(folder), f"{unescaped(own[5:])}{suffix}")
            parts = [f.getPath() for f in files.listStatus(each.getPath()) if not f.getPath().getName().startswith((".", "_"))]
            files.delete(path(each.getPath(), f".{parts[0].getName()}.crc"), False)  # a local file system's checksum stays behind
            files.delete(target, False)
            files.rename(parts[0], target)
    files.delete(path(staged), True)


def log_statistics(lines: DataFrame, folder: str, most: int = 1000) -> None:
    """Writes the whole log (query_id, section, place, body) as text to ``folder``, and logs its first ``most`` lines."""
    order = ["query_id", "section", "place"]
    lines.repartition("query_id").sortWithinPartitions(*order).select("body").write.mode("overwrite").text(folder)
    for r in lines.orderBy(*order).select("body").limit(most).collect():
        log.info("%s", r["body"])
