"""JSON document collections: scanning, validation, and the frames that operators read.

A file holds one document as a top-level array. Frames have a row for each array entry with its position
``pos`` from 0; an empty array gives one row with null pos, so that the document isn't lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig, MalformedDocument

# Field names of the input files; all are required strings, others are ignored.
REFERENCE_FIELDS = ("id", "text", "inner_xml")
QUERY_FIELDS = ("id", "block_type", "html", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _stem(suffix: str = ".json"):
    """File name without its ending; Spark percent-encodes names."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.json$", "")


def read_documents(spark: SparkSession, folder: str, glob: str, fields: tuple[str, ...], key: str, strict: bool = True) -> DataFrame:
    """key, pos and ``fields`` of every document under ``folder`` at any depth.

    Of files with the same stem the last path wins. strict: raises MalformedDocument if a file is no array of
    objects with all fields as strings. Names that begin with _ or . are skipped, as by all of Spark's readers.
    """
    if not _exists(spark, folder):
        raise InvalidConfig(f"no such folder: {folder}")
    return parse(files(spark.read, folder, glob, key), fields, key, strict)


def files(reader, folder: str, glob: str, key: str) -> DataFrame:
    """key (the file's stem), path and whole text of files at any depth, by a batch or a stream reader."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob, "wholetext": "true"}
    return reader.options(**options).format("text").load(folder).select(_stem().alias(key), F.col("_metadata.file_path").alias("path"), "value")


def entry_type(fields: tuple[str, ...]) -> str:
    """The type that a file's text is read as."""
    return f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"


def malformed(files: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The files that are no arrays of objects with all fields as strings."""
    typed = " AND ".join(rf"kind RLIKE '[<, ]{f}: STRING[,>]'" for f in fields)
    missing = " OR ".join(f"exists(entries, e -> e.{f} IS NULL)" for f in fields)
    parsed = files.withColumns({"kind": F.schema_of_variant(F.try_parse_json("value")), "entries": F.from_json("value", entry_type(fields))})
    return parsed.where(f"kind IS NULL OR entries IS NULL OR NOT (kind = 'ARRAY<VOID>' OR (kind LIKE 'ARRAY<OBJECT<%' AND {typed})) OR {missing}").select(*files.columns)


def parse(files: DataFrame, fields: tuple[str, ...], key: str, strict: bool = True) -> DataFrame:
    """Documents of files read as text; see ``read_documents``."""
    latest = files.groupBy(key).agg(F.max("path").alias("path"))  # paths alone, not the texts, are ranked
    files = files.join(latest.select("path"), "path", "left_semi").select(*files.columns)
    if strict and (bad := malformed(files, fields).select("path").limit(5).collect()):
        raise MalformedDocument("not arrays of the expected objects: " + ", ".join(r["path"] for r in bad))
    rows = files.select(key, F.posexplode_outer(F.from_json("value", entry_type(fields))).alias("pos", "e"))
    return rows.select(key, F.col("pos").cast("int").alias("pos"), *[F.col(f"e.{f}").alias(f) for f in fields])


def _reader(large: bool):
    if not large:
        return read_documents
    from . import large as by_ranges  # needs this module

    return by_ranges.read_documents


def read_reference(spark: SparkSession, folder: str, strict: bool = True, large: bool = False) -> DataFrame:
    """ref_id, pos, element_id, text, inner_xml of every *.json file. large: files are read by byte ranges, whatever their size."""
    return _reader(large)(spark, folder, "*.json", REFERENCE_FIELDS, "ref_id", strict).withColumnRenamed("id", "element_id")


def read_queries(spark: SparkSession, folder: str, strict: bool = True, large: bool = False) -> DataFrame:
    """query_id, pos, block_id, block_type, html, text of every *_processed.json file; ids keep _processed. large: as for references."""
    return _reader(large)(spark, folder, "*_processed.json", QUERY_FIELDS, "query_id", strict).withColumnRenamed("id", "block_id")
