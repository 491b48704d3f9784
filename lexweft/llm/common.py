"""Shared helpers of the training-data operators: scratch tables, table reading, held-out rule."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Used only where the session names no spark.checkpoint.dir (tests, laptops).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Rows that a Python stage works on at once.
SLICE = 1000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir; a local one only where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a Parquet table (with the writer's ``options``) in the shared checkpoint folder and reads it back.

    A lost executor costs only the tasks it ran, as the table lies in shared storage. Unlike an RDD
    checkpoint it is columnar and carries its size, so that Spark can size joins by it.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{checkpoint_root(spark)}/lexweft/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lexweft_path = path
    return out


#: Scratch tables that are there, in the order in which they were made.
_made: dict[str, SparkSession] = {}


def made() -> list[str]:
    """The scratch tables there are; what is made later can be told by it."""
    return [*_made]


def discard(before: list[str], *needed: DataFrame) -> None:
    """Deletes scratch tables made since ``made()`` gave ``before``, but for those ``needed`` still.

    Called when what was computed from them is written, so that a long job doesn't hold all its intermediate tables.
    """
    held = {*before, *(df._lexweft_path for df in needed)}
    for path in [p for p in _made if p not in held]:
        _remove(_made.pop(path), path)


def _remove_all() -> None:
    for path, spark in _made.items():
        _remove(spark, path)


def release(spark: SparkSession, pause: float = 0) -> None:
    """Lets go of shuffle files behind tables written before.

    Spark's cleaner deletes a shuffle once its plan is garbage on the driver; a driver with a roomy heap seldom
    collects, and files would pile up on the executors until then. The plan of the last table is held until Spark's
    listeners have been told of its end, for which ``pause`` seconds are waited.
    """
    time.sleep(pause)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have gone before the interpreter ends
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id is held out, so that its label is never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> DataFrame:
    """(text, y) of at most ``per_class`` labelled rows of each class outside the held-out fifth.

    The choice follows a hash of doc_id, so it is reproducible. Only rows of labels are ranked; the
    documents meet a side of at most 2 * per_class ids. Texts above ``max_bytes`` bytes are not learnt from. Of rows that
    share a doc_id one text is taken, that of the smallest hash, however many they are.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes))
    met = texts.join(F.broadcast(ids), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


def tidy() -> None:
    """Gives memory that a Python stage has freed back to the system; idle workers would keep it beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that tidies up when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def sliced(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches in pieces of up to ``rows`` rows."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


def add_columns(df: DataFrame, column: str, added: str, factory: Callable[[], Callable[[list], dict[str, list]]], keep: bool = False) -> DataFrame:
    """``df`` with columns computed from ``column``, which goes unless ``keep``.

    ``added`` is their schema; ``factory`` makes, once for each task, the function from a list of values to lists
    by name. Other columns pass through as Arrow arrays, so that null and large integers stay exact.
    """
    new = T._parse_datatype_string(added)
    left = [f for f in df.schema.fields if keep or f.name != column]
    at = df.columns.index(column)
    places = [i for i, f in enumerate(df.schema.fields) if keep or f.name != column]
    kinds = to_arrow_schema(new)
    names = [f.name for f in left] + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                made = make(part.column(at).to_pylist())
                arrays = [pa.array(made[f.name], type=f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + arrays, names=names)

    return df.mapInArrow(tidied(run), T.StructType(left + new.fields))


def keep_rows(df: DataFrame, column: str, factory: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose value in ``column`` the function keeps, all columns as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        for batch in batches:
            yield batch.filter(pa.array(make(batch.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)
