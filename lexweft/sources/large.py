"""JSON array files of any size: a file is read by byte ranges, and its array entries are found without parsing it whole.

Spark reads the files as text that is split at every ``}``, each range by a task of its own. What a ``}`` means depends on
what stands before it in the file: whether it is in a string, and how deep it is nested. A first pass sums up each range
for both cases (begun within a string or not); these sums, put together in the order of ranges, give every range's
beginning, and a second pass cuts its entries. Only entries that lie across ranges are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import MalformedDocument
from . import documents

#: Ranges up to which their beginnings are broadcast to the second pass; beyond, texts are joined by a shuffle and sorted.
RANGES = 200_000
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
CLOSED = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_BRACKETS = re.compile(r"[\[{}\]]")
_BEFORE = {True: re.compile(r"\s*\[\s*(?={)"), False: re.compile(r"\s*,\s*(?={)")}
_END = {True: re.compile(r"\s*\[\s*\]\s*\Z"), False: re.compile(r"\s*\]\s*\Z")}


def scan(text: str, inside: bool) -> tuple[int, bool]:
    """The change of depth over ``text`` and a ``}`` behind it, and whether that one is in a string; ``inside``: begun in one."""
    at = 0
    if inside:
        m = CLOSED.match(text)
        if m is None:
            return 0, True
        at = m.end()
    rest = STRING.sub("", text[at:])
    left = rest.split('"', 1)
    depth = sum(1 if b in "[{" else -1 for b in _BRACKETS.findall(left[0]))
    return (depth, True) if len(left) > 1 else (depth - 1, False)


def _pieces(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, start (of the range), nth (order within a task) and value, the text up to each ``}``, without it."""
    read = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob, lineSep="}").format("text").load(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value").withColumn("nth", F.monotonically_increasing_id())


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator]]:
    """Consecutive rows of one range; a range's rows may come in several parts, of which the key is the same."""
    for batch in batches:
        if len(batch):
            change = ((batch["path"] != batch["path"].shift()) | (batch["start"] != batch["start"].shift())).cumsum()
            for _, part in batch.groupby(change, sort=False):
                yield (part["path"].iloc[0], int(part["start"].iloc[0])), part


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range and both beginnings: the change of depth, whether it ends in a string, and how many ``}`` end at what depth."""
    key, state = None, None

    def row() -> pd.DataFrame:
        return pd.DataFrame([{"path": key[0], "start": key[1], "cases": [{"depth": d, "inside": s, "ends": [{"depth": k, "n": n} for k, n in sorted(c.items())]} for d, s, c in state]}])

    for own, part in _runs(batches):
        if own != key:
            if key is not None:
                yield row()
            key, state = own, [(0, False, Counter()), (0, True, Counter())]
        for text in part["value"]:
            for i, (depth, inside, ends) in enumerate(state):
                change, within = scan(text, inside)
                if not within:
                    ends[depth + change] += 1
                state[i] = (depth + change, within, ends)
    if key is not None:
        yield row()


_CASES = "path string, start long, cases array<struct<depth:int,inside:boolean,ends:array<struct<depth:int,n:long>>>>"


def _beginnings(pieces: DataFrame) -> DataFrame:
    """path, start, depth, inside, entries: what each range begins with, and how many entries end before it.

    A file's ranges are put together in one row: sums of ranges of many megabytes each, not their texts.
    """
    sums = pieces.select("path", "start", "nth", "value").mapInPandas(_summed, _CASES)
    files = sums.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "cases"))).alias("ranges"))
    step = """aggregate(ranges, CAST(array() AS array<struct<start:bigint,depth:int,inside:boolean,entries:bigint,after_depth:int,after_inside:boolean,after_entries:bigint>>), (made, r) ->
      concat(made, transform(array(coalesce(element_at(made, -1), named_struct('start', 0L, 'depth', 0, 'inside', false, 'entries', 0L, 'after_depth', 0, 'after_inside', false, 'after_entries', 0L))), l -> named_struct(
        'start', r.start, 'depth', l.after_depth, 'inside', l.after_inside, 'entries', l.after_entries,
        'after_depth', l.after_depth + get(r.cases, int(l.after_inside)).depth, 'after_inside', get(r.cases, int(l.after_inside)).inside,
        'after_entries', l.after_entries + aggregate(filter(get(r.cases, int(l.after_inside)).ends, e -> e.depth + l.after_depth = 1), 0L, (n, e) -> n + e.n)))))"""
    return files.select("path", F.explode(F.expr("slice(" + step.replace("element_at(made, -1)", "get(made, size(made) - 1)") + ", 1, size(ranges))")).alias("r")).select("path", "r.start", "r.depth", "r.inside", "r.entries")


_ENTRY = "path string, start long, pos long, kind string, value string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries that lie within a range (whole), and the pieces of others: their begin, middle and end; what isn't JSON (bad).

    A file's last piece gives an ``empty`` or ``last`` row.
    """
    key, depth, inside, pos, held, begun = None, 0, False, 0, [], True

    def rest() -> list[tuple]:
        return [(*key, pos, "begin" if begun else "middle", "".join(held))] if held else []

    for own, part in _runs(batches):
        out = []
        if own != key:
            out += rest() if key is not None else []
            key, first = own, part.iloc[0]
            depth, inside, pos = int(first["depth"]), bool(first["inside"]), int(first["entries"])
            held, begun = [], depth < 2 and not inside
        for text in part["value"]:
            change, within = scan(text, inside)
            depth, inside = depth + change, within
            if not within and depth == -1:  # the end of the file, behind which there is no }
                whole = "".join([*held, text])
                kind = "empty" if pos == 0 and _END[True].match(whole) else "last" if pos > 0 and _END[False].match(whole) else "bad"
                out.append((*key, pos, kind, None))
                held = []
                continue
            held.append(text + "}")
            if not within and depth == 1:
                whole = "".join(held)
                out.append((*key, pos, "whole" if begun else "end", whole))
                held, begun, pos = [], True, pos + 1
            elif not within and depth < 1:
                out.append((*key, pos, "bad", None))
                held, begun = [], True
        if out:
            yield pd.DataFrame(out, columns=["path", "start", "pos", "kind", "value"])
    if key is not None and (left := rest()):
        yield pd.DataFrame(left, columns=["path", "start", "pos", "kind", "value"])


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Takes the bracket or comma off the front of entries; those without the right one are bad."""
    for batch in batches:
        kinds, values = [], []
        for pos, kind, value in zip(batch["pos"], batch["kind"], batch["value"], strict=True):
            m = _BEFORE[pos == 0].match(value) if kind == "whole" else None
            kinds.append(kind if m or kind != "whole" else "bad")
            values.append(value[m.end() :] if m else None)
        yield batch.assign(kind=kinds, value=values)


def entries(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, pos, kind, value of all array entries of the files: ``whole`` entries with their JSON text, a row ``last`` (or
    ``empty``) for each whole file, and ``bad`` ones where a file is no array of objects."""
    pieces = _pieces(spark, folder, glob)
    begins = _beginnings(pieces).persist()
    few = begins.count() <= RANGES
    met = pieces.join(F.broadcast(begins) if few else begins, ["path", "start"])
    # A broadcast leaves the pieces as they were read; after a shuffle they are put back in order.
    met = met if few else met.repartition("path", "start").sortWithinPartitions("path", "start", "nth")
    cut = met.select("path", "start", "value", "depth", "inside", "entries").mapInPandas(_cut, _ENTRY)
    across = cut.where(F.col("kind").isin("begin", "middle", "end"))
    joined = across.groupBy("path", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value"), F.bool_or(F.col("kind") == "begin").alias("b"), F.bool_or(F.col("kind") == "end").alias("e"))
    joined = joined.select("path", F.lit(0).cast("long").alias("start"), "pos", F.when(F.col("b") & F.col("e"), "whole").otherwise("bad").alias("kind"), "value")
    out = cut.where(~F.col("kind").isin("begin", "middle", "end")).unionByName(joined).mapInPandas(_checked, _ENTRY).drop("start")
    return out


def read_documents(spark: SparkSession, folder: str, glob: str, fields: tuple[str, ...], key: str, strict: bool = True) -> DataFrame:
    """As ``documents.read_documents``, for files of any size: neither a file nor an array is ever one row.

    Not strict: entries that aren't objects with all fields as strings are left out, as is what isn't JSON.
    """
    found = entries(spark, folder, glob)
    name = F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))), r"\.json$", "").alias(key)
    latest = found.select(name, "path").distinct().withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("path")))).where("r = 1").select("path")
    found = found.join(latest, "path", "left_semi")
    one = found.where("kind = 'whole'").select(name, "path", "pos", F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    if strict:
        ends = found.groupBy("path").agg(F.count_if(F.col("kind").isin("last", "empty")).alias("ends"), F.count_if(F.col("kind") == "bad").alias("bad")).where("ends != 1 OR bad > 0")
        broken = ends.select("path").unionByName(documents.malformed(one, fields).select("path")).distinct().limit(5).collect()
        if broken:
            raise MalformedDocument("not arrays of the expected objects: " + ", ".join(r["path"] for r in broken))
    else:
        one = one.join(documents.malformed(one, fields).select("path", "pos"), ["path", "pos"], "left_anti")
    e = F.from_json("value", documents.entry_type(fields))[0]
    rows = one.select(key, F.col("pos").cast("int").alias("pos"), e.alias("e")).select(key, "pos", *[F.col(f"e.{f}").alias(f) for f in fields])
    none = found.where("kind = 'empty'").select(name, F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast("string").alias(f) for f in fields])
    return rows.unionByName(none)
