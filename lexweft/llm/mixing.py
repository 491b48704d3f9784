"""Mixing sources to target weights: hash-random keys, a range sort within sources, prefix sums, and a cut at the budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_columns, partitions, scratch, tidied
from .sharding import with_row_number

#: Words as sizes count them.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in their order, repeated; times its size that a source is taken at most.
WEIGHTS, MOST = (5, 2, 1), 3


def keyed(docs: DataFrame, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and a hash-random key of doc_id and text, so that an order doesn't depend on how rows lie."""
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text").cast("binary"))}
    return docs.select(*[c.alias(f"__lexweft_{n}") for n, c in own.items()], *carry)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target: words to take of each source of ``rows`` (``keyed``'s).

    Sources in code-point order, null last, weigh ``weights``, repeated, and share ``share`` of all sizes; none gets
    more than ``most`` times its size, and what it leaves goes to the others by weight. Each round is one aggregate
    over sources; rounds end when no further source is full, after a few of them, and never exceed the sources.
    """
    sums = rows.groupBy("__lexweft_source").agg(F.sum("__lexweft_size").alias("__lexweft_size")).withColumn("__lexweft_last", F.col("__lexweft_source").isNull())
    ranked, _ = with_row_number(sums, ["__lexweft_last", "__lexweft_source"], "__lexweft_nth", tag="mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__lexweft_nth") % len(weights) + 1).cast("int"))
    sources = scratch(ranked.select(F.col("__lexweft_source").alias("source"), F.col("__lexweft_size").alias("source_size"), weight.cast("double").alias("weight"), (F.col("__lexweft_size") * most).alias("cap")), "mix-weights")
    full, held, level = F.lit(False), -1, 0.0
    while True:
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("left"), F.count_if(full).alias("n")).first()
        if r["n"] == held or not r["left"]:
            break
        held, level = r["n"], ((r["all"] or 0) * share - (r["capped"] or 0)) / r["left"]
        full = F.lit(level) * F.col("weight") > F.col("cap")
    return sources.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _running(rows: DataFrame) -> DataFrame:
    """Sorted rows with ``__lexweft_run``, the number of their source within the partition, and the words before them in it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__lexweft_run", T.IntegerType()), T.StructField("__lexweft_before", T.LongType())])
    size, source = rows.columns.index("__lexweft_size"), rows.columns.index("__lexweft_source")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, total = (), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            kinds = b.column(source).dictionary_encode()
            code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names, sizes = kinds.dictionary.to_pylist(), b.column(size).to_numpy(zero_copy_only=False)
            name = lambda c: names[c] if c >= 0 else None
            starts = np.flatnonzero(np.concatenate([[(name(code[0]),) != last], code[1:] != code[:-1]]))
            upto = np.cumsum(sizes)
            runs = run + np.searchsorted(starts, np.arange(b.num_rows), side="right")
            base = np.where(runs == run, -total, 0)  # what the batch before left of the same source
            if len(starts):
                base = np.where(runs > run, (upto - sizes)[starts][np.maximum(runs - run - 1, 0)], base)
            before = upto - sizes - base
            last, run, total = (name(code[-1]),), int(runs[-1]), int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs.astype(np.int32)), pa.array(before.astype(np.int64))], names=schema.names)

    return rows.mapInArrow(tidied(task), schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs, cut, source and ``carry``: how often the mix takes each document.

    Sizes are words. Within a source documents stand in the order of hash-random keys; the mix takes the source from
    the beginning, again from the beginning when it ends (``epochs`` whole times), and the last time as far as its target,
    rounded to a whole word: of the document there, ``cut`` words. So a source's taken words are its target within half
    a word, and no document is taken more than ``most`` times. Order and result depend on the rows alone.

    Null and empty texts have size 0 and are taken 0 words of. Null sources are one source, the last. Null doc_ids
    stay. Repeated rows are documents of their own; rows equal in doc_id, source and text may swap what is taken of
    them. Texts are counted whole. An empty table gives no rows. A source's rows lie in as many range partitions as they
    fill, so a large one isn't one task. Other columns are read only if carried (then under their own names, so not those
    that the result has).
    """
    n = partitions(docs.sparkSession)
    rows = scratch(keyed(docs, seed, carry), "mix-keys")
    plan = targets(rows, weights, most, share)
    order = [F.col("__lexweft_source").isNull(), *[F.col(f"__lexweft_{c}") for c in ("source", "key", "doc_id")]]
    own = rows.withColumn("__lexweft_tie", F.monotonically_increasing_id())  # equal rows don't make a partition larger
    ranged = own.repartitionByRange(n, *order, F.col("__lexweft_tie")).sortWithinPartitions(*order, F.col("__lexweft_tie"))
    placed = scratch(_running(ranged.drop("__lexweft_tie", "__lexweft_key").withColumn("__lexweft_part", F.spark_partition_id())), "mix-order")

    runs = placed.groupBy("__lexweft_part", "__lexweft_run").agg(F.first("__lexweft_source").alias("source"), F.sum("__lexweft_size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("__lexweft_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("__lexweft_part", "__lexweft_run", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    plan = plan.withColumns({"budget": budget, "epochs": whole}).withColumnRenamed("source", "own")
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("left", left)
    starts = starts.select("__lexweft_part", "__lexweft_run", *[F.col(c).alias(f"__lexweft_p_{c}") for c in ("source_size", "target", "epochs", "left")])

    out, p = placed.join(starts, ["__lexweft_part", "__lexweft_run"]), lambda c: F.col(f"__lexweft_p_{c}")
    cut = F.greatest(F.lit(0).cast("long"), F.least(p("left") - F.col("__lexweft_before"), F.col("__lexweft_size")))
    taken = p("epochs") * F.col("__lexweft_size") + cut
    return out.select(F.col("__lexweft_doc_id").alias("doc_id"), F.col("__lexweft_size").alias("size"), p("source_size").alias("source_size"), p("target").alias("target"), taken.alias("taken"), p("epochs").cast("long").alias("epochs"), cut.alias("cut"), F.col("__lexweft_source").alias("source"), *carry)


def expand(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: rows of ``mix(..., carry=(text,))`` as often as they are taken, with ``repeat`` from 0.

    A document's last, partial repeat holds its first ``cut`` words, with what stands before and between them.
    """
    word = re.compile(WORD)

    def head() -> object:
        def run(pairs: list) -> dict[str, list]:
            out = []
            for p in pairs:
                end = 0
                for i, m in enumerate(word.finditer(p["text"] or "")):
                    if i == p["words"]:
                        break
                    end = m.end()
                out.append((p["text"] or "")[:end])
            return {text: out}

        return run

    whole = mixed.where("epochs > 0 AND size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
    part = mixed.where("cut > 0").withColumn("repeat", F.col("epochs").cast("int"))
    part = part.withColumn("__lexweft_cut", F.struct(F.col(text).alias("text"), F.col("cut").alias("words"))).drop(text)
    return whole.unionByName(add_columns(part, "__lexweft_cut", f"`{text}` string", head).select(whole.columns))
