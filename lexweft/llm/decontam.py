"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask such as 110110 hashes the words of a window at its 1 positions and ignores the others, so a replaced
word at a 0 leaves the hash as it is. Windows of documents meet windows of benchmark items by hash; each hit
fixes an alignment, along which words are compared one by one, tolerating substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Fixed masks. Of n words with at most a quarter replaced, three in a row are left, or with n = 5 and n = 8, where runs may
#: be shorter, two pairs around one word. So every overlap of the default ``least`` is hit.
MASKS = ("111", "11011")
#: Items with fewer words than this can't be told from chance within a text; they match texts of just these words.
FEWEST = 5
#: Rows of the benchmark's index up to which it is broadcast (24 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Words of an item that a partial leak is counted in.
SPAN = 24


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(hashes: str, at: str, masks: tuple[str, ...]) -> Column:
    """The masks' hashes of the window that starts at position ``at`` of the array ``hashes``."""
    each = []
    for m, mask in enumerate(masks):
        own = ", ".join(f"get({hashes}, {at} + {i})" for i, bit in enumerate(mask) if bit == "1")
        each.append(f"if({at} + {len(mask)} <= n, xxhash64({m}, {own}), null)")
    return F.explode(F.expr(f"array({', '.join(each)})"))


def _windows(df: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each window and mask: ``keep``, the position ``at`` and the seed ``h``."""
    shortest = min(map(len, masks))
    at = df.where(F.col("n") >= shortest).withColumn("at", F.explode(F.expr(f"sequence(0, n - {shortest})")))
    return at.select(*keep, "at", seeds("wh", "at", masks).alias("h")).where(F.col("h").isNotNull())


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, partial: int = 21) -> DataFrame:
    """doc_id, text_hash, item_id, offset, matched, item_words: the best overlap of each document with each item.

    An overlap counts if, along the alignment of a hit, at least ``least`` of the item's words stand in the
    document, or at least ``partial`` of 24 words in a row. offset: the word of the document at which
    the item would begin (negative if cut off); of ties between alignments the first counts. Null texts are empty and
    match nothing; items under five words match texts of the same words and no more. Texts are read whole, however long.
    Rows equal in doc_id and text are one document; repeated items are one. Other columns aren't read. Either table may
    be empty.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("wh")).distinct()
    every = scratch(items.withColumns({"n": F.size("wh"), "item": F.xxhash64("item_id", "wh")}).where("n > 0"), "items")
    items, short = every.where(F.col("n") >= FEWEST), every.where(F.col("n") < FEWEST)
    index = scratch(_windows(items, MASKS, "item", "n").withColumnsRenamed({"at": "item_at", "n": "item_words"}), "seeds")
    whole = _bounded(items.select("item", "item_id", F.col("wh").alias("item_wh")), items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("wh")).withColumn("n", F.size("wh"))
    offset = (F.col("at") - F.col("item_at")).alias("offset")
    if index.count() <= BROADCAST_ROWS:
        hits = _windows(own, MASKS, "doc_id", "text_hash", "wh").join(F.broadcast(index), "h").select("doc_id", "text_hash", "wh", "item", "item_words", offset)
    else:  # windows are shuffled by seed without the words, which are fetched for hits only
        met = _windows(own, MASKS, "doc_id", "text_hash").join(index, "h").select("doc_id", "text_hash", "item", "item_words", offset).distinct()
        texts = own.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "wh")
        hits = met.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    hits = hits.join(whole, "item")
    # Each hit is compared where it is found: short seeds hit often by chance, and such hits aren't shuffled.
    same = "transform(item_wh, (w, p) -> if(coalesce(get(wh, offset + p), -1) = w, 1, 0))"
    hits = hits.select("doc_id", "text_hash", "item_id", "item_words", "offset", F.explode(F.expr(f"array({same})")).alias("same"))
    hits = hits.withColumn("matched", F.expr("aggregate(same, 0, (s, x) -> s + x)"))
    near = F.expr(f"exists(sequence(0, greatest(item_words - {SPAN}, 0)), c -> aggregate(slice(same, c + 1, {SPAN}), 0, (s, x) -> s + x) >= {partial})")
    found = hits.where((F.col("matched") >= least * F.col("item_words")) | F.when(F.col("matched") >= partial, near).otherwise(False))
    best = F.max(F.struct("matched", (-F.col("offset")).alias("back"), "item_words")).alias("best")
    out = found.groupBy("doc_id", "text_hash", "item_id").agg(best)
    out = out.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("offset"), F.col("best.matched").alias("matched"), F.col("best.item_words").alias("item_words"))
    if short.isEmpty():
        return out
    few = own.where(F.col("n").between(1, FEWEST - 1)).select("doc_id", "text_hash", "wh").distinct()
    same = few.join(short.select("item_id", "wh", "n"), "wh").select("doc_id", "text_hash", "item_id", F.lit(0).alias("offset"), F.col("n").alias("matched"), F.col("n").alias("item_words"))
    return out.unionByName(same)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that overlap no benchmark item (null-safe in doc_id)."""
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias("__lexweft_leak_id"), F.col("text_hash").alias("__lexweft_leak_hash")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__lexweft_leak_id")) & (F.xxhash64("text") == F.col("__lexweft_leak_hash"))
    return docs.join(leaks, on, "left_anti")
