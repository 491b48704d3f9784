"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, scratch

#: Modulus of the round function; halves stay below it, so that no product leaves 64 bits.
PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys from a multiplicative generator; they depend on the seed alone."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        x = x * 48271 % PRIME
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds 0 .. n-1."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """One pass of the permutation of 0 .. 4**bits - 1."""
    mask = np.int64((1 << bits) - 1)
    left, right = x >> bits, x & mask
    for key in keys:
        mixed = (right + key) % PRIME
        left, right = right, left ^ ((mixed * mixed + key) % PRIME & mask)
    return (left << bits) | right


def unfeistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = np.int64((1 << bits) - 1)
    left, right = x >> bits, x & mask
    for key in reversed(keys):
        mixed = (left + key) % PRIME
        left, right = right ^ ((mixed * mixed + key) % PRIME & mask), left
    return (left << bits) | right


def _walk(step, x: np.ndarray, n: int) -> np.ndarray:
    out = step(np.asarray(x, dtype=np.int64))
    while (far := out >= n).any():  # cycle walking: outside 0 .. n-1 the permutation is applied again
        out[far] = step(out[far])
    return out


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of row number x in the shuffled order of n rows; a bijection of 0 .. n-1."""
    bits, keys = half_bits(n), round_keys(seed)
    return _walk(lambda v: feistel(v, bits, keys), x, n)


def unpermute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    bits, keys = half_bits(n), round_keys(seed)
    return _walk(lambda v: unfeistel(v, bits, keys), x, n)


def locate(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, computed without any table."""
    place = int(permute(np.array([row_number]), n, seed)[0])
    return place % shards, place // shards


def resolve(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that stands in a slot of a shard."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def with_row_number(df: DataFrame, keys: list[str], name: str = "row_number", tag: str = "rows") -> tuple[DataFrame, int]:
    """Gapless global row numbers in the order of ``keys`` (nulls first), and the row count.

    Range partitions are sorted and written once; each row's number is its place in its partition plus the
    rows of the partitions before, of which there are as many as shuffle partitions. Equal keys are spread by
    a tie-breaker, so a key shared by many rows doesn't fill one task; rows equal in all keys may swap numbers.
    """
    n = partitions(df.sparkSession)
    own = df.withColumn("__lexweft_tie", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(n, *keys, "__lexweft_tie").sortWithinPartitions(*keys, "__lexweft_tie").drop("__lexweft_tie")
    place = F.monotonically_increasing_id()
    numbered = scratch(ranged.withColumns({"__lexweft_part": F.shiftright(place, 33), "__lexweft_at": place.bitwiseAND((1 << 33) - 1)}), tag)
    counts = {r["__lexweft_part"]: r["n"] for r in numbered.groupBy("__lexweft_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(starts, "__lexweft_part long, __lexweft_start long")
    return numbered.join(F.broadcast(offsets), "__lexweft_part").withColumn(name, F.col("__lexweft_at") + F.col("__lexweft_start")).drop("__lexweft_part", "__lexweft_at", "__lexweft_start"), total


def shard(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """Deals documents into ``shards`` under the law ``rows``: counts differ by one at most.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law). Row numbers follow
    doc_id (nulls first), then checksum and size. Null text: size 1, checksum null; empty text: size 1,
    checksum 0. Repeated rows each get a place of their own; equal rows are interchangeable. An empty table
    gives no rows. Texts are measured and summed whole, however long. Other columns are not read.
    """
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows, n = with_row_number(skinny, ["doc_id", "text_crc32", "size"], tag="shard")

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    placed = rows.withColumn("__lexweft_place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__lexweft_place") % shards).cast("int").alias("shard"), F.expr(f"__lexweft_place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
