"""Importance resampling towards a target distribution, by hashed n-gram counts in persisted sparse (CSR) blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, tidied
from .sharding import with_row_number

BUCKETS = 10_000
#: Documents of fewer words aren't drawn; percentage of the others that is.
LEAST_WORDS, PERCENT = 20, 5
#: Features and rows after which a block is closed; bytes of a file's row groups, which readers hold whole.
BLOCK, ROWS, GROUP = 1 << 16, 4096, 8 << 20
#: Features of a document from which its buckets are counted by a table instead of sorting.
DENSE = 512

_A, _Z = ord("A"), ord("Z")
#: Bytes of words, A-Z lower-cased; all others are blanks. Words are digits, letters, and whatever isn't ASCII.
_BYTES = bytes(b + 32 if _A <= b <= _Z else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BLOCK = "ids array<long>, words array<int>, starts binary, buckets binary, counts binary"


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the checksums of all runs of one to three words (a checksum goes on where a run goes on)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
    spaced = [b" " + w for w in words[1:]]
    one = [*map(crc32, words)]
    two = [*map(crc32, spaced, one)]
    three = [*map(crc32, spaced[1:], two)]
    return len(words), np.fromiter(chain(one, two, three), np.uint32, len(one) + len(two) + len(three))


def counted(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, a text's buckets in rising order, and its counts in them."""
    n, made = features(text)
    made %= np.uint32(buckets)
    if len(made) < DENSE:
        own, counts = np.unique(made, return_counts=True)
    else:
        full = np.bincount(made, minlength=buckets)
        own = np.flatnonzero(full)
        counts = full[own]
    return n, own.astype(np.uint32), counts.astype(np.uint32)


def matrix(df: DataFrame, key: str | None = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of rows by buckets in CSR blocks of many rows: ids, words, and starts, buckets, counts as bytes.

    Blocks hold up to ROWS rows and, but for one long text, about BLOCK features, however long a text is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, own, counts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            parts = [pa.array([v], type=pa.binary()) for v in (starts.tobytes(), np.concatenate(own).astype(np.uint32).tobytes(), np.concatenate(counts).astype(np.uint32).tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([ids], type=pa.list_(pa.int64())), pa.array([words], type=pa.list_(pa.int32())), *parts], names=["ids", "words", "starts", "buckets", "counts"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                n, b, c = counted(t.as_py(), buckets)
                ids.append(i.as_py())
                words.append(n)
                own.append(b)
                counts.append(c)
                held += len(b)
                if held >= BLOCK or len(ids) >= ROWS:
                    yield block()
                    ids, words, own, counts, held = [], [], [], [], 0
        if ids:
            yield block()

    return df.select((F.col(key) if key else F.lit(None)).cast("long"), F.col(text).cast("string")).mapInArrow(tidied(run), _BLOCK)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the batch, starts, buckets and counts of each block."""
    for i in range(batch.num_rows):
        starts, own, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind) for c, kind in (("starts", np.int64), ("buckets", np.uint32), ("counts", np.uint32)))
        yield i, starts, own, counts


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; a task gives a row for each bucket that it has, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, own, counts in _parts(batch):
                total += np.bincount(own, weights=counts, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in blocks.select("starts", "buckets", "counts").mapInArrow(tidied(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share by the smoothed source share) of each bucket, in doubles."""
    s, t, all_s, all_t, n = source.astype(np.float64), target.astype(np.float64), float(source.sum()), float(target.sum()), len(source)
    return np.floor(1000 * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))).astype(np.int64)


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features, weight: the product of the matrix with the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, starts, own, counts in _parts(batch):
                upto = np.concatenate([[0], np.cumsum(gain[own] * counts.astype(np.int64))])
                words = batch.column("words")[i].values
                n = words.to_numpy(zero_copy_only=False).astype(np.int64)
                grams = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, words, pa.array(grams), pa.array(upto[starts[1:]] - upto[starts[:-1]])], names=["doc_id", "words", "n_features", "weight"])

    return blocks.mapInArrow(tidied(run), "doc_id long, words int, n_features long, weight long")


def perturbed(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds score: the weight and 1000 times a Gumbel draw from a hash of doc_id, so that the highest scores are a sample without replacement by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document, drawn towards ``target``'s texts.

    Both distributions are column sums over all rows. Null and empty texts have no features and weigh 0; they, as all
    documents under ``least_words`` words, aren't drawn. A null doc_id is drawn by the hash of no digits and comes last
    of ties, which go to the smaller doc_id; rows that share one are documents of their own, ordered by weight and
    features. Texts are counted whole. Without any target text the weights come from the source alone. An empty table
    gives no rows. Ranks are row numbers over range partitions, so no task holds all. Other columns are not read.
    """
    blocks = scratch(matrix(docs, buckets=buckets), "resample-matrix", **{"compression": "zstd", "parquet.block.size": str(GROUP)})
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, None, buckets=buckets), buckets))
    scored = scratch(perturbed(weigh(blocks, gain), seed), "resample-scores")
    able = scored.where(F.col("words") >= least_words).withColumns({"__lexweft_back": -F.col("score"), "__lexweft_last": F.col("doc_id").isNull()})
    ranked, n = with_row_number(able, ["__lexweft_back", "__lexweft_last", "doc_id", "weight", "n_features"], tag="resample-ranks")
    rank = F.when(F.col("row_number") < percent * n // 100, F.col("row_number") + 1)
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", rank).select(columns).unionByName(rest.select(columns))
