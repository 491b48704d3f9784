"""Stage 1: every reference document ranked for every query document by its leading blocks and elements."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import scoring
from ..functions import text as tx
from ..functions import vectors as vx
from . import grid
from .shared import Tables

#: Document names up to which the smaller set of them is broadcast.
BROADCAST_NAMES = 500_000


def head(df: DataFrame, n: int) -> DataFrame:
    """The leading rows of each document by array position."""
    return df.where(F.col("pos") < n)


def with_statistics(df: DataFrame) -> DataFrame:
    return df.withColumns({"chars": tx.char_length(F.col("text")), "words": tx.word_count(F.col("text"))})


def max_pool(blocks: DataFrame, elements: DataFrame, config: Config) -> DataFrame:
    """query_id, pos, ref_id, score, element_pos: the best element of each document for each head block."""
    left, right = with_statistics(head(blocks, config.head)), with_statistics(head(elements, config.head))
    return grid.pooled(left, right, "cosine" if config.mode == "cosine" else "composite", config.digits)


def mean_scores(pooled: DataFrame, n: DataFrame, config: Config) -> DataFrame:
    """query_id, ref_id, content_units: the mean of pooled scores over the ``n`` head blocks of (query_id, n).

    Scores are added as whole numbers of their last digit, so a mean doesn't depend on the order of rows; halves of the
    last digit go away from zero.
    """
    totals = pooled.groupBy("query_id", "ref_id").agg(F.sum(scoring.units(F.col("score"), config.digits)).alias("total"))
    return totals.join(n.where("n > 0"), "query_id").select("query_id", "ref_id", scoring.divided(F.col("total"), F.col("n")).alias("content_units"))


def shared_names(queries: DataFrame, refs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """query_id, ref_id, shared: how many words the two names share, for pairs that share any.

    ``queries`` and ``refs`` have their names' word sets in ``name_words``. Pairs come from an inverted index of words, or
    are those in ``only``.
    """
    if only is not None:
        met = only.join(queries.select("query_id", F.col("name_words").alias("a")), "query_id").join(refs.select("ref_id", F.col("name_words").alias("b")), "ref_id")
        return met.select("query_id", "ref_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))
    left = queries.select("query_id", F.explode("name_words").alias("word"))
    right = refs.select("ref_id", F.explode("name_words").alias("word"))
    return left.join(right, "word").groupBy("query_id", "ref_id").agg(F.count("*").alias("shared"))


def document_scores(blocks: DataFrame, elements: DataFrame, config: Config, pooled: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """query_id, ref_id, content, filename, score, rank for all pairs of documents, or for those (query_id, ref_id) in ``only``.

    content: mean over the query's head blocks of their pooled scores; blocks without one (zero vectors) count 0.
    score: content blended with file-name similarity; a reference document without elements scores 0. Both are exact to
    the last of ``config.digits`` digits, whatever the partitions.
    Ranks go by score, ties to the smaller ref_id. ``blocks`` and ``elements`` may hold rows with null pos, which
    stand for empty documents.
    """
    digits = config.digits
    pooled = max_pool(blocks, elements, config) if pooled is None else pooled
    own = F.regexp_replace("query_id", "_processed$", "") if config.strip_suffix else F.col("query_id")
    queries = blocks.groupBy("query_id").agg(F.count_if(F.col("pos") < config.head).alias("n")).withColumn("name_words", tx.filename_words(own))
    refs = elements.groupBy("ref_id").agg((F.count("pos") == 0).alias("empty")).withColumn("name_words", tx.filename_words(F.col("ref_id")))
    sized = refs.select("ref_id", "empty", F.size("name_words").alias("ref_words"))
    asked = queries.select("query_id", "n", F.size("name_words").alias("query_words"))
    if only is not None:
        pairs = only.join(asked, "query_id").join(sized, "ref_id")
    else:
        pairs = asked.crossJoin(F.broadcast(sized) if elements.select("ref_id").distinct().count() <= BROADCAST_NAMES else sized)
    scored = pairs.join(mean_scores(pooled, queries.select("query_id", "n"), config), ["query_id", "ref_id"], "left").join(shared_names(queries, refs, only), ["query_id", "ref_id"], "left")
    nameless = (F.col("query_words") + F.col("ref_words") == 0).cast("long")  # two names without words are alike
    shared = F.coalesce("shared", F.lit(0).cast("long")) + nameless
    scored = scored.withColumns({"content_units": F.coalesce("content_units", F.lit(0).cast("long")), "shared": shared, "all_words": F.col("query_words") + F.col("ref_words") - shared + 2 * nameless})
    blended = scoring.blend_units(F.col("content_units"), F.col("shared"), F.col("all_words"), digits)
    scored = scored.withColumn("units", F.when(F.col("empty") | (F.col("n") == 0), F.lit(0).cast("long")).otherwise(blended))
    order = Window.partitionBy("query_id").orderBy(F.desc("units"), "ref_id")
    made = {"content": scoring.from_units(F.col("content_units"), digits), "filename": F.col("shared") / F.col("all_words"), "score": scoring.from_units(F.col("units"), digits), "rank": F.row_number().over(order)}
    return scored.withColumns(made).select("query_id", "ref_id", "content", "filename", "score", "rank")


def pooled_pairs(pairs: DataFrame, blocks: DataFrame, elements: DataFrame, config: Config) -> DataFrame:
    """As ``max_pool``, for the documents of ``pairs`` (query_id, ref_id) only, whose heads meet as two arrays."""
    row = F.struct("pos", "chars", "words", "vec")

    def heads(df: DataFrame, key: str, name: str) -> DataFrame:
        """A head's columns as arrays, its vectors one after another, which pass to Python as numpy arrays."""
        rows = with_statistics(head(df, config.head)).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return rows.select(key, *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in ("pos", "chars", "words")], F.flatten("rows.vec").alias(f"{name}_vec"))

    columns = [f"{side}_{c}" for side in ("left", "right") for c in ("pos", "chars", "words", "vec")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, r, pos, chars, words, x, at, chars2, words2, y in zip(*(batch[c] for c in ("query_id", "ref_id", *columns)), strict=True):
                x, y = (np.asarray(v, dtype=np.float64).reshape(n, -1) for v, n in ((x, len(pos)), (y, len(at))))
                score = grid.similarities(x, y, "cosine")
                if config.mode == "composite":
                    score = scoring.SEMANTIC * score + scoring.LENGTH * grid.ratios(chars, chars2) + scoring.WORDS * grid.ratios(words, words2)
                score = np.where(y.any(axis=1)[None, :], np.round(score, config.digits), -np.inf)
                best = score.argmax(axis=1)  # the first of equals
                for i in np.flatnonzero(x.any(axis=1) & (score.max(axis=1) > -np.inf)):
                    out.append((q, int(pos[i]), r, float(score[i, best[i]]), int(at[best[i]])))
            yield pd.DataFrame(out, columns=["query_id", "pos", "ref_id", "score", "element_pos"])

    met = pairs.join(heads(blocks, "query_id", "left"), "query_id").join(heads(elements, "ref_id", "right"), "ref_id")
    return met.select("query_id", "ref_id", *columns).mapInPandas(run, "query_id string, pos int, ref_id string, score double, element_pos int")


def top_documents(blocks: DataFrame, elements: DataFrame, config: Config, n: int, k: int = 32, rounds: int = 2, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best documents of each query as ``document_scores`` ranks them, and their pooled scores, without all pairs.

    A threshold algorithm: the k nearest heads of each head block give candidate documents, which are scored. A
    document that isn't among them has no head nearer than the k-th to any block, so its content is at most the mean of
    what the k-th cosines allow with equal lengths, and its name at most the same. Queries whose n-th candidate scores more
    than that are done; the others take eight times as many neighbours, and after ``rounds`` are scored with all
    documents, at once where there are no more of these than neighbours, as the lists of these aren't shorter then.
    What several steps read is written to ``tables``, so that plans stay short.
    """
    digits, cut = config.digits, (tables or Tables()).cut
    found, elements_head = blocks.where("pos is not null"), head(elements.where("pos is not null"), config.head)
    left, scores, pooled = blocks.select("query_id").distinct(), [], []
    n_refs, open_ = elements.select("ref_id").distinct().count(), True
    for _ in range(rounds):
        if n_refs <= k:
            break
        own = head(found, config.head).join(left, "query_id", "left_semi")
        near = cut(grid.knn(own.where(~vx.is_zero(F.col("vec"))), elements_head.where(~vx.is_zero(F.col("vec"))), k, "cosine", digits))
        each = near.groupBy("query_id", "pos").agg(F.min("semantic").alias("last"), F.count("*").alias("n"))
        most = scoring.SEMANTIC * F.col("last") + (scoring.LENGTH + scoring.WORDS) if config.mode == "composite" else F.col("last")
        over = each.groupBy("query_id").agg(F.sum(F.when(F.col("n") == k, F.greatest(most, F.lit(0.0))).otherwise(0.0)).alias("sum"))  # fewer than k: no other document has a vector
        counts = head(found, config.head).groupBy("query_id").agg(F.count("*").alias("heads"))
        bound = counts.join(over, "query_id", "left").select("query_id", (scoring.blend(F.coalesce("sum", F.lit(0.0)) / F.col("heads"), F.lit(1.0)) + 1e-6).alias("bound"))
        pairs = cut(near.select("query_id", "ref_id").distinct())
        got = cut(pooled_pairs(pairs, found, elements.where("pos is not null"), config))
        ranked = cut(document_scores(blocks.join(left, "query_id", "left_semi"), elements, config, got, pairs).where(F.col("rank") <= n))
        done = cut(ranked.where(F.col("rank") == n).join(bound, "query_id").where(F.col("score") > F.col("bound")).select("query_id"))
        scores.append(ranked.join(done, "query_id", "left_semi"))
        pooled.append(got.join(scores[-1].select("query_id", "ref_id"), ["query_id", "ref_id"], "left_semi"))
        left, k = cut(left.join(done, "query_id", "left_anti")), 8 * k
        open_ = not left.isEmpty()
        if not open_:
            break
    if open_:
        rest = blocks.join(left, "query_id", "left_semi") if scores else blocks
        full = cut(max_pool(rest.where("pos is not null"), elements.where("pos is not null"), config))
        scores.append(cut(document_scores(rest, elements, config, full).where(F.col("rank") <= n)))
        pooled.append(full.join(scores[-1].select("query_id", "ref_id"), ["query_id", "ref_id"], "left_semi"))
    union = lambda dfs: functools.reduce(DataFrame.unionByName, dfs)
    return union(scores), union(pooled)


def best_documents(scores: DataFrame) -> DataFrame:
    return scores.where("rank = 1").drop("rank")


def mean_pairwise(blocks: DataFrame, elements: DataFrame, config: Config) -> DataFrame:
    """An older scoring: the mean cosine of all pairs of head blocks and head elements.

    The mean of all dot products of unit vectors is the dot product of their sums, so no pair of rows is formed: sums of
    documents, of ``head`` rows each, meet as matrix products.
    """

    def sums(df: DataFrame, key: str) -> DataFrame:
        size = vx.norm(F.col("vec"))
        unit = head(df, config.head).select(key, F.col("vec"), size.alias("size"))
        unit = unit.select(key, F.expr("transform(vec, x -> if(size = 0, 0D, x / size))").alias("u"))
        each = unit.groupBy(key).agg(F.collect_list("u").alias("us"), F.count("*").alias("n"))
        return each.select(key, "n", F.expr("aggregate(slice(us, 2, size(us)), us[0], (a, u) -> zip_with(a, u, (x, y) -> x + y))").alias("vec"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["left"], batch["right"], strict=True):
                x, y = pickle.loads(a), pickle.loads(b)
                score = np.round(x["vec"] @ y["vec"].T / (x["n"][:, None] * y["n"][None, :]), config.digits)
                row, col = np.indices(score.shape).reshape(2, -1)
                yield pd.DataFrame({"query_id": x["query_id"][row], "ref_id": y["ref_id"][col], "score": score.ravel()})

    left, right = sums(blocks, "query_id"), sums(elements, "ref_id")
    pairs = grid.pair_up(grid.pack(left, ["query_id", "n", "vec"], "left"), grid.pack(right, ["ref_id", "n", "vec"], "right"), elements.select("ref_id").distinct().count(), config.dim)
    return pairs.mapInPandas(run, "query_id string, ref_id string, score double")
