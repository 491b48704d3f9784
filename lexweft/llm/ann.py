"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample by balanced splitting, so that lists stay of like size. Every vector is
posted to its nearest centroid and, if it lies near a border, to the next ones within a distance ratio. A query
walks an in-memory graph of centroids, keeps the lists within a ratio of the nearest one, however many they are, and
is compared with their members exactly. The ratio is fitted on the sample, so that the wanted share of its neighbours is
found: in clusters a few lists do, without any it takes many. Equal vectors are one posting with its smallest ids. Lists of very many
vectors are dealt out in parts, which every query of the list visits.

Distances are told apart on vectors moved to the sample's mean, with an error bound, and the nearest ones then ranked by
their exact differences, so a common offset costs no precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    """k neighbours; ``sample`` distinct vectors at most fit the centroids, one list for ``per_list`` vectors, but
    at most one for ``fit`` of the sample. ``closure``: a vector is posted to centroids within that ratio of its nearest
    distance, ``copies`` at most. ``reach``: lists within that ratio of the nearest one are searched; null: fitted to keep
    ``recall`` of the neighbours of ``probes`` vectors of the sample. ``beam``: centroids that the walk keeps at
    least, ``degree``: links of the graph. ``part``: vectors of a list from which it is split."""

    k: int = 10
    sample: int = 20_000
    per_list: int = 400
    fit: int = 16
    closure: float = 1.1
    copies: int = 4
    reach: float | None = None
    recall: float = 0.95
    probes: int = 400
    beam: int = 64
    degree: int = 24
    part: int = 20_000


def usable(vec: Column) -> Column:
    """Neither null, empty or zero, nor holding null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def balanced_centroids(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Centroids of up to n parts of x, always splitting the largest part in two halves of like size.

    The halves are cut at the median along the line between two 2-means centres, so no part stays large.
    """
    rng = np.random.default_rng(seed)
    heap = [(-len(x), 0, np.arange(len(x)))]
    tick = 1
    while len(heap) < n and -heap[0][0] > 1:
        _, _, own = heapq.heappop(heap)
        v = x[own]
        a, b = v[rng.choice(len(v), 2, replace=False)]
        for _ in range(6):
            side = ((v - (a + b) / 2) @ (a - b)) > 0
            if side.all() or not side.any():
                break
            a, b = v[side].mean(axis=0), v[~side].mean(axis=0)
        order = np.argsort((v - (a + b) / 2) @ (a - b), kind="stable")
        cut = min(max(int((~side).sum()), len(v) // 3), len(v) - len(v) // 3)  # between a third and two thirds
        for part in (own[order[:cut]], own[order[cut:]]):
            heapq.heappush(heap, (-len(part), tick, part))
            tick += 1
    centres = np.stack([x[p].mean(axis=0) for _, _, p in sorted(heap, key=lambda h: h[1])])
    return np.unique(centres, axis=0)


class CentroidGraph:
    """A neighbour graph of centroids, walked best first."""

    def __init__(self, centres: np.ndarray, settings: Settings, reach: float):
        self.centres, self.settings, self.reach = centres.astype(np.float64), settings, reach
        degree = min(settings.degree, len(centres) - 1)
        links: list[set[int]] = [set() for _ in centres]
        for lo in range(0, len(centres), 1024):
            d = squared(self.centres[lo : lo + 1024], self.centres)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :degree], lo):
                links[i].update(map(int, row))
                for j in row:
                    links[int(j)].add(i)  # both ways, so that every centroid can be reached
        self.links = [np.array(sorted(s), dtype=np.int64) for s in links]
        self.entries = np.arange(0, len(centres), max(1, len(centres) // 32))

    def lists(self, q: np.ndarray) -> np.ndarray:
        """The lists to search, nearest first: all met within ``reach`` of the nearest one.

        The walk goes on while its next centroid is within reach, or among the ``beam`` nearest ones.
        """
        dist = ((self.centres[self.entries] - q) ** 2).sum(axis=1)
        todo = [(d, int(c)) for d, c in zip(dist.tolist(), self.entries, strict=True)]
        found = dict((c, d) for d, c in todo)
        best = [-d for d, _ in todo]  # a heap of the beam nearest ones, the farthest on top
        heapq.heapify(todo)
        heapq.heapify(best)
        least, wide = min(found.values()), self.reach**2
        while todo:
            d, c = heapq.heappop(todo)
            if d > wide * least and len(best) >= self.settings.beam and d > -best[0]:
                break
            new = [int(x) for x in self.links[c] if int(x) not in found]
            if not new:
                continue
            for e, x in zip(((self.centres[new] - q) ** 2).sum(axis=1).tolist(), new, strict=True):
                found[x] = e
                least = min(least, e)
                heapq.heappush(todo, (e, x))
                heapq.heappush(best, -e)
                if len(best) > self.settings.beam:
                    heapq.heappop(best)
        near = sorted((d, c) for c, d in found.items() if d <= wide * least)
        return np.array([c for _, c in near])


def _postings(x: np.ndarray, centres: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every posting."""
    rows, lists = [], []
    for lo in range(0, len(x), 1024):
        d = np.sqrt(squared(x[lo : lo + 1024].astype(np.float64), centres))
        near = np.argsort(d, axis=1, kind="stable")[:, : settings.copies]
        own = np.take_along_axis(d, near, axis=1)
        r, c = np.nonzero(own <= settings.closure * own[:, :1])
        rows.append(r + lo)
        lists.append(near[r, c])
    return np.concatenate(rows), np.concatenate(lists)


def fitted(sample: np.ndarray, lists: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Centroids of a sample, and the ratio within which lists are searched.

    Each neighbour of a probe among the sample needs the ratio of its nearest list's distance to the nearest of all. The
    ratio errs on the safe side for a whole table: neighbours are nearer there, and centroids lie nearer to the
    sample's vectors than to others, so that other queries reach more lists.
    """
    centres = balanced_centroids(sample, max(1, lists))
    if len(centres) == 1 or settings.reach is not None:
        return centres, settings.reach or 1.0
    row, own = _postings(sample, centres, settings)
    start = np.searchsorted(row, np.arange(len(sample) + 1))
    at = np.arange(0, len(sample), max(1, len(sample) // settings.probes))
    needed = []
    for lo in range(0, len(at), 64):
        part = at[lo : lo + 64]
        away, d = np.sqrt(squared(sample[part], centres)), squared(sample[part], sample)
        d[np.arange(len(part)), part] = np.inf
        near = np.argpartition(d, min(settings.k, d.shape[1] - 1), axis=1)[:, : settings.k]
        needed += [away[i, own[start[j] : start[j + 1]]].min() / max(away[i].min(), 1e-300) for i, rows in enumerate(near) for j in rows]
    return centres, float(np.quantile(needed, settings.recall, method="higher"))


def nearest(q: np.ndarray, x: np.ndarray, mean: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
    """For each query the rows of x that may be among its k nearest, ties included, with their exact distances.

    Squares expanded on vectors moved to ``mean`` are off by a few rounding errors of the lengths involved; all rows within
    that of the k-th are kept.
    """
    qm, xm = q - mean, x - mean
    d = squared(qm, xm)
    # A bound of the rounding errors of both moves, the three sums of products and their sum.
    size = (qm * qm).sum(axis=1)[:, None] + (xm * xm).sum(axis=1)[None, :]
    moved = np.abs(mean).max(initial=0) * np.sqrt(size) * q.shape[1] ** 0.5
    off = 4 * np.finfo(np.float64).eps * (q.shape[1] * size + moved)
    out = []
    for i in range(len(q)):
        limit = np.partition(d[i] + off[i], k - 1)[k - 1] if len(x) > k else np.inf
        rows = np.flatnonzero(~(d[i] - off[i] > limit))  # sums that overflow rule nothing out
        # Summed in order, as any plain loop does.
        scores = np.sqrt(np.cumsum((q[i] - x[rows]) ** 2, axis=1)[:, -1])
        out.append([*zip(rows.tolist(), scores.tolist(), strict=True)])
    return out


def search(embeddings: DataFrame, settings: Settings = Settings(), every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose vec_id is divisible by ``every``.

    Score: Euclidean distance in double precision. Ties go to the smaller vec_id; a query isn't its own
    neighbour. Null vec_ids, unusable vectors and those of another dimension than most take no part. Of rows
    that repeat a vec_id all take part, and those of a query's id are left out. Fewer than k candidates: all of
    them. Other columns aren't read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    k = settings.k
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], out)
    clean = clean.where(F.size("v") == dims[0]["d"]).withColumn("h", F.xxhash64("v"))
    # Of equal vectors, the k + 1 smallest ids: first within salted parts, then over all.
    rank = F.row_number().over(Window.partitionBy("h", "v", F.pmod("vec_id", F.lit(16))).orderBy("vec_id"))
    some = clean.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    some = some.withColumn("r", rank).where(F.col("r") <= k + 1)
    vectors = scratch(some.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n, width = vectors.count(), dims[0]["d"]
    sample = vectors.orderBy("h", "v").limit(settings.sample).select("v").toArrow().column("v").combine_chunks()
    sample = sample.values.to_numpy(zero_copy_only=False).reshape(-1, width)
    mean = sample.mean(axis=0)
    centres, reach = fitted(sample - mean, min(len(sample) // settings.fit, n // settings.per_list), settings)
    parts = max(1, round(n / len(centres) / settings.part))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, own = _postings(np.stack(batch["v"].to_numpy()) - mean, centres, settings)
                part = batch["h"].to_numpy()[row] % parts
                yield pd.DataFrame({"list": own, "part": part, "v": batch["v"].to_numpy()[row], "ids": batch["ids"].to_numpy()[row]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = CentroidGraph(centres, settings, reach)
        for batch in batches:
            if len(batch):
                chosen = [graph.lists(np.asarray(v) - mean) for v in batch["v"]]
                row = np.repeat(np.arange(len(batch)), [len(c) * parts for c in chosen])
                lists = np.repeat(np.concatenate(chosen), parts)
                part = np.tile(np.arange(parts), len(lists) // parts)
                yield pd.DataFrame({"list": lists, "part": part, "v": batch["v"].to_numpy()[row], "ids": [[i] for i in batch["vec_id"].to_numpy()[row]]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of up to BLOCK members of a list's part."""
        for batch in batches:
            for (own, at), part in batch.groupby(["list", "part"]):
                for lo in range(0, len(part), BLOCK):
                    piece = part.iloc[lo : lo + BLOCK]
                    yield pd.DataFrame({"list": [own], "part": [at], "v": [np.stack(piece["v"].to_numpy()).tobytes()], "ids": [np.concatenate(piece["ids"].to_numpy()).astype(np.int64).tobytes()], "sizes": [piece["ids"].map(len).to_numpy(dtype=np.int32).tobytes()]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for v, ids, sizes, qv, qid in zip(batch["v"], batch["ids"], batch["sizes"], batch["qv"], batch["qid"], strict=True):
                x, q = (np.frombuffer(b, dtype=np.float64).reshape(-1, width) for b in (v, qv))
                ids, qid = np.frombuffer(ids, dtype=np.int64), np.frombuffer(qid, dtype=np.int64)
                start = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int32))])
                near = nearest(q, x, mean, k + 1)
                found = []
                for i, query in enumerate(qid):
                    for j, score in near[i]:
                        found += [(int(query), int(c), score) for c in ids[start[j] : start[j + 1]] if c != query]
                if found:
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    packed = "list int, part int, v binary, ids binary, sizes binary"
    kinds = "list int, part int, v array<double>, ids array<long>"
    posted = vectors.select("h", "v", "ids").mapInPandas(post, kinds).repartition("list", "part").mapInPandas(pack, packed)
    queries = clean.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    asked = queries.mapInPandas(ask, kinds).repartition("list", "part").mapInPandas(pack, packed).select("list", "part", F.col("v").alias("qv"), F.col("ids").alias("qid"))
    # Spark can't tell into how many lists a query is copied, and would broadcast what it takes for few.
    near = posted.join(asked.hint("merge"), ["list", "part"]).select("v", "ids", "sizes", "qv", "qid").mapInPandas(compare, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
