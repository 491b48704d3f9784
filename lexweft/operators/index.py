"""A persisted vector index: points in lists around centroids, kept as segments under a manifest.

Each upsert or delete writes one segment with only its own points and commits a new manifest, which names the segments
that count; the later segment wins. Compaction folds segments into one. A search first asks each query's likeliest
lists, which gives a score that its results must reach, and then every list that can hold a better point: a list's
points lie within its radius of its centroid, so none scores more than q·c + |q|·r. With the whole radius that is
exact; with a share of it, fitted on a sample of the queries to a wanted recall, it prunes more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConcurrentWrite, InvalidConfig
from ..functions import vectors as vx
from . import grid
from .shared import Tables

#: Points at most that centroids are fitted on, and lists at most (the driver holds as many centroids).
SAMPLE, LISTS = 20_000, 1024
#: Queries whose lists are sought at once, and points of a group of lists, which meet queries in one task.
BLOCK, SPREAD = 4096, 1 << 16
#: Share of rows in later segments, and number of segments, at which an upsert compacts.
DELTA_SHARE, SEGMENTS = 0.25, 16
#: Queries at most that a search fits its recall on; points, as a multiple of k, that the first lists hold at least.
PROBES, FIRST = 256, 10
#: What rounding may take from a bound.
SLACK = 1e-8
_POINT = "point_id long, ref_id string, pos int, vec array<double>, list int"


def centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Means of up to n clusters of the rows of x, by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    out = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, out)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(out))
        out = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], out)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def marked(lists: pd.Series, n: int) -> np.ndarray:
    """A row for each entry, true at the numbers that it lists."""
    out = np.zeros((len(lists), n), dtype=bool)
    for i, own in enumerate(lists):
        out[i, own] = True
    return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class Lists:
    """What a search knows of the lists: centroids, numbers of points, radii; and the metric."""

    centres: np.ndarray
    held: np.ndarray
    radius: np.ndarray
    metric: str

    def place(self, x: np.ndarray) -> np.ndarray:
        """Vectors as lists see them: of length one if the metric is the cosine."""
        return unit(x) if self.metric == "cosine" else x

    def first(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all centroids, and whether a list is among each row's likeliest that hold FIRST * k points together."""
        like = self.place(x) @ self.centres.T
        order = np.argsort(-like, axis=1, kind="stable")
        upto = np.cumsum(self.held[order], axis=1) - self.held[order]
        chosen = np.zeros(like.shape, dtype=bool)
        np.put_along_axis(chosen, order, upto < FIRST * k, axis=1)
        return like, chosen & (self.held > 0)[None, :]

    def bound(self, x: np.ndarray, like: np.ndarray, share: float) -> np.ndarray:
        """What no point of a list scores more than, by ``share`` of its radius."""
        return like + share * np.linalg.norm(self.place(x), axis=1)[:, None] * self.radius[None, :] + SLACK


class VectorIndex:
    """Points (point_id, ref_id, pos, vec) under ``path``.

    An index that is there is opened as it is; else the first upsert makes it. Versions are manifests committed by
    creating a file that must not exist, so of two writers at once one commits first and the other on top of it.
    Readers go on with the segments of their version; those that no recent version names go at the next compaction.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, metric: str = "dot"):
        if metric not in ("dot", "cosine"):
            raise InvalidConfig("unknown metric")
        self.spark, self.path, self.dim, self.metric = spark, path.rstrip("/"), dim, metric
        self._tables = Tables()

    # --- versions ------------------------------------------------------------------------------------------------

    def _files(self, path: str | None = None):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path or self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        _, files, root = self._files()
        return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last one; version 0 without points where there is none."""
        held = self.versions()
        if not held:
            return {"version": 0, "centres": None, "segments": []}
        jvm, files, at = self._files(f"{self.path}/manifest-{version or held[-1]:08d}.json")
        stream = files.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Whether this manifest became its version; False if another writer's did.

        The whole file is written under another name first. Its last step fails where the target is there: a hard link
        in a local file system, elsewhere a rename that doesn't overwrite.
        """
        target = f"{self.path}/manifest-{manifest['version']:08d}.json"
        jvm, files, at = self._files(f"{self.path}/_manifest-{uuid.uuid4().hex}")
        stream = files.create(at, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = jvm.org.apache.hadoop.fs.Path(target)
        try:
            if files.getUri().getScheme() == "file":
                nio = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(nio(final), nio(at))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(at, final, none)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            files.delete(at, False)

    def _publish(self, change, tries: int = 20) -> dict:
        """Commits ``change`` of the last manifest, again on top of what other writers commit meanwhile."""
        for _ in range(tries):
            last = self.manifest()
            new = change(last) | {"version": last["version"] + 1}
            if self._commit(new):
                return new
        raise ConcurrentWrite(f"{self.path}: {tries} other writers came first")

    # --- points --------------------------------------------------------------------------------------------------

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(_POINT).parquet(f"{self.path}/segments/{name}/points")

    def points(self, manifest: dict | None = None) -> DataFrame:
        """The points that count: of those with one id the last written, without deleted ones."""
        manifest = manifest or self.manifest()
        if not manifest["segments"]:
            raise InvalidConfig(f"no index in {self.path}")
        base, *later = manifest["segments"]
        own = self._segment(base["name"])
        if later:
            newer = None
            for at, s in enumerate(later):
                part = self._segment(s["name"]).withColumn("_at", F.lit(at))
                newer = part if newer is None else newer.unionByName(part)
            last = newer.select("point_id", "_at").groupBy("point_id").agg(F.max("_at").alias("_at"))
            own = own.join(last.select("point_id"), "point_id", "left_anti").unionByName(newer.join(last, ["point_id", "_at"], "left_semi").drop("_at"))
        return own.where("vec is not null").select("point_id", "ref_id", "pos", "vec", "list")

    def centres(self, manifest: dict | None = None) -> np.ndarray:
        manifest = manifest or self.manifest()
        return np.array([r["c"] for r in self.spark.read.schema("list int, c array<double>").parquet(f"{self.path}/{manifest['centres']}").orderBy("list").collect()])

    def _fit(self, points: DataFrame, n: int) -> tuple[str, np.ndarray]:
        """Centroids of a sample of the points, and the folder that they are written to."""
        x = np.array([r["vec"] for r in self._sample(points, n).select("vec").collect()])
        made = centroids(unit(x) if self.metric == "cosine" else x, self._wanted(n))
        name = f"centres-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made)], "list int, c array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        return name, made

    @staticmethod
    def _sample(points: DataFrame, n: int) -> DataFrame:
        """Of n points the SAMPLE of smallest hash.

        Only hashes that so many are sure to lie under are asked for: else each partition would send its own SAMPLE first
        points to the driver, which is all there are.
        """
        at, share = F.xxhash64("point_id"), (SAMPLE + 8 * SAMPLE**0.5) / max(n, 1)
        some = points.where(at < int((share - 0.5) * 2**64)) if share < 1 else points
        return some.orderBy(at).limit(SAMPLE)

    @staticmethod
    def _wanted(n: int) -> int:
        return max(1, min(LISTS, int(np.sqrt(n))))

    def _write(self, rows: DataFrame, centres: np.ndarray) -> dict:
        """Writes rows (null vec: deleted) as a segment in the order of lists; returns what the manifest says of it."""
        lists = Lists(centres, np.zeros(len(centres)), np.zeros(len(centres)), self.metric)
        name, there = uuid.uuid4().hex, F.col("vec").isNotNull()

        def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = lists.place(stacked(batch["vec"]))
                    own = nearest(x, centres)
                    yield batch.assign(list=own, off=np.linalg.norm(x - centres[own], axis=1))

        columns = ["point_id", "ref_id", "pos", "vec"]
        posted = rows.where(there).select(columns).mapInPandas(post, f"{_POINT}, off double")
        gone = rows.where(~there).select(*columns, F.lit(None).cast("int").alias("list"), F.lit(None).cast("double").alias("off"))
        full = posted.unionByName(gone)
        full.repartition("list", F.pmod(F.xxhash64("point_id"), F.lit(8))).sortWithinPartitions("list").write.parquet(f"{self.path}/segments/{name}/points")
        written = self.spark.read.schema(f"{_POINT}, off double").parquet(f"{self.path}/segments/{name}/points")
        each = written.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()  # a row for each list
        held = [[r["list"], r["n"], r["radius"]] for r in each if r["list"] is not None]
        return {"name": name, "n": sum(r["n"] for r in each), "lists": held}

    def _checked(self, points: DataFrame) -> DataFrame:
        new = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("ref_id").cast("string").alias("ref_id"), F.col("pos").cast("int").alias("pos"), vx.truncate(F.col("vec"), self.dim).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
        fit = F.when(F.size("vec") == self.dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector hasn't {self.dim} components")))
        last = F.max(F.struct("ref_id", "pos", "vec")).alias("p")
        return new.withColumn("vec", fit).groupBy("point_id").agg(last).select("point_id", "p.ref_id", "p.pos", "p.vec")

    def upsert(self, points: DataFrame) -> None:
        """Adds points, in place of those with the same ids; of equal ids in one call the largest (ref_id, pos) counts."""
        new, held = self._checked(points), self.manifest()
        if held["segments"]:
            self._append(new, held)
            return
        new = new.persist()
        try:
            n = new.count()
            if not n:
                return
            name, centres = self._fit(new, n)
            segment = self._write(new, centres)
        finally:
            new.unpersist()
        made = {"version": 1, "centres": name, "segments": [segment]}
        if not self._commit(made):  # another writer made the index meanwhile: these points go to its lists
            self._append(self._segment(segment["name"]).drop("list"), self.manifest())
            self._drop(f"segments/{segment['name']}", name)

    def delete(self, ids: DataFrame) -> None:
        """Takes the points of these point_ids out."""
        gone = ids.select(F.col("point_id").cast("long").alias("point_id")).distinct()
        self._append(gone.select("point_id", *[F.lit(None).cast(t).alias(c) for c, t in (("ref_id", "string"), ("pos", "int"), ("vec", "array<double>"))]), self.manifest())

    def _append(self, rows: DataFrame, held: dict) -> None:
        while True:
            segment = self._write(rows, self.centres(held))
            refit = []

            def add(last: dict) -> dict:
                if last["centres"] != held["centres"]:  # lists were fitted anew meanwhile
                    refit.append(last)
                    return last
                return last | {"segments": last["segments"] + [segment] if segment["n"] else last["segments"]}

            new = self._publish(add)
            if not refit:
                break
            held = refit[-1]
        later = new["segments"][1:]
        if len(later) >= SEGMENTS or sum(s["n"] for s in later) > DELTA_SHARE * new["segments"][0]["n"]:
            self.compact()

    def compact(self) -> None:
        """Folds all segments into one, and fits lists anew where there should be twice as many.

        Segments that other writers add meanwhile stay behind it, unless the lists are new: then it is given up, for
        the next one to do.
        """
        held = self.manifest()
        if not held["segments"]:
            return
        own = self.points(held).drop("list")
        total, name, centres = sum(s["n"] for s in held["segments"]), held["centres"], self.centres(held)
        if self._wanted(total) >= 2 * len(centres):
            name, centres = self._fit(own, total)
        segment, folded, late = self._write(own, centres), {s["name"] for s in held["segments"]}, []

        def fold(last: dict) -> dict:
            rest = [s for s in last["segments"] if s["name"] not in folded]
            late[:] = [last["centres"] != held["centres"] or (rest and name != held["centres"]) or len(rest) + len(folded) != len(last["segments"])]
            return last if late[0] else {"centres": name, "segments": [segment, *rest]}

        self._publish(fold)
        if late[0]:
            self._drop(f"segments/{segment['name']}")
        else:
            self._tidy()

    def _tidy(self) -> None:
        """Deletes manifests but the last two before a compaction, and what only they name."""
        held = self.versions()
        recent = [self.manifest(v) for v in held[-2:]]
        named = {s["name"] for m in recent for s in m["segments"]} | {m["centres"] for m in recent}
        old = [self.manifest(v) for v in held[:-2]]
        for m in old:
            self._drop(*[f"segments/{s['name']}" for s in m["segments"] if s["name"] not in named], *([m["centres"]] if m["centres"] not in named else []), f"manifest-{m['version']:08d}.json")

    def _drop(self, *names: str) -> None:
        for name in names:
            _, files, at = self._files(f"{self.path}/{name}")
            files.delete(at, True)

    def clear(self) -> None:
        self._drop(*[n for n in self._names() if n.startswith(("manifest-", "_manifest-", "centres-"))], "segments")

    def release(self) -> None:
        """Lets go of what searches keep."""
        self._tables.clear()

    # --- search --------------------------------------------------------------------------------------------------

    def lists(self, manifest: dict | None = None) -> Lists:
        manifest = manifest or self.manifest()
        if not manifest["segments"]:
            raise InvalidConfig(f"no index in {self.path}")
        centres = self.centres(manifest)
        held, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
        for s in manifest["segments"]:
            for at, n, r in s["lists"]:
                held[at] += n
                radius[at] = max(radius[at], r)
        return Lists(centres, held, radius * (1 + 1e-9), self.metric)

    def share(self, queries: DataFrame, k: int, recall: float, digits: int = 9, manifest: dict | None = None) -> float:
        """The share of radii at which a sample of up to PROBES queries finds ``recall`` of its true k best.

        One pass compares the sample with every point: it gives each query's best over all lists and over its first
        ones, from which follows what share would have asked the list of each of the best.
        """
        if recall >= 1:
            return 1.0
        manifest = manifest or self.manifest()
        lists, metric = self.lists(manifest), self.metric
        sample = [r["vec"] for r in queries.where(~vx.is_zero(F.col("vec"))).orderBy(F.xxhash64("query_id", "pos"), "query_id", "pos").limit(PROBES).select("vec").collect()]
        if not sample:
            return 1.0
        x = np.array(sample)
        like, chosen = lists.first(x, k)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                score, own = np.round(grid.similarities(x, stacked(batch["vec"]), metric), digits), batch["list"].to_numpy()
                for only in (False, True):
                    seen = np.where(chosen[:, own], score, -np.inf) if only else score
                    top = np.argsort(-seen, axis=1, kind="stable")[:, :k]
                    row, got = np.repeat(np.arange(len(x)), top.shape[1]), np.take_along_axis(seen, top, axis=1).ravel()
                    yield pd.DataFrame({"row": row, "only": only, "list": own[top.ravel()], "score": got})[np.isfinite(got)]

        found = self.points(manifest).select("vec", "list").mapInPandas(best, "row int, only boolean, list int, score double")
        order = Window.partitionBy("row", "only").orderBy(F.desc("score"), "list")
        top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()  # 2 k rows for each of the sample
        reach = top[top["only"] & (top["r"] == k)].set_index("row")["score"].reindex(np.arange(len(x)), fill_value=-np.inf).to_numpy()
        true = top[~top["only"]]
        row, own = true["row"].to_numpy(), true["list"].to_numpy()
        size = np.linalg.norm(lists.place(x), axis=1)[row] * lists.radius[own]
        gap = reach[row] - like[row, own]
        need = np.where(chosen[row, own] | ~np.isfinite(gap), -np.inf, np.divide(gap, size, out=np.full(len(row), np.inf), where=size > 0))
        need = np.sort(need)
        return float(np.clip(need[max(0, int(np.ceil(recall * len(need))) - 1)], -1, 1)) if len(need) else 1.0

    def search(self, queries: DataFrame, k: int, recall: float = 0.95, digits: int = 9, share: float | None = None) -> DataFrame:
        """query_id, pos, ref_id, element_pos, semantic: the k best points found of each query (query_id, pos, vec).

        ``recall``: 1 finds exactly the best; less is fitted on a sample of the queries (``share``), whose true best are
        sought among all points. Ties go to the smaller (ref_id, element_pos). Queries without length are left out.
        Each distinct vector is asked and compared once. Queries meet groups of lists in cells: a query goes to a group once,
        whatever number of its lists it asks. What the first lists gave is kept until ``release``.
        """
        manifest, cut = self.manifest(), self._tables.cut
        lists, metric = self.lists(manifest), self.metric
        share = self.share(queries, k, recall, digits, manifest) if share is None else share
        asking = queries.where(~vx.is_zero(F.col("vec"))).select("query_id", "pos", "vec", F.lit("").alias("all"))
        group, parts = self._dealt(lists.held)

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(had=[np.flatnonzero(c).tolist() for c in lists.first(stacked(batch["vec"]), k)[1]])

        each = asking.select("vec").distinct().withColumn("asked", F.monotonically_increasing_id())
        asked = cut(each.mapInPandas(first, "vec array<double>, asked long, had array<int>"))
        spots = cut(grid.distinct_points(self.points(manifest), k, "list"))
        n_across = max(1, -(-asked.count() // grid.CELL))

        def ask(reached: bool):
            """Each query with the groups of lists that it asks."""

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for lo in range(0, len(batch), BLOCK):
                        piece = batch.iloc[lo : lo + BLOCK]
                        x, least = stacked(piece["vec"]), piece["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
                        wanted = marked(piece["had"], len(lists.held))
                        if reached:
                            wanted = ~wanted & (lists.held > 0)[None, :] & (lists.bound(x, lists.place(x) @ lists.centres.T, share) >= least[:, None])
                        row, own = np.nonzero(wanted)
                        n = parts[own]
                        row, down = np.repeat(row, n), np.repeat(group[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else own
                        pairs = np.unique(np.stack([row, down], axis=1), axis=0)
                        if len(pairs):
                            yield piece.iloc[pairs[:, 0]].assign(down=pairs[:, 1])

            return run

        def compare(reached: bool):
            def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
                found = []
                if len(a) and len(b):
                    b = b.sort_values("list", kind="stable")
                    x, own, ids = stacked(a["vec"]), b["list"].to_numpy(), a["asked"].to_numpy()
                    here, start = np.unique(own, return_index=True)
                    end = np.append(start[1:], len(own))

                    def pieces(rows: slice, best: grid.Best) -> Iterator[tuple]:
                        mine = lists.place(x[rows])
                        had = marked(a["had"].iloc[rows], len(lists.held))[:, here]
                        bound = lists.bound(x[rows], mine @ lists.centres.T, share)[:, here] if reached else None
                        for at, (lo, hi) in enumerate(zip(start, end, strict=True)):
                            # An exact search goes by what was found so far; a fitted share holds for what the first lists gave.
                            asks = np.flatnonzero(~had[:, at] & (bound[:, at] >= (best.least if share >= 1 else best.given)) if reached else had[:, at])
                            if len(asks):
                                yield asks, lo, hi

                    least = a["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
                    for row, ref, pos, score in grid.best_in_cell(x, stacked(b["vec"]), b["members"], k, metric, digits, least, pieces):
                        found.append(pd.DataFrame({"asked": ids[row], "ref_id": ref, "element_pos": pos, "semantic": score}))
                return pd.concat(found) if found else grid.nothing("asked", "ref_id", "element_pos", "semantic")

            return run

        places = self.spark.createDataFrame([(at, int(group[at]), int(parts[at])) for at in range(len(parts))], "list int, start int, parts int")
        right = spots.join(F.broadcast(places), "list").withColumn("down", (F.col("start") + F.pmod(F.xxhash64("vec"), F.col("parts"))).cast("int"))
        right = right.select("list", "vec", "members", "down", F.explode(F.sequence(F.lit(0), F.lit(n_across - 1))).alias("across"))

        def met(rows: DataFrame, reached: bool) -> DataFrame:
            left = rows.mapInPandas(ask(reached), "asked long, vec array<double>, had array<int>, least double, down int")
            left = left.withColumn("across", F.pmod(F.xxhash64("vec"), F.lit(n_across)).cast("int"))
            return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInPandas(compare(reached), "asked long, ref_id string, element_pos int, semantic double")

        columns = ["asked", "vec", "had", "least"]
        order = Window.partitionBy("asked").orderBy(F.desc("semantic"), "ref_id", "element_pos")
        found = met(asked.withColumn("least", F.lit(None).cast("double")).select(columns), False)
        found = cut(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
        reach = found.where(F.col("r") == k).select("asked", F.col("semantic").alias("least"))
        second = met(asked.join(reach, "asked", "left").select(columns), True)
        return grid.joined(asking, asked.select(F.lit("").alias("all"), "vec", "asked"), found.drop("r").unionByName(second), "all", k)

    @staticmethod
    def _dealt(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First group and number of groups of each list: small lists share a group, large ones are cut in several."""
        most = int(min(SPREAD, max(BLOCK, held.sum() // 12)))
        group, parts, at, filled = np.zeros(len(held), np.int64), np.maximum(1, -(-held // most)).astype(np.int64), 0, 0
        for i, n in enumerate(held):
            if filled and (parts[i] > 1 or filled + n > most):
                at, filled = at + 1, 0
            group[i] = at
            if parts[i] > 1:
                at += parts[i]
            else:
                filled += n
        return group, parts
