"""The persisted vector index: versions, segments, writers, recall and bounds."""

import os
import re
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweft.errors import InvalidConfig
from lexweft.operators import index as module
from lexweft.operators.index import LISTS, VectorIndex

POINTS = "point_id long, ref_id string, pos int, vec array<double>"
QUERIES = "query_id string, pos int, vec array<double>"


def points(spark, x, start=1):
    return spark.createDataFrame([(start + i, f"r{i % 7}", start + i, v.tolist()) for i, v in enumerate(x)], POINTS)


def asked(spark, x):
    return spark.createDataFrame([("q", i, v.tolist()) for i, v in enumerate(x)], QUERIES)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def even(n, d, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def clustered(n, d, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, d))
    x = centres[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def hits(found, x, q, k):
    """How many of the true k best are found, by position."""
    got = {}
    for r in found.collect():
        got.setdefault(r.pos, set()).add(r.element_pos - 1)
    return sum(len(got.get(i, set()) & set(np.argsort(-(x @ v))[:k].tolist())) for i, v in enumerate(q))


def share_asked(index, x, q, k, share):
    """The share of points that a search compares with its queries, from the index's own lists."""
    lists = index.lists()
    own = lists.centres
    near = ((own * own).sum(axis=1)[None, :] - 2 * x @ own.T).argmin(axis=1)
    like, chosen = lists.first(q, k)
    score = np.where(chosen[:, near], q @ x.T, -np.inf)
    least = -np.sort(-score, axis=1)[:, k - 1]
    wanted = chosen | (lists.bound(q, like, share) >= least[:, None])
    return (wanted * lists.held).sum() / (len(q) * len(x))


def test_versions(spark, tmp_path):
    """Opened as it is, last write wins by id, deleted points go, one point suffices, all is cleared."""
    index = VectorIndex(spark, str(tmp_path / "i"), 256)
    assert index.versions() == []
    with pytest.raises(InvalidConfig):
        index.points()
    point = lambda i, x: (i, "r", i, [x] * 256)
    index.upsert(spark.createDataFrame([point(1, 0.1)], POINTS))
    query = spark.createDataFrame([("q", 0, [0.1] * 256), ("zero", 0, [0.0] * 256)], QUERIES)
    assert [(r.query_id, r.ref_id, r.element_pos, r.semantic) for r in index.search(query, 3).collect()] == [("q", "r", 1, 2.56)]
    index.upsert(spark.createDataFrame([point(1, 0.2), point(2, 0.3)], POINTS))
    index.upsert(spark.createDataFrame([point(3, 0.0), point(2, -0.3), (2, "a", 9, [5.0] * 256)], POINTS))  # of equal ids the largest (ref_id, pos)
    again = VectorIndex(spark, str(tmp_path / "i"), 256)
    held = lambda: sorted((r.point_id, r.vec[0]) for r in again.points().collect())
    assert held() == [(1, 0.2), (2, -0.3), (3, 0.0)]
    with pytest.raises(Exception, match="256 components"):
        again.upsert(spark.createDataFrame([(4, "r", 4, [1.0])], POINTS))
    assert held() == [(1, 0.2), (2, -0.3), (3, 0.0)]
    again.delete(spark.createDataFrame([(2,), (77,)], "point_id long"))
    assert held() == [(1, 0.2), (3, 0.0)] and {r.element_pos for r in again.search(query, 3, recall=1).collect()} == {1, 3}
    again.upsert(spark.createDataFrame([point(2, 0.5)], POINTS))
    assert held() == [(1, 0.2), (2, 0.5), (3, 0.0)]
    again.clear()
    assert again.versions() == [] and size(tmp_path / "i") == 0


def test_upsert_writes_its_own_points_only(spark, tmp_path):
    """One point in a hundred costs about a hundredth of the index, and compaction leaves one segment."""
    folder = str(tmp_path / "i")
    x = even(20_000, 32)
    index = VectorIndex(spark, folder, 32)
    index.upsert(points(spark, x))
    whole = size(folder)
    new = even(200, 32, 9)
    index.upsert(points(spark, new, 101))
    assert size(folder) - whole < 0.03 * whole and len(index.manifest()["segments"]) == 2
    x[100:300] = new
    assert {r.point_id: r.vec for r in index.points().collect()} == {i + 1: v.tolist() for i, v in enumerate(x)}
    index.compact()
    index.compact()
    assert len(index.manifest()["segments"]) == 1 and index.points().count() == 20_000 and len(index.versions()) <= 3
    assert size(folder) < 3.5 * whole


def test_later_segments_are_folded_and_lists_grow(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), 8)
    x = even(1000, 8)
    index.upsert(points(spark, x[:50]))
    assert len(index.centres()) == 7
    index.upsert(points(spark, x, 1))  # far more than a quarter of the first segment
    assert len(index.manifest()["segments"]) == 1 and len(index.centres()) >= 14 and index.points().count() == 1000
    assert hits(index.search(asked(spark, x[:20]), 5, recall=1), x, x[:20], 5) == 100


def test_two_writers(spark, tmp_path):
    """Writers that start from one version both count, in the order in which they commit; no version is made twice."""
    index = VectorIndex(spark, str(tmp_path / "i"), 4)
    index.upsert(points(spark, np.ones((4, 4))))
    writers = [VectorIndex(spark, str(tmp_path / "i"), 4) for _ in range(4)]
    barrier, failed = threading.Barrier(4), []
    for w in writers:
        publish = w._publish

        def held(change, publish=publish):
            barrier.wait(60)
            return publish(change)

        w._publish = held

    def run(n):
        try:
            writers[n]._append(writers[n]._checked(spark.createDataFrame([(100 + n, "w", n, [1.0] * 4), (1, f"w{n}", n, [float(n)] * 4)], POINTS)), index.manifest())
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    seen = {r.point_id: r.ref_id for r in index.points().collect()}
    assert not failed and set(seen) == {1, 2, 3, 4, 100, 101, 102, 103} and seen[1] in {f"w{n}" for n in range(4)}
    manifest = index.manifest()
    lost = {"version": manifest["version"], "centres": None, "segments": []}
    assert not index._commit(lost) and index.manifest() == manifest  # a version that is there stays


@pytest.mark.parametrize("d", [32, 64, 256])
def test_recall_without_clusters(spark, tmp_path, d):
    x, q = even(6000, d), even(120, d, 8)
    index = VectorIndex(spark, str(tmp_path / "i"), d)
    index.upsert(points(spark, x))
    share = index.share(asked(spark, q), 6, 0.95)
    assert share < 1 and share_asked(index, x, q, 6, share) < 0.97
    assert hits(index.search(asked(spark, q), 6), x, q, 6) >= 0.9 * 720
    assert hits(index.search(asked(spark, q[:20]), 6, recall=1), x, q[:20], 6) == 120


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_recall_in_clusters(spark, tmp_path, metric):
    x = clustered(6000, 24)
    index = VectorIndex(spark, str(tmp_path / "i"), 24, metric)
    index.upsert(points(spark, x * 3 if metric == "cosine" else x))
    q = x[::60]
    assert len(index.centres()) == 77 < LISTS
    assert hits(index.search(asked(spark, q), 6), x, q, 6) >= 0.9 * 600 and share_asked(index, x, q, 6, index.share(asked(spark, q), 6, 0.95)) < 0.1
    assert hits(index.search(asked(spark, q), 6, recall=1), x, q, 6) == 600 and share_asked(index, x, q, 6, 1.0) < 0.5


def test_recall_on_given_vectors(spark, tmp_path):
    rows = duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[0][:32] for r in rows], dtype=np.float64)
    index = VectorIndex(spark, str(tmp_path / "i"), 32)
    index.upsert(points(spark, x))
    q = x[::10]
    share = index.share(asked(spark, q), 6, 0.95)
    assert hits(index.search(asked(spark, q), 6), x, q, 6) >= 0.9 * 6 * len(q) and share_asked(index, x, q, 6, share) < 0.9


def test_large_lists_are_dealt_in_parts(spark, tmp_path, monkeypatch):
    from lexweft.operators import index as module

    monkeypatch.setattr(module, "SPREAD", 100)
    monkeypatch.setattr(module, "BLOCK", 64)
    x = np.concatenate([np.tile(even(1, 8), (500, 1)), even(100, 8, 3)])
    index = VectorIndex(spark, str(tmp_path / "i"), 8)
    index.upsert(points(spark, x))
    got = sorted((-r.semantic, r.ref_id, r.element_pos) for r in index.search(asked(spark, x[:1]), 5, recall=1).collect())
    want = sorted((-round(float(x[0] @ v), 9), f"r{i % 7}", i + 1) for i, v in enumerate(x))[:5]
    assert got == want


def test_sample_sends_little_to_the_driver(spark, monkeypatch):
    """The points of smallest hash, of which no partition holds many more than its share for Spark to send."""
    monkeypatch.setattr(module, "SAMPLE", 400)
    points = spark.range(40_000).select(F.col("id").alias("point_id"), F.array(F.col("id").cast("double")).alias("vec")).repartition(16)
    got = VectorIndex._sample(points, 40_000)
    want = points.orderBy(F.xxhash64("point_id")).limit(400)
    assert [r["point_id"] for r in got.collect()] == [r["point_id"] for r in want.collect()]
    asked = re.search(r"xxhash64\(.*?\) < (-?\d+)", got._jdf.queryExecution().optimizedPlan().toString())
    assert asked and points.where(F.xxhash64("point_id") < int(asked[1])).count() <= 2 * 400
    assert VectorIndex._sample(points, 300).count() == 400  # where n is said too small, nothing is left out first
