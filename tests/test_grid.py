"""Neighbours by cells against brute force, and what passes between Spark and a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweft.operators import grid
from lexweft.operators.index import VectorIndex


def frames(spark, x, y, ref):
    b = spark.createDataFrame([(f"q{i % 3}", i, v.tolist()) for i, v in enumerate(x)], "query_id string, pos int, vec array<double>")
    e = spark.createDataFrame([(ref[i], i, v.tolist()) for i, v in enumerate(y)], "ref_id string, pos int, vec array<double>")
    return b, e


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_copies_and_ties_as_by_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(grid, "LEAST", 16)  # several cells
    rng = np.random.default_rng(5)
    x, y = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(-2, 3, (400, 4)).astype(float)
    x[:, 0] += 7  # none without length
    ref = [f"r{i % 7}" for i in range(len(y))]
    b, e = frames(spark, x, y, ref)
    near = grid.knn(b, e, 5, metric)
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan  # no pair of rows or blocks is a row of a join
    score = np.round(grid.similarities(x, y, metric), 9)
    want = {(i, ref[j], j, score[i, j]) for i in range(len(x)) for j in sorted(range(len(y)), key=lambda j: (-score[i, j], ref[j], j))[:5]}
    assert {(r.pos, r.ref_id, r.element_pos, r.semantic) for r in near.collect()} == want
    own = b.withColumn("ref_id", F.concat(F.lit("r"), F.col("pos") % 7))
    want = {(i, j, score[i, j]) for i in range(len(x)) for j in sorted(range(i % 7, len(y), 7), key=lambda j: (-score[i, j], j))[:5]}
    assert {(r.pos, r.element_pos, r.semantic) for r in grid.knn_within(own, e, 5, metric).collect()} == want


def test_large_and_small_components():
    rng = np.random.default_rng(6)
    for scale in (1e-30, 1.0, 1e6, 1e40):
        x, y = rng.standard_normal((50, 8)), rng.standard_normal((9000, 8)) * scale
        members = pd.Series([[{"ref_id": "r", "pos": i}] for i in range(len(y))])
        got = {(r, p) for rows, _, pos, _ in grid.best_in_cell(x, y, members, 6, "cosine", 9) for r, p in zip(rows, pos, strict=True)}
        score = np.round(grid.similarities(x, y, "cosine"), 9)
        assert got == {(i, j) for i in range(50) for j in np.lexsort((np.arange(9000), -score[i]))[:6]}


def test_index_asks_copies_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    x, y = np.repeat(rng.standard_normal((3, 8)), 40, axis=0), np.repeat(rng.standard_normal((150, 8)), 4, axis=0)
    b, e = frames(spark, x, y, ["r"] * len(y))
    index = VectorIndex(spark, str(tmp_path / "i"), 8)
    index.upsert(e.withColumn("point_id", F.col("pos")))
    got = index.search(b, 6, recall=1)
    assert index._tables._made and spark.read.parquet(index._tables._made[0][1]).count() == 3  # a row for each distinct query
    score = np.round(x @ y.T, 9)
    want = {(i, j) for i in range(len(x)) for j in np.lexsort((np.arange(len(y)), -score[i]))[:6]}
    assert {(r.pos, r.element_pos) for r in got.collect()} == want
    index.release()
    group, parts = VectorIndex._dealt(np.array([10, 5000, 200_000, 3, 3]))
    assert parts.max() > 1 and len({(g + p) for g, n in zip(group, parts, strict=True) for p in range(n)}) >= parts.max()
