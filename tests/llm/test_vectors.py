"""Vector operators against brute force, with many cells and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann, embedding_dedup


def _vectors(seed: int, n: int, size: int = 64):
    rng = np.random.default_rng(seed)
    points = rng.standard_normal((n, size))
    hot = rng.standard_normal(size)
    points[: n // 5] = hot + 0.12 * rng.standard_normal((n // 5, size))  # one group of near copies
    for i in range(n // 5, n // 2, 3):  # pairs on either side of the threshold
        points[i + 1] = points[i] + rng.choice([0.2, 0.32, 0.35]) * rng.standard_normal(size)
    points[n - 4 :] = points[n - 9]  # equal vectors
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _frame(spark, points, more=()):
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")


EDGES = [(10_000, None, 0), (10_001, [], 0), (10_002, [0.0] * 64, 0), (10_003, [1.0, None, *[0.0] * 62], 0), (10_004, [float("nan"), *[1.0] * 63], 0), (10_005, [1.0, 2.0], 0), (10_006, [2.0, 4.0], 0)]


@pytest.mark.parametrize("per_cell,block", [(10_000, 4096), (25, 4096), (25, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    points = _vectors(3, 600)
    rows = _frame(spark, points, EDGES).withColumn("size", F.lit("clash"))
    hit = points @ points.T >= 0.95
    np.fill_diagonal(hit, False)
    assert 100 < hit.sum() and (hit[200:].sum(axis=1) == 0).any()
    root = np.arange(len(points))
    for _ in range(len(points)):
        new = np.minimum(root, np.where(hit, root, len(root)).min(axis=1))
        if (new == root).all():
            break
        root = new
    want = {i: (int(hit[i].sum()), int(root[i])) for i in range(len(points))} | {i: (0, i) for i, _, _ in EDGES} | {10_005: (1, 10_005), 10_006: (1, 10_005)}
    got = embedding_dedup.near_duplicates(rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_of_repeated_ids_and_of_nothing(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = spark.createDataFrame([(1, one), (1, one), (1, two), (2, two), (3, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(rows).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert embedding_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_the_bound_is_never_below_the_cosine():
    points = _vectors(5, 300)
    top = embedding_dedup.heads(points)
    assert (top @ top.T >= points @ points.T - embedding_dedup.SLACK).all()


def _brute_nearest(points, queries, k):
    dots = points @ points.T
    return {q: sorted(((-dots[q, j], j) for j in range(len(points)) if j != q))[:k] for q in queries}


@pytest.mark.parametrize("per_cell", [10_000, 20])
def test_nearest_equals_brute_force(spark, monkeypatch, per_cell):
    monkeypatch.setattr(ann, "PER_CELL", per_cell)
    points = _vectors(7, 600, 16)
    rows = _frame(spark, points, [(i, None if v is None else (v * 8)[:16] if len(v) > 2 else v, c) for i, v, c in EDGES]).withColumn("size", F.lit("clash"))
    got = ann.nearest(rows, 5, F.col("vec_id") % 10 == 0).collect()
    want = _brute_nearest(points, range(0, 600, 10), 5)
    found = {(r.query_id, r.vec_id) for r in got if r.query_id < 10_000}
    # an entry counts if its score reaches the fifth best: equal vectors tie
    scores = points @ points.T
    assert sum(scores[q, v] >= -want[q][4][0] - 1e-12 for q, v in found) >= 0.98 * 300
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-12 for r in got if r.query_id < 10_000)
    for q in want:
        mine = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and [(round(s, 12), v) for _, s, v in mine] == sorted((round(s, 12), v) for _, s, v in mine)


def test_nearest_of_few_equal_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(rows, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (2, 3, 4, 0.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (3, 3, 4, 0.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0), (4, 3, 3, 0.0)]
    assert ann.nearest(rows.limit(0), 5).count() == 0 and ann.nearest(rows.where("vec_id = 1"), 5).count() == 0
