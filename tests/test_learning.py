"""Models from moments, validation, resampling, itemsets and clusters against plain forms."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import clusters, learning, mining
from loomline.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [2.0, -1.0, 0.0] + 4 + rng.normal(size=300)
    rows = [(i, *map(float, r), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int"), x, y


def test_linear_models_equal_numpy(table):
    rows, x, y = table
    m = learning.Moments.of(rows, ["a", "b", "c"], "y")[None]
    one = np.hstack([np.ones((300, 1)), x])
    ols = np.linalg.lstsq(one, y, rcond=None)[0]
    assert np.allclose(m.ridge(), ols) and np.isclose(m.squared_error(ols), ((one @ ols - y) ** 2).sum())
    z, sd = (x - x.mean(0)) / x.std(0), x.std(0)
    ridge = np.linalg.solve(z.T @ z / 300 + 0.3 * np.eye(3), z.T @ (y - y.mean()) / 300)
    assert np.allclose(m.ridge(0.3)[1:], ridge / sd)
    lasso = m.lasso(0.2)[1:] * sd
    slope = z.T @ (y - y.mean() - z @ lasso) / 300  # optimality
    assert np.all(np.abs(slope) <= 0.2 + 1e-9) and np.allclose(slope[lasso != 0], 0.2 * np.sign(lasso[lasso != 0])) and lasso[2] == 0
    _, vectors = np.linalg.eigh(z.T @ z)
    scores = z @ vectors[:, ::-1][:, :2]
    gamma = np.linalg.lstsq(scores, y - y.mean(), rcond=None)[0]
    assert np.allclose(m.principal(2)[1:] * sd, vectors[:, ::-1][:, :2] @ gamma)
    assert learning.selected(m) == ["b", "a"] and (m.p_values()[1:] < 0.05).tolist() == [True, True, False]
    got = learning.predict(rows, ["a", "b", "c"], ols, 0.0).orderBy("id").toPandas()["prediction"]
    assert np.allclose(got, np.maximum(one @ ols, 0))


def test_polynomial_and_grid_search(table):
    rows, x, y = table
    more, names = learning.polynomial(rows, "b", 2)
    assert np.allclose(learning.Moments.of(more, names, "y")[None].ridge(), np.polyfit(x[:, 1], y, 2)[::-1])
    found = dict(learning.grid_search(rows, ["a", "b"], "y", "fold", [0.0, 1.0]))
    wrong = 0.0
    for f in range(4):
        out = np.arange(300) % 4 == f
        one = np.hstack([np.ones((300, 1)), x[:, :2]])
        model = np.linalg.lstsq(one[~out], y[~out], rcond=None)[0]
        wrong += ((one[out] @ model - y[out]) ** 2).sum()
    assert np.isclose(found[0.0], (wrong / 300) ** 0.5) and found[0.0] < found[1.0]


def test_splits_and_resampling(table, spark):
    rows = table[0].withColumn("class", F.when(F.col("id") < 50, "few").otherwise("many"))
    split = learning.stratified_split(rows, "id", ["class"])
    assert {(r["class"], r.train): r["count"] for r in split.groupBy("class", "train").count().collect()} == {("few", True): 40, ("few", False): 10, ("many", True): 200, ("many", False): 50}
    assert 200 < learning.random_split(rows, "id").where("train").count() < 280
    assert {r["count"] for r in learning.folds(rows, "id", ["class"], 5).where("class = 'few'").groupBy("fold").count().collect()} == {10}
    assert {r["count"] for r in learning.undersampled(rows, "id", "class").groupBy("class").count().collect()} == {50}
    assert spark.range(1).select(learning.prior_corrected(F.lit(0.5), 0.5, 0.1)).first()[0] == pytest.approx(0.1)
    few = rows.where("class = 'few'").select("id", F.array("a", "b").alias("v"))
    near = mining.nearest_rows(few, few, 3).where("id <> other").select("id", "other")
    v = {r.id: r.v for r in few.collect()}
    for r in learning.smote(few, near, "id", "v").collect():
        for lo, hi, z in zip(v[r.id], v[r.other], r.v, strict=True):
            assert min(lo, hi) - 1e-9 <= z <= max(lo, hi) + 1e-9


def test_itemsets_of_son_and_candidates(spark):
    rng = random.Random(2)
    baskets = [sorted(rng.sample(range(9), rng.choice([1, 3, 5]))) for _ in range(80)]
    rows = spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in b] + [(0, baskets[0][0])], "k long, i long")
    counts = Counter(c for b in baskets for n in (1, 2, 3) for c in combinations(b, n))
    want = {c: n for c, n in counts.items() if n >= 8}
    assert {tuple(r["items"]): r.n for r in mining.son(rows, "k", "i", 8, 3).collect()} == want
    two = [c for c in want if len(c) == 2]
    got = {tuple(r["items"]) for r in mining.candidates(spark.createDataFrame([(list(c),) for c in two], "items array<long>")).collect()}
    assert got == {c for c in combinations(range(9), 3) if all(s in two for s in combinations(c, 2))}


def test_neighbours_over_blocks_and_mahalanobis(spark, monkeypatch):
    monkeypatch.setattr(mining, "ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4)) * [1, 10, 0.1, 2]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, label int")
    train, test = rows.where("id >= 30"), rows.where("id < 30")
    inverse = np.linalg.pinv(np.cov(x[30:].T, bias=True))
    for sides, d in (((train, test), ((x[:30, None] - x[None, 30:]) ** 2).sum(-1)), (mining.whitened(train, test), np.einsum("ijk,kl,ijl->ij", x[:30, None] - x[None, 30:], inverse, x[:30, None] - x[None, 30:]))):
        want = np.argsort(d, axis=1, kind="stable")[:, :5] + 30
        got = {(r.id, r.nth): r.other for r in mining.nearest_rows(*sides, 5).collect()}
        assert got == {(i, n + 1): int(want[i, n]) for i in range(30) for n in range(5)}


def test_bfr_finds_clusters_that_come_late(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [40, 0], [0, 40], [40, 40]])
    points = [(i, (centres[i % 4] + rng.normal(size=2)).tolist()) for i in range(400)] + [(400, [500.0, -500.0]), (401, [-900.0, 300.0])]
    out, report = clusters.bfr(spark.createDataFrame(points, "id long, v array<double>"), 2, 4, chunks=3)
    c = {r.id: r.c for r in out.collect()}
    assert len(c) == 402 and c[400] == c[401] == -1
    groups = [Counter(c[i] for i in range(k, 400, 4)) for k in range(4)]
    assert all(g.most_common(1)[0][1] >= 90 for g in groups) and len({g.most_common(1)[0][0] for g in groups}) == 4
    assert [r[0] for r in report] == [0, 1, 2] and report[-1][1] + report[-1][3] + report[-1][4] == 402
    assert clusters.merge_near({1: (2, np.array([2.0]), np.array([3.0])), 2: (2, np.array([2.2]), np.array([3.4])), 3: (2, np.array([200.0]), np.array([20001.0]))}, 2.0) == {2: 1}


def test_rules_and_self_training(spark):
    text = "\n".join(r.text for r in registry.QUERIES["r16_tree_rules"](spark, "/root/testdata/sf0.001").orderBy("line").collect())
    assert "if l_quantity" in text or "if l_discount" in text
    assert text.count("return") == text.count("if ") + 1 == text.count("else:") + 1
    got = {r.label: r.n for r in registry.QUERIES["r13_self_training"](spark, "/root/testdata/sf0.01").collect()}
    assert sum(got.values()) == 100 and set(got) == {0.0, 1.0}
