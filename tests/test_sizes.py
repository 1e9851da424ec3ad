"""Queries beyond the size, or outside the values, at which they once failed."""

import random
from contextlib import contextmanager
from hashlib import md5
from itertools import combinations

import duckdb
import numpy as np
import pytest

from loomline.operators import graph, learning, mining, sequences
from loomline.plans import derived, registry
from loomline.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@contextmanager
def conf(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_sql(name, folder=SF, **changed):
    """Rows of the query's SQL in DuckDB; ``changed``: files of tables that are not those of the folder."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{changed.get(t, f'{folder}/{t}.parquet')}'")
    found = con.execute(registry.SQL[name])
    return [c[0] for c in found.description], found.fetchall()


def same(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", ["c09_ancestor_walk", "m10_paths"])
def test_recursion_has_no_row_limit(spark, name):
    with conf(spark, "spark.sql.cteRecursionRowLimit", "100"):  # 200 parts
        same(registry.QUERIES[name](spark, SF), *by_sql(name))


def test_years_of_more_or_fewer_than_four_digits(spark, tmp_path):
    days = [0, 1, -719163 * 1, -719529, -720000, -1_100_000, -500_000, 2932896, 2932897, 8_999_999]
    duckdb.sql(f"copy (select unnest({days})::bigint as o_orderkey) to '{tmp_path}/orders.parquet'")
    same(registry.QUERIES["e02_epoch_ms"](spark, str(tmp_path)), *by_sql("e02_epoch_ms", orders=f"{tmp_path}/orders.parquet"))


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.75, 1.0])
def test_alike_sets_meet_once(spark, threshold):
    rng = random.Random(5)
    sets = {k: sorted(rng.sample(range(40), rng.choice([1, 1, 2, 2, 3, 4, 6, 9, 15, 17, 30]))) for k in range(150)}
    want = [(a, b) for a, b in combinations(sets, 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= threshold]
    found = mining._alike(spark.createDataFrame(list(sets.items()), "k long, items array<long>"), threshold)
    assert sorted((r.a, r.b) for r in found.collect()) == want


def test_no_candidate_leaves_the_join_of_minhash_pairs(spark):
    """3,160 pairs share one item of five, some of them a band; 40 are alike."""
    rows = spark.createDataFrame([(k, i) for k in range(80) for i in (0, *range(1 + k // 2 * 10, 4 + k // 2 * 10), 900 + k)], "k long, i long")
    found = mining.minhash_pairs(rows, "k", "i", 0.5)
    assert len(found.collect()) == 40
    tree = found._jdf.queryExecution().executedPlan().toString()
    final = tree.split("Initial Plan")[0]
    assert "Exchange hashpartitioning(bucket" not in final and final.count("Join") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_son_holds_no_chunk_in_a_task(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(k, i) for k in range(300) for i in rng.sample(range(30), 4)], "k long, i long")
    found = mining.son(rows, "k", "i", 3, 3)
    assert "Pandas" not in _plan(found)
    assert {(tuple(r["items"]), r.n) for r in found.collect()} == {(tuple(r["items"]), r.n) for r in mining.itemsets(rows, "k", "i", 3, 3).collect()}


def test_parts_of_pairs_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mining, "EACH", 50)
    rows = spark.createDataFrame([(k, i) for k in range(60) for i in range(k % 9)] + [(None, 1), (1, None)], "k long, i long")
    pairs = mining.together(rows, "k", "i")
    assert pairs.rdd.getNumPartitions() == 2 * -(-rows.count() // 50)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == {(a, b): sum(b < k % 9 for k in range(60)) for a, b in combinations(range(8), 2)}
    for found in (graph.cooccurrence_edges(rows, "i", "k", 1), mining.jaccard(rows, "i", "k", 0.01), mining.itemsets(rows, "k", "i", 1, 2)):
        assert f", {2 * -(-rows.count() // 50)})" in _plan(found)


def test_nearest_gap_without_a_cross_join(spark, tmp_path):
    special = ["'nan'::double", "'inf'::double", "'-inf'::double", "null::double"]
    numbers = [f"{x}::double" for x in (0, 3, 3, 7.5, -2, 100, 1e9)]
    for n, (c, v) in enumerate([(special + numbers, numbers[2:]), (special + numbers, special), (special + numbers, special[1:2]), (special + numbers, special[:1]), (special + numbers, special[3:]), (special + numbers, special + numbers[1:3]), (numbers, [])]):
        duckdb.sql(f"copy (select 1 + i % 9 as c_custkey, x as c_acctbal from (select unnest([{', '.join(c)}]) as x, unnest(range({len(c)})) as i)) to '{tmp_path}/customer.parquet'")
        duckdb.sql(f"copy (select unnest([{', '.join(v)}]::double[]) as s_acctbal) to '{tmp_path}/supplier.parquet'")
        found = registry.QUERIES["f09_nearest_target"](spark, str(tmp_path))
        assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)
        same(found, *by_sql("f09_nearest_target", customer=f"{tmp_path}/customer.parquet", supplier=f"{tmp_path}/supplier.parquet"))
        spark.catalog.clearCache()


def test_votes_for_asked_pairs_rated_or_not(spark, monkeypatch):
    monkeypatch.setattr(mining, "PAIRS", 40)  # many parts
    rng = random.Random(9)
    stars = {(u, i): float(rng.randrange(1, 6)) for u in range(14) for i in range(12) if rng.random() < 0.6}
    ratings = spark.createDataFrame([(u, i, s) for (u, i), s in stars.items()], "user long, item long, stars double")
    corr = {(r.a, r.b): r["corr"] for r in mining.pearson(ratings).collect()}
    for (a, b), got in corr.items():
        x, y = zip(*[(stars[u, a], stars[u, b]) for u in range(14) if (u, a) in stars and (u, b) in stars], strict=True)
        n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
        low = (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
        assert got == pytest.approx(sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / low if n > 1 and low > 1e-9 else 0, abs=1e-9)
    asked = [(u, i) for u in range(16) for i in range(14) if (u + i) % 3]
    found = {(r.user, r.item): r.prediction for r in mining.item_predictions(ratings, spark.createDataFrame(asked, "user long, item long"), 3, 1).collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for u, i in asked:
        near = sorted((-round(c, 9), o, c) for o in range(12) if (u, o) in stars and o != i and (c := corr.get((min(i, o), max(i, o)), 0)) > 1e-12)[:3]
        ua, ia = mean([s for (v, _), s in stars.items() if v == u]), mean([s for (_, j), s in stars.items() if j == i])
        plain = (ua + ia) / 2 if ua and ia else ua or ia or 3.7
        want = sum(c * stars[u, o] for _, o, c in near) / sum(c for _, _, c in near) if len(near) > 1 else plain
        assert found[u, i] == pytest.approx(want)


def test_new_users_and_items_need_no_correlations(spark, monkeypatch):
    monkeypatch.setattr(mining, "_correlated", None)
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], "user long, item long, stars double")
    asked = spark.createDataFrame([(1, 9), (9, 1), (9, 9)], "user long, item long")
    assert sorted(r.prediction for r in mining.item_predictions(ratings, asked).collect()) == [3.0, 3.7, 4.0]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", 3, 2.5])
def test_screening_keeps_what_may_be_nearest(metric):
    """A few of all pairs reach the measure, the k nearest and their ties among them."""
    rng = np.random.default_rng(6)
    near, asks = rng.normal(size=(2000, 16)), rng.normal(size=(50, 16))
    near[100:110] = near[90]  # ties
    asks[3] = near[90]
    measure = mining.minkowski(metric) if isinstance(metric, int | float) else mining.METRICS[metric]
    i, j = mining._screened(near, asks, 5, measure.screen)
    assert len(i) < 50 * 20
    for x in range(50):
        d = measure(near - asks[x])
        assert set(np.flatnonzero(d <= np.sort(d)[4])) <= set(j[i == x])
    assert len(mining._screened(near[:4], asks, 5, measure.screen)[0]) == 200


def test_a_class_is_ranked_in_parts(spark):
    rows = spark.createDataFrame([(i, "few" if i < 7 else None if i % 50 == 1 else "many") for i in range(3000)], "id long, class string")
    found = learning.ranked(rows, "id", ["class"])
    assert "_slice" in next(line for line in _plan(found).splitlines() if "Window [row_number" in line)
    got = {}
    for r in found.collect():
        got.setdefault(r["class"], []).append((r.nth, r.id, r.of))
    assert set(got) == {"few", None, "many"}
    for of in got.values():
        want = sorted((i for _, i, _ in of), key=lambda i: md5(f"{i}/0".encode()).hexdigest())
        assert sorted(of) == [(n + 1, i, len(of)) for n, i in enumerate(want)]
    for name in ("r01_stratified_split", "r11_undersampling", "r19_learning_curve"):
        df = registry.QUERIES[name](spark, SF)
        windows = [line for line in _plan(df).splitlines() if "Window [row_number" in line]
        assert windows and all("_slice" in line for line in windows)
        same(df, *by_sql(name))


def test_texts_are_cut_in_their_row(spark, tmp_path, monkeypatch):
    """No word is exploded or shuffled as text; repeated ids count together as in the SQL."""
    monkeypatch.setattr(sequences, "HELD_WORDS", 3)
    texts = [(1, "The cat, THE hat; K9"), (2, "a ä BK c-c c"), (2, "cat the the end"), (3, ""), (4, None), (5, " -- "), (6, "the end of the end")]
    rows = ", ".join(f"({i}, {'null' if t is None else repr(t)})" for i, t in texts)
    for name, kept in (("p07_tfidf", rows), ("p09_index_sequences", rows.replace("(2, 'cat", "(7, 'cat")), ("e30_mean_vector", rows)):
        path = f"{tmp_path}/{name}"
        duckdb.sql(f"copy (select * from (values {kept}) t(doc_id, text)) to '{path}.parquet'")
        (tmp_path / f"{name}_d").mkdir()
        duckdb.sql(f"copy (select * from '{path}.parquet') to '{path}_d/documents.parquet'")
        duckdb.sql(f"copy (select * from '{SF}/embeddings.parquet') to '{path}_d/embeddings.parquet'")
        df = registry.QUERIES[name](spark, f"{path}_d")
        if name != "e30_mean_vector":
            assert "MapInArrow" in _plan(df) and "explode" not in _plan(df)
        columns, want = by_sql(name, documents=f"{path}.parquet")
        same(df, columns, want)


def test_parts_of_boosted_trees_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mining, "EACH", 300)  # of 6,000 lines
    assert registry.QUERIES["l05_boosted_trees"](spark, SF).rdd.getNumPartitions() == 20


def test_parts_of_ratings_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mining, "EACH", 300)
    df = registry.QUERIES["l03_cold_start"](spark, SF)
    same(df, *by_sql("l03_cold_start"))
    assert derived._ratings(spark, SF).rdd.getNumPartitions() == 20
