from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomline.operators import graph, learning, sequences
from loomline.sources.store import Store

LINKS = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (7, 8), (8, 9), (2, 5)]


def _all_shortest(links, a, b):
    near = defaultdict(set)
    for x, y in links:
        near[x].add(y)
        near[y].add(x)
    paths = [[a]]
    while paths:
        done = [p for p in paths if p[-1] == b]
        if done:
            return done
        paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p]
    return []


def _scores(links):
    total = dict.fromkeys(links, 0.0)
    for a, b in combinations(sorted({n for e in links for n in e}), 2):
        paths = _all_shortest(links, a, b)
        for p in paths:
            for e in zip(p, p[1:], strict=False):
                total[min(e), max(e)] += 1 / len(paths)
    return {e: round(x, 5) for e, x in total.items()}


def _parts(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def _best_partition(links):
    nodes = sorted({n for e in links for n in e})
    degree = {n: sum(n in e for e in links) for n in nodes}
    now, best, top, m = list(links), None, None, len(links)
    while True:
        part = _parts(nodes, now)
        q = sum(((a, b) in links) - degree[a] * degree[b] / (2 * m) for a, b in combinations(nodes, 2) if part[a] == part[b]) / (2 * m)
        if top is None or round(q, 8) > top:
            best, top = part, round(q, 8)
        if not now:
            return best
        scores = _scores(now)
        now = [e for e in now if scores[e] < max(scores.values())]


@pytest.mark.parametrize(("held", "here"), [(200_000, 2_000_000), (200_000, 0), (3, 0)])
def test_betweenness_in_memory_by_tasks_and_by_joins(spark, monkeypatch, held, here):
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "HERE", here)
    monkeypatch.setattr(graph, "ROOTS", 5)  # two blocks of roots
    found = graph.betweenness(spark.createDataFrame(LINKS, "src long, dst long")).collect()
    assert {(r.src, r.dst): r.betweenness for r in found} == pytest.approx(_scores(LINKS), abs=2e-5)


def test_girvan_newman_equals_brute_force(spark):
    found = graph.girvan_newman(spark.createDataFrame(LINKS, "src long, dst long"))
    assert {r.node: r.c for r in found.collect()} == _best_partition(LINKS)
    assert graph.girvan_newman(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_girvan_newman_by_joins_equals_memory(spark, monkeypatch):
    e = spark.createDataFrame(LINKS, "src long, dst long")
    held = {tuple(r) for r in graph.girvan_newman(e, 1).collect()}
    monkeypatch.setattr(graph, "HELD", 3)
    assert {tuple(r) for r in graph.girvan_newman(e, 1).collect()} == held


def test_positions_and_tiles(spark):
    rows = [(i % 4 if i % 7 else None, i) for i in range(53)] + [(1, 1), (1, 1)]
    df = spark.createDataFrame(rows, "k long, _all long").repartition(5)
    placed = sequences.positions(df, F.desc("k"), "_all", total="n").collect()
    assert sorted(r.nth for r in placed) == list(range(1, 56)) and {r.n for r in placed} == {55}
    ordered = [(r.k, r["_all"]) for r in sorted(placed, key=lambda r: r.nth)]
    assert ordered == sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert sequences.positions(df.limit(0), "k").collect() == []
    for n, parts in ((55, 4), (3, 5), (8, 8)):
        sizes = defaultdict(int)
        for r in sequences.tiles(spark.range(n), parts, "id").collect():
            sizes[r.part_id] += 1
        assert dict(sizes) == {i + 1: n // parts + (i < n % parts) for i in range(min(n, parts))}


def test_put_command(spark, tmp_path):
    (tmp_path / "cars.csv").write_text("name,price\n" + "".join(f"n{i},{90 - i}\n" for i in range(7)))
    s = Store(spark, str(tmp_path / "store"))
    s.run("mkdir /a")
    s.run(f"put {tmp_path}/cars.csv /a 3 price")
    assert [r.price for r in s.run("readPartition /a/cars 1").orderBy("price").collect()] == [84, 85, 86]
    with pytest.raises(ValueError):
        s.run("put x.csv")


def test_auc_with_ties_and_nulls(spark):
    rows = [(i, (i * 7 % 5) / 4, int(i % 3 == 0)) for i in range(40)] + [(40, None, 1), (41, 0.5, None)]
    known = [(s, y) for _, s, y in rows if s is not None and y is not None]
    pairs = [(a > b) + (a == b) / 2 for a, y in known if y for b, z in known if not z]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    assert learning.auc(df, "score", "label", "id").first().auc == pytest.approx(sum(pairs) / len(pairs))
    assert learning.auc(df.where("label = 1"), "score", "label", "id").first().auc is None
