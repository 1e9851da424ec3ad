"""Graphs as tables of nodes and edges (src, dst); iterative ones write each round to reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HELD = 200_000  # edges of a graph that a task may hold whole, about 50 MB; larger ones go by joins
HERE = 2_000_000  # steps (nodes times edges) below which a job costs more than the work
ROOTS = 1_000  # roots followed at once by joins


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder of the session; on one machine (master local) a temporary one if there is none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomline-"))
    return df.checkpoint()


_cut = checkpointed


def cooccurrence_edges(rows: DataFrame, node: str, item: str, least: int) -> DataFrame:
    """(src, dst), src < dst, of nodes that share at least ``least`` items."""
    from .mining import together  # which needs checkpointed

    return together(rows, item, node).where(F.col("n") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after rounds of taking the most frequent neighbour label, ties to the smaller."""
    around = _cut(both_ways(edges))
    labels = around.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = around.join(labels.toDF("dst", "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "label"))).where("nth = 1")
        labels = _cut(best.select(F.col("src").alias("node"), "label"))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by minima and pointer jumps."""
    around = _cut(both_ways(edges))
    labels = _cut(around.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("c")))
    while True:
        near = around.join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("m"))
        step = labels.join(near, "node").select("node", F.least("c", "m").alias("c"))
        jumped = _cut(step.join(step.toDF("c", "d"), "c", "left").select("node", F.least("c", F.coalesce("d", "c")).alias("c")))
        if labels.toDF("node", "old").join(jumped, "node").where("old <> c").isEmpty():
            return jumped.toDF("node", "component")
        labels = jumped


def shortest_paths(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, level, paths) for every root at once, or those of ``roots`` (node), frontier by frontier."""
    around = _cut(both_ways(edges))
    nodes = around.select("src").distinct() if roots is None else roots.select(F.col("node").alias("src"))
    seen = _cut(nodes.select(F.col("src").alias("root"), F.col("src").alias("node"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("paths")))
    level = 0
    while True:
        front = seen.where(F.col("level") == level)
        new = front.join(around, front.node == around.src).groupBy("root", "dst").agg(F.sum("paths").alias("paths"))
        new = new.join(seen.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_anti")
        level += 1
        new = _cut(new.select("root", F.col("dst").alias("node"), F.lit(level).alias("level"), "paths"))
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new)


def _held(edges: DataFrame) -> list[tuple] | None:
    """The edges, each once with its smaller node first, if there are at most HELD of them."""
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    rows = one.limit(HELD + 1).collect()
    return None if len(rows) > HELD else sorted((r.src, r.dst) for r in rows)


def _near(links: Iterable[tuple]) -> dict:
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    return near


def _flows(near: dict, roots: Iterable) -> dict[tuple, float]:
    """For every edge of a held graph, the sum over the roots of the credit that flows over it."""
    total = defaultdict(float)
    for root in roots:
        depth, paths, reached = {root: 0}, {root: 1}, [root]
        for node in reached:  # grows while it is read
            for other in near[node]:
                if depth.setdefault(other, depth[node] + 1) > depth[node]:
                    if other not in paths:
                        paths[other] = 0
                        reached.append(other)
                    paths[other] += paths[node]
        credit = dict.fromkeys(reached, 1.0)
        for node in reversed(reached):
            for other in near[node]:
                if depth[other] < depth[node]:
                    share = credit[node] * paths[other] / paths[node]
                    credit[other] += share
                    total[(other, node) if other < node else (node, other)] += share
    return total


def _held_betweenness(spark, links: list[tuple], roots: list) -> dict[tuple, float]:
    """Scores of the edges that ``roots``, whole components, reach; the roots are dealt to tasks where that pays."""
    near = _near(links)
    if len(roots) * len(links) <= HERE:
        total = _flows(near, roots)
    else:
        shared = spark.sparkContext.broadcast((links, roots))

        def run(batches):
            held, starts = shared.value
            around, at, sums = _near(held), {e: i for i, e in enumerate(held)}, defaultdict(float)
            for batch in batches:
                for edge, flow in _flows(around, [starts[i] for i in batch.column(0).to_pylist()]).items():
                    sums[at[edge]] += flow
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], ["at", "flow"])

        tasks = min(len(roots), 4 * spark.sparkContext.defaultParallelism)
        sums = spark.range(0, len(roots), 1, tasks).mapInArrow(run, "at long, flow double").groupBy("at").agg(F.sum("flow").alias("flow"))
        total = {links[r["at"]]: r["flow"] for r in sums.collect()}
        shared.unpersist()
    return {edge: flow / 2 for edge, flow in total.items()}


def betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness) of every edge, src < dst: credits flow from the deepest level to each root, half of their sum.

    A graph of at most HELD edges goes whole to tasks that share the roots; a
    larger one goes by joins, ROOTS roots at a time, whose flows are added up.
    """
    links = _held(edges)
    spark = edges.sparkSession
    if links is not None:
        found = _held_betweenness(spark, links, sorted(_near(links)))
        kind = edges.schema["src"].dataType.simpleString()
        return spark.createDataFrame([(a, b, x) for (a, b), x in found.items()], f"src {kind}, dst {kind}, x double").select("src", "dst", F.round("x", 5).alias("betweenness"))
    around = _cut(both_ways(edges))
    nodes = _cut(around.select(F.col("src").alias("node")).distinct())
    blocks = -(-nodes.count() // ROOTS)
    total = None
    for block in range(blocks):
        flows = _block_flows(edges, around, nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block))
        if flows is not None:
            total = flows if total is None else total.unionAll(flows).groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
            total = _cut(total)
    if total is None:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    return total.select("src", "dst", F.round(F.col("flow") / 2, 5).alias("betweenness"))


def _block_flows(edges: DataFrame, around: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(src, dst, flow), the credit over every edge from a block of roots, by joins."""
    paths = _cut(shortest_paths(edges, roots))
    deepest = paths.agg(F.max("level")).first()[0] or 0
    credit = _cut(paths.where(F.col("level") == deepest).select("root", "node", F.lit(1.0).alias("credit")))
    flows = None
    for level in range(deepest, 0, -1):
        child = paths.where(F.col("level") == level).select("root", F.col("node").alias("child"), F.col("paths").alias("all"))
        parent = paths.where(F.col("level") == level - 1).select("root", F.col("node").alias("parent"), "paths")
        links = child.join(around, child.child == around.src).withColumnRenamed("dst", "parent").join(parent, ["root", "parent"])
        flow = _cut(links.join(credit.toDF("root", "child", "credit"), ["root", "child"]).select("root", "child", "parent", (F.col("credit") * F.col("paths") / F.col("all")).alias("flow")))
        flows = flow if flows is None else flows.unionAll(flow)
        got = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("got"))
        credit = _cut(parent.withColumnRenamed("parent", "node").join(got, ["root", "node"], "left").select("root", "node", (1.0 + F.coalesce("got", F.lit(0.0))).alias("credit")))
    if flows is None:
        return None
    return flows.groupBy(F.least("child", "parent").alias("src"), F.greatest("child", "parent").alias("dst")).agg(F.sum("flow").alias("flow"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row q: sum over unordered pairs inside communities (node, c) of A - k k' / 2m, divided by 2m."""
    around = both_ways(edges)
    degree = around.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    sums = communities.join(degree, "node").groupBy("c").agg(((F.sum("k") ** 2 - F.sum(F.col("k") ** 2)) / 2).alias("kk"))
    total = degree.agg((F.sum("k") / 2).alias("m"))
    same = edges.join(communities.toDF("src", "c"), "src").join(communities.toDF("dst", "d"), "dst").where("c = d").agg(F.count("*").alias("e"))
    one_row = sums.agg(F.coalesce(F.sum("kk"), F.lit(0.0)).alias("kk")).crossJoin(same).crossJoin(total)
    return one_row.select(F.round((F.col("e") - F.col("kk") / (2 * F.col("m"))) / (2 * F.col("m")), 8).alias("q"))


def _joined_partitions(edges: DataFrame, most: int | None) -> Iterator[DataFrame]:
    """Partitions (node, c) before the first and after every cut of a graph of any size."""
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    now = _cut(edges.select("src", "dst"))
    for _ in count() if most is None else range(most + 1):
        found = components(now) if not now.isEmpty() else nodes.limit(0).select("node", F.col("node").alias("component"))
        yield _cut(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        if now.isEmpty():
            return
        scores = _cut(betweenness(now))
        high = scores.agg(F.max("betweenness")).first()[0]
        now = _cut(scores.where(F.col("betweenness") < high).select("src", "dst"))


def _held_partitions(spark, links: list[tuple], most: int | None) -> Iterator[dict]:
    """As ``_joined_partitions``, of a held graph, without those equal to the one before: a cut changes the scores of its own components only."""
    near, scores, part = _near(links), {}, {}
    stale = set(near)
    for _ in count() if most is None else range(most + 1):
        before = len(set(part.values()))
        left = set(stale)
        while left:
            inside = [left.pop()]
            for node in inside:
                new = near[node] & left
                left -= new
                inside += new
            part.update(dict.fromkeys(inside, min(inside)))
        if len(set(part.values())) > before:
            yield dict(part)
        new = _held_betweenness(spark, [(a, b) for a in stale for b in near[a] if a < b], sorted(stale))
        scores |= {edge: round(x, 5) for edge, x in new.items()}
        if not scores:
            return
        high = max(scores.values())
        gone = [e for e, x in scores.items() if x == high]
        hit = {part[a] for a, _ in gone}
        for a, b in gone:
            del scores[a, b]
            near[a].discard(b)
            near[b].discard(a)
        stale = {node for node, c in part.items() if c in hit}


def girvan_newman(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, c) of the best partition by modularity while the edges of highest betweenness are cut until none is left, or at most ``most`` times.

    Every node of an edge has a row; ties of modularity go to the earlier
    partition. A graph of at most HELD edges is held in memory, a larger one goes by joins.
    """
    links, spark, best, top = _held(edges), edges.sparkSession, None, None
    kind = edges.schema["src"].dataType.simpleString()
    if links is None:
        parts: Iterable[DataFrame] = _joined_partitions(edges, most)
    else:
        # one partition: no shuffle for a table of this size
        edges = spark.createDataFrame(links, f"src {kind}, dst {kind}").coalesce(1)
        parts = (spark.createDataFrame(list(p.items()), f"node {kind}, c {kind}").coalesce(1) for p in _held_partitions(spark, links, most))
    for part in parts:
        q = modularity(edges, part).first()["q"]
        if top is None or q > top:
            best, top = part, q
    return spark.createDataFrame([], f"node {kind}, c {kind}") if best is None else best
