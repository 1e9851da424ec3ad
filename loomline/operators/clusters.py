"""Summary-based clustering: summaries, distances from summaries, assignment, and a one-pass driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def summaries(points: DataFrame, dims: int) -> DataFrame:
    """(c, n, s, q): count, sums and sums of squares by dimension of points (id, c, v)."""
    sums = F.array(*[F.sum(F.col("v")[i].cast("double")) for i in range(dims)])
    squares = F.array(*[F.sum(F.col("v")[i].cast("double") ** 2) for i in range(dims)])
    return points.groupBy("c").agg(F.count("*").alias("n"), sums.alias("s"), squares.alias("q"))


def assign(points: DataFrame, summary: DataFrame, dims: int, factor: float = 2.0) -> DataFrame:
    """(id, c, distance): nearest summary by Mahalanobis distance (dimensions without spread count nothing), c null beyond factor * sqrt(dims)."""
    spread = F.sqrt(F.greatest(F.col("q")[0] * 0, F.lit(0.0)))
    parts = []
    for i in range(dims):
        mean = F.col("s")[i] / F.col("n")
        spread = F.sqrt(F.greatest(F.col("q")[i] / F.col("n") - mean * mean, F.lit(0.0)))
        parts.append(F.when(spread < 1e-9, 0.0).otherwise(F.pow((F.col("v")[i] - mean) / F.greatest(spread, F.lit(1e-9)), 2)))
    pairs = points.select("id", "v").crossJoin(F.broadcast(summary)).select("id", "c", F.sqrt(sum(parts[1:], parts[0])).alias("distance"))  # summaries: one row a cluster
    best = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("distance", "c"))).where("nth = 1")
    return best.select("id", F.when(F.col("distance") < factor * dims**0.5, F.col("c")).alias("c"), "distance")


def _fit(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, v, c) by k-means."""
    rows = points.select("id", "v", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("id", "v", F.col("prediction").alias("c"))


def _sums(rows) -> dict[int, tuple]:
    """Summaries (bounded: a row a cluster) as numbers."""
    return {r["c"]: (r["n"], np.array(r["s"]), np.array(r["q"])) for r in rows}


def _far(a: tuple, b: tuple) -> float:
    """Mahalanobis distance of the mean of a from the summary b."""
    mean, spread = b[1] / b[0], np.sqrt(np.maximum(b[2] / b[0] - (b[1] / b[0]) ** 2, 0))
    gap = np.where(spread < 1e-9, 0, (a[1] / a[0] - mean) / np.maximum(spread, 1e-9))
    return float(np.sqrt((gap * gap).sum()))


def merge_near(sets: dict[int, tuple], limit: float) -> dict[int, int]:
    """Greedy disjoint merges of the nearest pairs within the limit, as new ids of old ones."""
    pairs = sorted((min(_far(sets[a], sets[b]), _far(sets[b], sets[a])), a, b) for a in sets for b in sets if a < b)
    used, out = set(), {}
    for d, a, b in pairs:
        if d < limit and not used & {a, b}:
            used |= {a, b}
            out[b] = a
    return out


def bfr(points: DataFrame, dims: int, k: int, chunks: int = 5, seed: int = 0, keep=checkpointed) -> tuple[DataFrame, list[tuple]]:
    """((id, c), report) of points (id, v) by the Bradley-Fayyad-Reina algorithm.

    The first chunk is clustered with 5k means; its single points are retained
    (RS), the others give k discard summaries (DS). A point of a later chunk goes
    to the nearest DS within 2 sqrt(dims), else to the nearest compressed summary
    (CS), else to RS. After every chunk RS is clustered with 5k means into new CS
    and single points, and near CS are merged. At the end a CS goes to its
    nearest DS within the limit; what is left is -1. Summaries stay on the driver
    (a row a cluster), rows are written once a chunk. report: (chunk, points in
    DS, number of CS, points in CS, points in RS).
    """
    limit = 2.0 * dims**0.5
    spark = points.sparkSession
    dealt = points.select("id", "v").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(chunks)))
    ds: dict[int, tuple] = {}
    cs: dict[int, tuple] = {}
    placed, rest, report, fresh = None, None, [], k

    def table(sets: dict) -> DataFrame:
        return spark.createDataFrame([(c, n, s.tolist(), q.tolist()) for c, (n, s, q) in sets.items()], "c int, n long, s array<double>, q array<double>")

    def added(sets: dict, rows: DataFrame) -> None:
        for c, (n, s, q) in _sums(summaries(rows, dims).collect()).items():
            m = sets.get(c)
            sets[c] = (n, s, q) if m is None else (m[0] + n, m[1] + s, m[2] + q)

    def into(sets: dict, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that a summary takes, and the others."""
        if not sets:
            return rows.withColumn("c", F.lit(0)).limit(0), rows
        found = keep(rows.join(assign(rows, table(sets), dims).select("id", "c"), "id"))
        return found.where("c is not null"), found.where("c is null").drop("c")

    def singles(rows: DataFrame, means: int) -> tuple[DataFrame, DataFrame]:
        """Clusters of several points, and points alone."""
        found = keep(_fit(rows, means, seed))
        size = found.groupBy("c").agg(F.count("*").alias("n"))  # a row a cluster
        found = found.join(F.broadcast(size), "c")
        return found.where("n > 1").select("id", "v", "c"), found.where("n = 1").select("id", "v")

    for chunk in range(chunks):
        new = keep(dealt.where(F.col("chunk") == chunk).drop("chunk"))
        if placed is None:
            several, rest = singles(new, 5 * k)
            in_ds = keep(_fit(several, k, seed))
            added(ds, in_ds)
            placed = in_ds.select("id", "c")
        else:
            in_ds, left = into(ds, new)
            in_cs, left = into(cs, left)
            added(ds, in_ds)
            added(cs, in_cs)
            placed = placed.unionAll(in_ds.select("id", "c")).unionAll(in_cs.select("id", "c"))
            rest = rest.unionAll(left)
        rest = keep(rest)
        if rest.count() > 5 * k:
            several, rest = singles(rest, 5 * k)
            several = several.withColumn("c", F.col("c") + fresh)
            fresh += 5 * k
            added(cs, several)
            placed = placed.unionAll(several.select("id", "c"))
        moved = merge_near(cs, limit)
        if chunk == chunks - 1:
            moved |= {c: near for c, x in cs.items() if c not in moved for d, near in [min((_far(x, y), b) for b, y in ds.items())] if d < limit}
        for old, now in moved.items():
            target = ds if now in ds else cs
            target[now] = tuple(a + b for a, b in zip(target[now], cs[old], strict=True)) if now in target else cs[old]
        cs = {c: x for c, x in cs.items() if c not in moved}
        if moved:
            to = F.create_map(*[F.lit(x) for pair in _ended(moved).items() for x in pair])
            placed = placed.withColumn("c", F.coalesce(F.try_element_at(to, F.col("c")), F.col("c")))
        placed, rest = keep(placed), keep(rest)
        report.append((chunk, sum(x[0] for x in ds.values()), len(cs), sum(x[0] for x in cs.values()), rest.count()))
    final = placed.withColumn("c", F.when(F.col("c") < k, F.col("c")).otherwise(-1))
    return final.unionAll(rest.select("id", F.lit(-1).alias("c"))), report


def _ended(moved: dict[int, int]) -> dict[int, int]:
    """Merges of merges followed to their end."""
    out = {}
    for old, now in moved.items():
        while now in moved:
            now = moved[now]
        out[old] = now
    return out


def best_k(points: DataFrame, dims: int, ks: list[int], seed: int = 0) -> DataFrame:
    """(k, ch) of k-means for every k, the best by Calinski-Harabasz first."""
    spark = points.sparkSession
    found = [(k, calinski_harabasz(_fit(points, k, seed), dims).first()["ch"]) for k in ks]
    return spark.createDataFrame(sorted(found, key=lambda x: -x[1]), "k int, ch double")


def calinski_harabasz(points: DataFrame, dims: int) -> DataFrame:
    """One row ch for points (id, c, v), from summaries alone."""
    s = summaries(points, dims)
    inner = sum((F.col("q")[i] - F.col("s")[i] ** 2 / F.col("n") for i in range(1, dims)), F.col("q")[0] - F.col("s")[0] ** 2 / F.col("n"))
    total = s.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(inner).alias("within"), *[F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(dims)], *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    spread = sum((F.col(f"q{i}") - F.col(f"s{i}") ** 2 / F.col("n") for i in range(1, dims)), F.col("q0") - F.col("s0") ** 2 / F.col("n"))
    return total.select(F.round((spread - F.col("within")) / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k"))), 6).alias("ch"))
