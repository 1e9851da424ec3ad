"""Embedding near-dedup: spherical k-means cells, blocked cosines within cells.

A vector lives in the cell of its nearest centroid (home). Two unit vectors with
cosine >= t are at most r = sqrt(2 - 2t) apart, so for homes i and j the sum of
their distances to the plane between centroids i and j is at most r, and one of
them is within r / 2 of it. Each vector is therefore a guest in every cell whose
plane is within r / 2: every link has both ends in the home cell of one of them,
and none is lost. Homes are compared with homes and guests.

Inside a task most pairs fall to a bound in single precision: a fixed rotation
turns the vectors, HEAD of their coordinates are multiplied, and the rest counts
by its length (Cauchy-Schwarz), so the bound is never below the cosine. Only rows
and columns that a pair survives in are multiplied whole, in double precision.
Hits are counted by row and column sums and joined by propagated labels, so a
group of near copies costs matrix products and leaves the task as a forest.
Cells larger than a task are cut into blocks and every pair of blocks is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, components, sized, table
from .vectors import fit_cells, matrix, valid
from .words import tidy

BLOCK = 4096  # homes of a task; guests and homes on the other side: twice as many
PER_CELL = 4096  # vectors that a cell is meant to hold
HEAD = 28  # coordinates of the bound
SLACK = 1e-4  # what single precision may lose


def _place(shared, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                unit = matrix(part.column(3).to_pylist(), size)
                homes, guests = np.zeros(len(unit), np.int64), [[] for _ in unit]
                if size in centres:
                    c = centres[size]
                    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-30))
                    for a in range(0, len(unit), 1024):
                        dots = unit[a : a + 1024] @ c.T
                        home = dots.argmax(axis=1)
                        homes[a : a + 1024] = home
                        near = (dots.max(axis=1)[:, None] - dots) / apart[home] <= radius / 2 + 1e-9
                        near[np.arange(len(home)), home] = False
                        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                            guests[a + i].append(j)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), part.column(4), pa.array(homes, pa.int32()), pa.array(guests, pa.list_(pa.int32()))], ["rep", "size", "name", "vector", "copies", "home", "guests"])

    return run


def heads(unit: np.ndarray) -> np.ndarray:
    """Rows whose products bound the cosines of the rows of unit from above: the first rotated coordinates and the length of the rest."""
    size = unit.shape[1]
    if size <= HEAD + 1:
        return unit.astype(np.float32)
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((size, size)))[0]
    turned = unit @ turn
    return np.concatenate([turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1, keepdims=True)], axis=1).astype(np.float32)


def link_blocks(left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, hits): where rows of left and right have a cosine >= threshold, as blocks of a matrix that are not all False."""
    out, tops = [], heads(right)
    for a in range(0, len(left), 512):
        some = left[a : a + 512]
        near = heads(some) @ tops.T >= threshold - SLACK
        rows = np.flatnonzero(near.any(axis=1))
        columns = np.flatnonzero(near[rows].any(axis=0))
        if not len(rows):
            continue
        hits = some[rows] @ right[columns].T >= threshold
        rows, hits = rows[keep := hits.any(axis=1)], hits[keep]
        columns, hits = columns[keep := hits.any(axis=0)], hits[:, keep]
        out.append((rows + a, columns, hits))
    return out


def lowest(count: int, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of count nodes the smallest node it reaches; blocks: (rows, columns, hits) over nodes."""
    label = np.arange(count)
    while True:
        before = label.copy()
        for rows, columns, hits in blocks:
            new = np.minimum(np.where(hits, label[columns], count).min(axis=1), label[rows])
            np.minimum.at(label, label[rows], new)
            np.minimum.at(label, rows, new)
            new = np.minimum(np.where(hits, label[rows][:, None], count).min(axis=0), label[columns])
            np.minimum.at(label, label[columns], new)
            np.minimum.at(label, columns, new)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _compare(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        size, cell = group.column("size")[0].as_py(), group.column("cell")[0].as_py()
        group = group.take(pa.array(np.argsort(group.column("rep").to_numpy(), kind="stable")))
        ids, copies, home = (group.column(c).to_numpy() for c in ("rep", "copies", "home"))
        unit = matrix(group.column("vector").to_pylist(), size)
        rows, columns = np.flatnonzero(group.column("as_home").to_numpy(zero_copy_only=False)), np.flatnonzero(group.column("as_seat").to_numpy(zero_copy_only=False))
        if not len(rows) or not len(columns):
            return schema.empty_table()
        blocks = [(rows[r], columns[c], h) for r, c, h in link_blocks(unit[rows], unit[columns], threshold)]
        count = np.zeros(len(ids), np.int64)
        guests = group.column("guests").to_pylist()
        for r, c, hits in blocks:
            hits[r[:, None] == c[None, :]] = False  # a row and itself
            count[r] += hits @ copies[c]
            # a guest counts here what it does not see in its own cell
            away = home[c] != cell
            if away.any():
                c = c[away]
                cells, at = np.unique(home[c], return_inverse=True)
                place = {x: i for i, x in enumerate(cells.tolist())}
                seen = np.zeros((len(r), len(cells)), bool)
                for i, x in enumerate(r.tolist()):
                    seen[i, [place[g] for g in guests[x] if g in place]] = True
                count[c] += copies[r] @ (hits[:, away] & ~seen[:, at])
        label = lowest(len(ids), blocks)
        linked = np.flatnonzero((count > 0) | (label != np.arange(len(ids))))
        return pa.table([pa.array(ids[linked], pa.int64()), pa.array(ids[label[linked]], pa.int64()), pa.array(count[linked], pa.int64())], schema=schema)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Links are pairs with cosine >= threshold in double precision, whatever their
    labels. Null, zero and non-finite vectors and those with null components link
    with nothing, nor do vectors of different lengths. n_links counts linked rows
    other than the row itself, component_id is the smallest vec_id reachable,
    kept marks vec_id = component_id. Equal vectors are one class and are
    compared once. Rows that repeat a vec_id with one vector are copies; with
    different vectors their links add up. Centroids are fitted on at most SAMPLE
    vectors; every vector is compared. Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    every = scratch.keep(valid(rows, id_column, vector_column))
    classes = scratch.keep(every.where("name is not null").groupBy("name").agg(F.min("vec_id").alias("rep"), F.first("size").alias("size"), F.first("vector").alias("vector"), F.count("*").alias("copies")).select("rep", "size", "name", "vector", "copies"))
    centres = spark.sparkContext.broadcast(fit_cells(classes, classes.count(), PER_CELL))  # at most 2048 centroids a length
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    placed = scratch.keep(classes.mapInArrow(tidy(_place(centres, radius)), "rep long, size int, name binary, vector binary, copies long, home int, guests array<int>"))
    # seats: a home as home and on the other side, a guest on the other side; blocks of a cell by a hash of the vector
    homes = placed.groupBy("size", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    seats = placed.select("size", F.explode(F.concat(F.array("home"), "guests")).alias("cell")).groupBy("size", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("columns"))
    cells = scratch.keep(homes.join(seats, ["size", "cell"]))  # cells without a home have no pair
    hashed = F.xxhash64("name")
    seat = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "guests"))).join(sized(cells, 24), ["size", "cell"])
    seat = seat.withColumns({"i": F.when(F.col("cell") == F.col("home"), F.pmod(hashed, F.col("rows"))).cast("int"), "j": F.pmod(hashed, F.col("columns")).cast("int")})
    # every row block of a cell meets every column block; the row itself may stand on both sides of a task
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda x: F.struct(F.col("i").alias("i"), x.alias("j"), F.lit(True).alias("as_home"), (x == F.col("j")).alias("as_seat")))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda x: F.struct(x.alias("i"), F.col("j").alias("j"), F.lit(False).alias("as_home"), F.lit(True).alias("as_seat")))
    down = F.filter(down, lambda x: F.col("i").isNull() | (x["i"] != F.col("i")))
    tasks = seat.withColumn("task", F.explode(F.concat(F.when(F.col("i").isNotNull(), across).otherwise(F.array().cast("array<struct<i:int,j:int,as_home:boolean,as_seat:boolean>>")), down)))
    tasks = tasks.select("size", "cell", F.col("task.i").alias("i"), F.col("task.j").alias("j"), F.col("task.as_home").alias("as_home"), F.col("task.as_seat").alias("as_seat"), "rep", "vector", "copies", "home", F.when(F.col("task.as_home"), F.col("guests")).otherwise(F.array().cast("array<int>")).alias("guests"))
    found = scratch.keep(tasks.groupBy("size", "cell", "i", "j").applyInArrow(_compare(threshold), "a long, b long, links long"))
    whole = components(found.where("a <> b").select("a", "b"), scratch)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    summary = classes.select("name", "rep", "copies").join(links, "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    summary = summary.select("name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")).where("links > 0")
    out = every.select("vec_id", "name").join(summary, "name", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
