"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

The graph starts from k-means cells: a vector sits in its PROBES nearest cells
and takes its DEGREE best neighbours there; cells larger than a task are cut into
blocks and every pair of blocks is one task. A round of NN-descent brings the
neighbours of a vector (its own and those that name it) together by a join; each
of these is offered to the others unless both were there the round before, and
whoever is better than a list's last entry enters it. Rounds end when at most
CHANGED of the entries are new. A search starts at the query's own list and opens
the WIDTH best vectors found so far by joining their lists, until all of them
have been opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, sized, table
from .vectors import fit_cells, matrix, valid
from .words import tidy

DEGREE, PROBES, PER_CELL = 16, 10, 256
SEATS = 4096  # vectors of one side of a task
CHANGED = 0.001  # of the entries: fewer new ones end the descent
WIDTH = 32  # of the search: it ends when the WIDTH best found are all opened


def _seats(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                unit = matrix(part.column(2).to_pylist(), size)
                centres = shared.value.get(size, np.zeros((1, size)))
                many = min(probes, len(centres))
                cells = np.argsort(-(unit @ centres.T), axis=1)[:, :many].reshape(-1)
                rows = pa.array(np.repeat(np.arange(len(unit)), many))
                short = pa.array([v.tobytes() for v in unit.astype(np.float32)], pa.binary()).take(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(cells, pa.int32()), short], ["id", "size", "cell", "vector"])

    return run


def _lists(unit: np.ndarray, others: np.ndarray | None, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best neighbours of every row among the others, or (None) among the rows but itself."""
    among = unit if others is None else others
    n = len(among)
    k = min(degree, n - (others is None))
    places, scores = np.empty((len(unit), k), np.int64), np.empty((len(unit), k), np.float32)
    for a in range(0, len(unit), 512):
        dots = unit[a : a + 512] @ among.T
        if others is None:
            dots[np.arange(len(dots)), np.arange(a, a + len(dots))] = -2
        best = np.argpartition(-dots, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), (len(dots), n))
        places[a : a + 512], scores[a : a + 512] = best, np.take_along_axis(dots, best, 1)
    return places, scores


_EDGES = "src long, dst long, score float"
_EDGE_SCHEMA = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float32())])


def _in_cell(degree: int):
    def run(group: pa.Table) -> pa.Table:
        ids, size = group.column("id").to_numpy(), group.column("size")[0].as_py()
        block, left, right = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        if len(ids) < 2:
            return _EDGE_SCHEMA.empty_table()
        unit = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(-1, size)
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        if not len(a) or not len(b):
            return _EDGE_SCHEMA.empty_table()
        found = []
        for x, y in [(a, None)] if left == right else [(a, b), (b, a)]:
            places, scores = _lists(unit[x], None if y is None else unit[y], degree)
            found.append((np.repeat(ids[x], places.shape[1]), ids[x if y is None else y][places].reshape(-1), scores.reshape(-1)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_EDGE_SCHEMA)

    return run


def _best(edges: DataFrame, degree: int, by: str = "src") -> DataFrame:
    """The best edges of every list."""
    other = "dst" if by == "src" else "src"
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), other)
    fresh = [F.min("fresh").alias("fresh")] if "fresh" in edges.columns else []  # an entry that was there is not new
    once = edges.groupBy("src", "dst").agg(F.max("score").alias("score"), *fresh)
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= degree).drop("nth")


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, id, fresh, least, vector) in runs of one centre in; better edges between its members, one of them fresh, out."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> pa.RecordBatch:
        centre = rows.column("centre").to_numpy()
        ids, least = rows.column("id").to_numpy(), rows.column("least").to_numpy()
        fresh = rows.column("fresh").to_numpy() > 0
        blobs = rows.column("vector").to_pylist()
        cuts = [0, *(np.flatnonzero(centre[1:] != centre[:-1]) + 1).tolist(), len(centre)] if len(centre) else [0]
        out = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            unit = np.frombuffer(b"".join(blobs[a:b]), np.float32).reshape(b - a, -1)
            dots = unit @ unit.T
            np.fill_diagonal(dots, -2)
            i, j = np.nonzero((dots > least[a:b, None]) & (fresh[a:b, None] | fresh[a:b]))
            out[0].append(ids[a:b][i])
            out[1].append(ids[a:b][j])
            out[2].append(dots[i, j])
        arrays = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.RecordBatch.from_arrays([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float32))], schema=_EDGE_SCHEMA)

    for batch in batches:
        if not len(batch):
            continue
        last = batch.column(0)[len(batch) - 1].as_py()
        whole = batch.column(0).to_numpy()
        stop = int(np.searchsorted(whole, last)) if whole[0] != last else 0
        if stop or (held and held[-1].column(0)[0].as_py() != whole[0]):
            yield settle(pa.Table.from_batches([*held, batch.slice(0, stop)]))
            held = []
        held.append(batch.slice(stop))
    if held:
        yield settle(pa.Table.from_batches(held))


def graph(vectors: DataFrame, scratch: Scratch, degree: int = DEGREE, changed: float = CHANGED) -> DataFrame:
    """Edges (src, dst, score) of the neighbour graph of (id, size, vector)."""
    spark = vectors.sparkSession
    named = vectors.select("size", F.col("id").alias("name"), "vector")
    centres = spark.sparkContext.broadcast(fit_cells(named, vectors.count(), PER_CELL))  # at most 2048 centroids a length
    seats = scratch.keep(vectors.select("id", "size", "vector").mapInArrow(tidy(_seats(centres, PROBES)), "id long, size int, cell int, vector binary"))
    blocks = seats.groupBy("size", "cell").agg(F.ceil(F.count("*") / SEATS).cast("int").alias("blocks"))
    dealt = seats.join(sized(blocks, 24), ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tasks = pairs.select("size", "cell", "i", "j", "id", "block", "vector").groupBy("size", "cell", "i", "j")
    edges = scratch.keep(_best(tasks.applyInArrow(_in_cell(degree), _EDGES), degree).withColumn("fresh", F.lit(1)))
    short = scratch.keep(seats.groupBy("id").agg(F.first("vector").alias("vector")))
    scratch.drop(seats)
    while True:
        least = edges.groupBy("src").agg(F.when(F.count("*") < degree, F.lit(-2.0)).otherwise(F.min("score")).cast("float").alias("least"))
        member = short.join(least, F.col("id") == F.col("src")).select("id", "least", "vector")
        named_by = _best(edges, degree, "dst").select(F.col("dst").alias("centre"), F.col("src").alias("id"), "fresh")
        around = edges.select(F.col("src").alias("centre"), F.col("dst").alias("id"), "fresh").unionAll(named_by)
        around = around.groupBy("centre", "id").agg(F.max("fresh").alias("fresh"))
        news = around.groupBy("centre").agg(F.max("fresh").alias("news")).where("news > 0").select("centre")
        met = around.join(news, "centre").join(member, "id").select("centre", "id", "fresh", "least", "vector")
        offers = met.repartition("centre").sortWithinPartitions("centre", "id").mapInArrow(tidy(_offer), _EDGES)
        new = scratch.keep(_best(edges.withColumn("fresh", F.lit(0)).unionAll(offers.withColumn("fresh", F.lit(1))), degree))
        scratch.drop(edges)
        edges = new
        count = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh")).first()
        if count["fresh"] <= changed * count["n"]:
            return edges.select("src", "dst", "score")


def _score(size_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(size_at).to_numpy()
            scores = np.zeros(len(batch))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.float64).reshape(-1, size) for i in (3, 4))
                a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
                scores[at] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["query", "id", "score"])

    return run


def nearest(rows: DataFrame, k: int = 5, queries=None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every query row.

    ``queries`` is a condition on the id column (default: all rows). Nearness is
    the cosine of the original vectors in double precision; ties go to the
    smaller vec_id; a row is not its own neighbour, an equal row is. Null, zero
    and non-finite vectors and those with null components take no part; vectors
    of different lengths are not compared. Equal vectors are one node of the
    graph and stand in the result one by one. A query with fewer than k rows to
    find gets these. Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    every = scratch.keep(valid(rows, id_column, vector_column).where("name is not null and vec_id is not null"))
    nodes = scratch.keep(every.groupBy("name").agg(F.min("vec_id").alias("id"), F.first("size").alias("size"), F.first("vector").alias("vector")))
    order = Window.partitionBy("name").orderBy("vec_id")
    members = scratch.keep(every.select("name", "vec_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).join(nodes.select("name", "id"), "name").select("id", "vec_id"))
    asked = every.select("name", "vec_id") if queries is None else every.where(queries).select("name", "vec_id")
    asked = scratch.keep(asked.join(nodes.select("name", "id"), "name").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")))
    edges = graph(nodes.select("id", "size", "vector"), scratch)
    lists = scratch.keep(edges.select("src", "dst").unionAll(_best(edges, DEGREE, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    starts = asked.select("query").distinct()
    vectors = nodes.select("id", "size", "vector")

    def scored(pairs: DataFrame) -> DataFrame:
        mine = vectors.select(F.col("id").alias("query"), F.col("size").alias("length"), F.col("vector").alias("mine"))
        both = pairs.join(vectors, "id").join(mine, "query").where("size = length")
        return both.select("query", "id", "size", "mine", "vector").mapInArrow(tidy(_score(2)), "query long, id long, score double")

    own = starts.select("query", F.col("query").alias("id"))
    found = scratch.keep(scored(own.unionAll(starts.join(lists, starts["query"] == lists["src"]).select("query", F.col("dst").alias("id"))).distinct()).withColumn("opened", F.col("query") == F.col("id")))
    while True:
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        ranked = found.withColumn("nth", F.row_number().over(by_score))
        front = scratch.keep(ranked.withColumn("opens", ~F.col("opened") & (F.col("nth") <= WIDTH)))
        scratch.drop(found)
        if front.where("opens").isEmpty():
            found = front
            break
        pairs = front.where("opens").join(lists, F.col("id") == F.col("src")).select("query", F.col("dst").alias("id")).distinct()
        fresh = scored(pairs.join(front.select("query", "id"), ["query", "id"], "left_anti")).withColumn("opened", F.lit(False))
        found = scratch.keep(front.select("query", "id", "score", (F.col("opened") | F.col("opens")).alias("opened")).unionAll(fresh))
        scratch.drop(front)
    by_nearness = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    close = found.withColumn("nth", F.row_number().over(by_nearness)).where((F.col("nth") <= k + 1) | (F.col("query") == F.col("id"))).select("query", "id", "score")
    answers = asked.join(close, "query").join(members, "id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)
