"""Tables that a job writes on its way, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where it is unset a
session on one machine (master local) gets a temporary folder; any other is
refused. A written table cuts lineage: a lost executor costs a re-read, not a
re-run. What a run leaves is deleted when the application ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
BATCH_BYTES = 8 << 20  # of an Arrow batch, which Python workers and the JVM hold several times over


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes (by rows alone, texts of any length make them large); a session that sets a bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > 64 << 20:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """The tables of one run; each is written once and read from then on."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded(spark)
        self.base = f"{folder(spark)}/loomline-{uuid.uuid4().hex}"
        self.count = 0
        path, system = self._at(self.base)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, path: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count:04d}"
        self.count += 1
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        del df
        sweep(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path, system = self._at(f._scratch_path)
            system.delete(path, True)


def sized(df: DataFrame, bytes_per_row: int, rows: int | None = None) -> DataFrame:
    """Marks a side for broadcast if its counted rows stay under BROADCAST_BYTES; beyond, it stays a shuffled side."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of an edge (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds; every round is one written
    table, minima are combined before the shuffle and hot nodes are joined by a
    splittable join. Loops (a = b) are left out.
    """
    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(both)
    had = mark(now)
    while True:
        und = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = und.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = und.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        new = scratch.keep(small.where("a <> b").distinct())
        scratch.drop(now)
        now, before, had = new, had, mark(new)
        if before == had:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt(column: str, parts: Column | int) -> Column:
    """A part number that depends on the value alone, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(7919), F.col(column)), parts if isinstance(parts, Column) else F.lit(parts))
