"""Stream sketches: batch forms over numbered batches, and Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trailing_zeros
from ..operators.sequences import positions


def numbered(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds ``batch``: the micro-batch, from 1, of ``size`` rows in order."""
    return positions(rows, *order, name="_nth").withColumn("batch", F.ceil(F.col("_nth") / size)).drop("_nth")


def bloom_false_positives(batches: DataFrame, key: str, bits: int = 69997, hashes: int = 3) -> DataFrame:
    """(batch, n, new, false_positives): keys not seen in earlier batches whose bits were all set by these. Fixed seeded hashes."""
    probe = batches.select("batch", F.col(key).alias("k")).distinct()
    first = Window.partitionBy("k")
    probe = probe.withColumn("seen", F.min("batch").over(first) < F.col("batch"))
    spots = probe.withColumn("bit", F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s), "k"), F.lit(bits)) for s in range(hashes)])))
    since = spots.groupBy("bit").agg(F.min("batch").alias("since"))
    hit = spots.join(since, "bit").groupBy("batch", "k", "seen").agg(F.min((F.col("since") < F.col("batch")).cast("int")).alias("all_set"))
    return hit.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(~F.col("seen")).alias("new"), F.count_if(~F.col("seen") & (F.col("all_set") == 1)).alias("false_positives"))


def flajolet_martin(batches: DataFrame, key: str, groups: int = 5, width: int = 3) -> DataFrame:
    """(batch, exact, estimate): median over groups of the mean of 2 ** longest run of trailing zeros, rounded."""
    runs = [F.pow(F.lit(2.0), F.max(trailing_zeros(F.xxhash64(F.lit(s), key)))) for s in range(groups * width)]
    means = [sum(runs[g * width : (g + 1) * width][1:], runs[g * width]) / width for g in range(groups)]
    exact = F.count_distinct(key).alias("exact")
    return batches.groupBy("batch").agg(exact, F.array_sort(F.array(*means)).alias("m")).select("batch", "exact", F.round(F.col("m")[groups // 2]).cast("long").alias("estimate"))


def reservoir(rows: DataFrame, key: str, size: int = 100, seed: int = 553) -> DataFrame:
    """A uniform sample of at most ``size`` rows: those with the smallest seeded hashes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(size)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Event-time counts by tumbling window and key; works on batch and streaming frames."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, delay)
    return stamped.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_distinct_stream(stream: DataFrame, key: str, state_path: str, checkpoint: str) -> DataFrame:
    """Exactly-once distinct keys of a finite stream: every micro-batch appends its unseen keys under its batch id."""
    spark = stream.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        keys = batch.select(F.col(key).alias("k")).distinct()
        if number:
            seen = spark.read.option("basePath", state_path).parquet(state_path).where(F.col("batch") < number).select("k")
            keys = keys.join(seen, "k", "left_anti")
        keys.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(state_path)
