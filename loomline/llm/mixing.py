"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a fixed hash. Words are summed by source and by the hash's
leading digits; a source's budget falls into one bucket, which alone is refined
by the next digits, until it holds one hash value. Documents below the found
threshold are taken once more than the others: no sort, and a rerun agrees.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, sized, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5  # 60 bits of hash in all
WEIGHTS = (5, 2, 1)
REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words: every word becomes one mark, all else goes."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD + "+", "\x01")
    return (F.length(marked) - F.length(F.translate(marked, "\x01", ""))).cast("long")


def _level(total: int, sources: DataFrame, repeats: int) -> Fraction:
    """Words for one unit of weight, after the targets that stop at their source's limit have given back the excess."""
    level = Fraction(0)
    while True:
        # a source is full if weight * level > repeats * words; exact in decimals
        full = F.col("weight").cast("decimal(38,0)") * F.lit(str(level.numerator)).cast("decimal(38,0)") > F.col("words").cast("decimal(38,0)") * F.lit(str(level.denominator * repeats)).cast("decimal(38,0)")
        row = sources.agg(F.sum(F.when(full, F.col("words")).otherwise(0)).alias("used"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return level
        new = Fraction(total - repeats * row["used"], row["weight"])
        if new == level:
            return level
        level = new


def _hashed(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str, *more: Column) -> DataFrame:
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), *more)
    return base.withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "size"), 64 - BITS * LEVELS))


def _copies(repeats: int, hash_column: str) -> Column:
    return F.least(F.col("whole") + (F.col(hash_column) < F.col("cut")).cast("long"), F.lit(repeats).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """How often every document is taken so that its source comes near its target.

    Sources in order of code points (null last) weigh ``weights``, repeating,
    and share the words of all documents; a target stops at ``repeats`` times its
    source's words and the excess is reshared by weight. A document is taken
    whole, 0 to ``repeats`` times: as often as its source's target divided by its
    words, rounded down, and once more if its hash is below the source's
    threshold. The threshold is put before or after the hash that crosses the
    budget, whichever comes nearer. Returns (doc_id, size, source_size, target,
    copies, taken); taken = copies * size. Documents without words have size 0
    and add nothing. Rows that repeat id, source and size have one hash and share
    their fate. Other columns of the input are not read.
    """
    base, cut = _plan(docs, weights, repeats, seed, id_column, text_column, source_column)
    taken = base.join(cut, F.col("source").eqNullSafe(F.col("b_source")))
    copies = _copies(repeats, "hash")
    return taken.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself: the rows of the input with all their columns, each as often as mix() takes it.

    Columns may have any names; the row travels as one struct. Documents without
    words (null, empty or blank texts) have size 0 and are taken like the others
    of their source, by their hash; a source without any words is taken 0 times.
    A null source is a source of its own. Repeated rows share their fate. An
    empty input gives an empty mix.
    """
    _, cut = _plan(docs, weights, repeats, seed, id_column, text_column, source_column)
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    rows = _hashed(docs, seed, id_column, text_column, source_column, whole).join(cut, F.col("source").eqNullSafe(F.col("b_source")))
    rows = rows.select("row", _copies(repeats, "hash").alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def _plan(docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: int, id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of all documents, and for each source how often its documents are taken."""
    scratch = Scratch(docs.sparkSession)
    base = scratch.keep(_hashed(docs, seed, id_column, text_column, source_column))
    sources = base.groupBy("source").agg(F.sum("size").alias("words"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = scratch.keep(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")))
    total, count = sources.agg(F.sum("words"), F.count("*")).first()
    total = total or 0
    level = _level(total, sources, repeats)
    share = F.col("weight") * F.lit(level.numerator / level.denominator)
    goal = F.least(share, F.col("words") * F.lit(float(repeats)))
    whole = F.when(F.col("words") > 0, F.least(F.floor(goal / F.col("words")), F.lit(repeats))).otherwise(0).cast("long")
    plan = sources.select("source", F.col("words").alias("source_size"), goal.alias("target"), whole.alias("whole")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    # the bucket in which the rest of the budget ends, level by level; below: words before it, prefix: its digits
    bound = scratch.keep(plan.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    same = F.col("source").eqNullSafe(F.col("b_source"))
    for depth in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - depth)
        digits = F.shiftrightunsigned("hash", shift)
        inside = bound.select(F.col("source").alias("b_source"), F.col("prefix").alias("b_prefix"))
        rows = base.join(sized(inside, 64, count), same & (F.shiftrightunsigned("hash", shift + BITS) == F.col("b_prefix")))
        summed = rows.groupBy("source", digits.alias("bucket")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("bucket")
        found = summed.withColumn("before", F.sum("size").over(order) - F.col("size"))
        found = found.join(sized(bound.select(F.col("source").alias("b_source"), "left", "below"), 64, count), same)
        found = found.where(F.col("below") + F.col("before") <= F.col("left")).groupBy("source").agg(F.max_by(F.struct("bucket", (F.col("below") + F.col("before")).alias("below"), "size"), "bucket").alias("at"))
        new = bound.join(sized(found.select(F.col("source").alias("b_source"), "at"), 64, count), same, "left")
        columns = ["source", "source_size", "target", "whole", "left", F.coalesce("at.bucket", F.lit(-1)).alias("prefix"), F.coalesce("at.below", "below").alias("below"), F.coalesce("at.size", F.lit(0)).alias("last")]
        bound = scratch.keep(new.select(*columns))
    nearer = F.abs(F.col("below") + F.col("last") - F.col("left")) < F.abs(F.col("below") - F.col("left"))
    cut = bound.select(F.col("source").alias("b_source"), "source_size", "target", "whole", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))
    return base, sized(cut, 64, count)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
