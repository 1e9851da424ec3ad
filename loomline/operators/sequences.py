"""Ordered and token-sequence operators: fills, lookbacks, HMM counts and decoders, TF-IDF."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import checkpointed


def positions(rows: DataFrame, *order: str | Column, name: str = "nth", total: str | None = None) -> DataFrame:
    """Adds ``name``, the place (long, from 1) of every row in an order, and if named the count of all rows.

    Rows are dealt by ranges of the order, sorted and written there, so no task
    takes the whole table; only the row counts of the ranges meet in one task.
    Equal rows are numbered in any order; an order should end in a key, as rows
    equal in all of it share a range.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    found = placed.withColumn("range", part).join(F.broadcast(sums), "range")
    added = [(inside + F.col("before") + 1).alias(name)] + ([F.col("all").alias(total)] if total else [])
    return found.select("row.*", *added)


def nearest_gap(points: DataFrame, values: DataFrame) -> DataFrame:
    """(id, gap) for every row of points (id, x): the least |x - value| over all rows of values (value), as min(abs(x - value)) over their cross product.

    Both are dealt by ranges of the number and sorted there. A range needs of
    the others only the last value before it and the first after it, which meet
    in the driver: two numbers a range. What is not finite is decided by counts.
    """
    x = F.col("x")
    is_finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    value, inf = F.col("value"), float("inf")
    has = values.select(value.cast("double").alias("value")).agg(F.count("*").alias("n"), F.count("value").alias("known"), F.count_if(is_finite(value)).alias("finite"), F.count_if(value == inf).alias("up"), F.count_if(value == -inf).alias("down")).first()
    if not has["n"]:
        return points.select("id", F.lit(None).cast("double").alias("gap")).limit(0)
    both = points.select("id", x.cast("double").alias("x"), F.lit(True).alias("asks")).unionAll(values.select(F.lit(None), value.cast("double"), F.lit(False)).where(is_finite(F.col("value"))).toDF("id", "x", "asks"))
    dealt = both.repartitionByRange("x").sortWithinPartitions("x").withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33))
    placed = checkpointed(dealt)
    ends = {r["range"]: (r["low"], r["high"]) for r in placed.where("NOT asks").groupBy("range").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part = table.column("range")[0].as_py()
        asks, at = table.column("asks").to_numpy(zero_copy_only=False), table.column("x").to_numpy(zero_copy_only=False)
        outside = [max((ends[r][1] for r in ends if r < part), default=-inf), *at[~asks], min((ends[r][0] for r in ends if r > part), default=inf)]
        known, p = np.sort(np.array(outside)), at[asks]
        place = np.clip(np.searchsorted(known, p), 1, len(known) - 1)
        with np.errstate(invalid="ignore"):  # what is not finite is decided below
            gap = np.minimum(np.abs(p - known[place - 1]), np.abs(p - known[place]))
        asked = table.select(["id", "x"]).filter(pa.array(asks))
        yield from asked.append_column("gap", pa.array(gap)).to_batches()

    kind = points.schema["id"].dataType.simpleString()
    near = placed.mapInArrow(run, f"id {kind}, x double, gap double")
    other = F.when((F.lit(has["down"]) > 0) & (x == inf) | (F.lit(has["up"]) > 0) & (x == -inf) | (F.lit(has["finite"]) > 0) & (F.abs(x) == inf), inf)
    far = other.when(F.isnan(x) | (F.abs(x) == inf), F.when(F.lit(has["known"]) > 0, float("nan"))).when(F.lit(has["up"] + has["down"]) > 0, inf).when(F.lit(has["known"]) > 0, float("nan"))
    return near.select("id", F.when(x.isNull(), None).when(is_finite(x) & F.lit(has["finite"] > 0), F.col("gap")).otherwise(far).alias("gap"))


def tiles(rows: DataFrame, parts: int, *order: str | Column, name: str = "part_id") -> DataFrame:
    """Adds ``name`` (from 1): contiguous parts of an order, the first ones a row larger where the rows don't divide evenly."""
    size, extra = F.floor(F.col("_total") / parts), F.col("_total") % parts
    place, large = F.col("_nth") - 1, extra * (size + 1)
    tile = F.when(place < large, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - large) / F.greatest(size, F.lit(1))))
    return positions(rows, *order, name="_nth", total="_total").withColumn(name, (tile + 1).cast("int")).drop("_nth", "_total")


def forward_fill(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Fills nulls with the last value, at most ``limit`` rows back."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def lookback(rows: DataFrame, value: str, order: list[str], length: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``past``: the last ``length`` values before each row; rows with fewer go."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-length, -1)
    return rows.withColumn("past", F.collect_list(value).over(w)).where(F.size("past") == length)


def transitions(tagged: DataFrame) -> DataFrame:
    """(before, tag, p) of rows (sent, idx, word, tag); before is start at the first word."""
    pairs = tagged.select(F.lag("tag", 1, "start").over(Window.partitionBy("sent").orderBy("idx")).alias("before"), "tag")
    n = pairs.groupBy("before", "tag").agg(F.count("*").alias("n"))
    return n.select("before", "tag", (F.col("n") / F.sum("n").over(Window.partitionBy("before"))).alias("p"))


def emissions(tagged: DataFrame, lower: bool = False) -> DataFrame:
    word = F.lower("word") if lower else F.col("word")
    n = tagged.groupBy("tag", word.alias("word")).agg(F.count("*").alias("n"))
    return n.select("tag", "word", (F.col("n") / F.sum("n").over(Window.partitionBy("tag"))).alias("p"))


def decode(tagged: DataFrame, sentences: DataFrame, viterbi: bool = True, unknown: str = "NNP") -> DataFrame:
    """(sent, idx, tag) for (sent, idx, word): Viterbi in log space or greedy. An unknown first word gets ``unknown``; a later one follows the likeliest next tag.

    Tags are few: their transitions are shipped with the function. The vocabulary
    is not: every word meets its tags by a join. A sentence is decoded in one task.
    """
    trans = {(r["before"], r["tag"]): math.log(r["p"]) for r in transitions(tagged).collect()}
    known = sorted({b for _, b in trans})
    emitted = emissions(tagged).groupBy("word").agg(F.collect_list(F.struct("tag", F.log("p").alias("log"))).alias("e"))
    asked = sentences.select("sent", "idx", "word").join(emitted, "word", "left").select("sent", "idx", F.col("e.tag").alias("_tags"), F.col("e.log").alias("_logs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        best, links = {"start": 0.0}, []
        for i, (tags, logs) in enumerate(zip(pdf["_tags"], pdf["_logs"], strict=True)):
            options = dict(zip(tags, logs, strict=True)) if tags is not None else {unknown: 0.0} if i == 0 else dict.fromkeys(known, 0.0)
            step, back = {}, {}
            for tag in sorted(options):
                score, before = max((s + trans.get((b, tag), -1e3), b) for b, s in sorted(best.items()))
                step[tag], back[tag] = score + options[tag], before
            if not viterbi:
                top = max(sorted(step), key=step.get)
                step = {top: step[top]}
            best = step
            links.append(back)
        tag, out = (max(sorted(best), key=best.get) if links else None), []
        for back in reversed(links):
            out.append(tag)
            tag = back[tag]
        return pd.DataFrame({"sent": pdf["sent"], "idx": pdf["idx"], "tag": out[::-1]})

    return asked.groupBy("sent").applyInPandas(run, "sent long, idx long, tag string")


TEXTS = 5_000  # whose words a task weighs
HELD_WORDS = 200_000  # words a task counts before it hands the counts on


def _cutter():  # without a name in the module it goes whole to the workers, which need not import it
    other = re.compile("[^a-zA-Z0-9]+")
    return lambda text: other.sub(" ", text).lower().split() if text else []


def by_text(rows: DataFrame, made, schema: str) -> DataFrame:
    """Rows (id, text) cut once: ``made(id, words)`` gives the rows of ``schema``; words as functions.text.tokens makes them, without empty ones."""
    cut, names = _cutter(), [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [r for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in made(i, cut(text))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds) if out else pa.RecordBatch.from_pylist([], kinds)

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.select("id", "text").mapInArrow(run, schema)


def word_totals(rows: DataFrame) -> DataFrame:
    """(word, n) over rows (text). A task hands on its counts, not its words."""
    cut, most = _cutter(), HELD_WORDS

    def run(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cut(text))
                if len(seen) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(rows: DataFrame, words: int) -> list[str]:
    """The most frequent words of rows (text), ties in their order: at most ``words``."""
    return [r["word"] for r in word_totals(rows).orderBy(F.desc("n"), "word").limit(words).collect()]


def tfidf(docs: DataFrame, words: int = 10000) -> DataFrame:
    """(id, word, w) of (id, text): smooth idf ln((1+n)/(1+df)) + 1, rows of unit length, over the most frequent words.

    Texts are cut twice, for the vocabulary (bounded by ``words``) and for its
    counts; other words don't leave a task. Rows of one id count together.
    """
    top = top_words(docs, words)
    place = {w: i for i, w in enumerate(top)}
    kind = docs.schema["id"].dataType.simpleString()
    found = by_text(docs, lambda i, cut: [(i, w, n) for w, n in Counter(place[t] for t in cut if t in place).items()], f"id {kind}, w int, n long")
    n = docs.count()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // TEXTS))
    tf = found.repartition(parts, "id").groupBy("id", "w").agg(F.sum("n").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    each = tf.join(F.broadcast(df), "w")  # at most ``words`` rows
    weighted = each.select("id", "w", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("x"))
    unit = weighted.select("id", "w", (F.col("x") / F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy("id")))).alias("x"))
    return unit.select("id", F.element_at(F.lit(top) if top else F.array(F.lit("")), F.col("w") + 1).alias("word"), F.col("x").alias("w"))
