"""Quality classifier by importance resampling.

Hashed n-gram models of the target (labelled good texts) and of three raw texts
(the whole corpus, labelled low-quality texts, labelled toxic texts) give log
ratios; a document's log weight is the smallest of its ratios, each counted from
the value that only CLEAN_LOSS of held-out good texts stay below. Documents are
drawn without replacement by Gumbel top-k: noise made from the id is added to the
log weight and the k largest keys stay. k is the count of documents of the whole
corpus with a log weight of 0 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, table

BITS, BLOCK = 18, 14
SAMPLE = 20_000  # labelled rows at most that are fitted and calibrated on, those with the smallest hashes
CLEAN_LOSS = 0.002
TEMPERATURE = 0.25
SCALE, LEVELS = 1 << 16, 4  # of keys in the search for the k-th
GOOD, JUNK, TOXIC = 0, 1, 2


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of rows, and their ranges."""
    _, _, hashes, first = W.word_hashes(raw, offsets, lower=True)
    mask = np.uint64((1 << BITS) - 1)
    pairs = W.mix(hashes[:-1] * np.uint64(W.MULTIPLIER) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    inside = np.ones(len(pairs), bool)
    ends = first[1:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(pairs))]] = False
    to = np.concatenate([[0], np.cumsum(inside)])
    pair_first = to[np.clip(first, 0, len(pairs))]
    return (hashes & mask).astype(np.int64), first, (pairs[inside] & mask).astype(np.int64), pair_first


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, raw, offsets in W.pieces(batch.column(0)):
            total += np.bincount(ngrams(raw, offsets)[0], minlength=1 << BITS)
    blocks = total.reshape(-1, 1 << BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), np.int64)
            sums[block] = sums[block] + part if block in sums else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[np.ndarray] = []
    for batch in batches:
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, raw, offsets in W.pieces(batch.column(0)):
            one, first, two, pair_first = ngrams(raw, offsets)
            for values, ranges, order in ((one, first, 0), (two, pair_first, 1)):
                found.append(np.repeat((kinds[a:b] * 2 + order) << BITS, np.diff(ranges)) + values)
        if sum(map(len, found)) > 4_000_000:
            found = [np.concatenate(found)]
            keys, counts = np.unique(found[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])
            found = []
    keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def _ratios(target: np.ndarray, raw: np.ndarray, smooth: float, least: float, one_sided: bool) -> np.ndarray:
    """Log ratios by bucket, both models scaled to the smaller; those under ``least`` count nothing."""
    size = min(target.sum(), raw.sum())
    if not size:
        return np.zeros(len(target), np.float32)
    ratio = np.log((target * (size / target.sum()) + smooth) / (raw * (size / raw.sum()) + smooth))
    ratio[np.abs(ratio) < least] = 0
    return (np.minimum(ratio, 0) if one_sided else ratio).astype(np.float32)


@dataclass
class Model:
    """Tables of fixed size; floors: where the log weight of each raw text starts; cut: the k-th largest key."""

    corpus: np.ndarray
    toxic: np.ndarray
    junk: np.ndarray
    floors: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cut: float = -np.inf

    def sums(self, column: pa.Array) -> np.ndarray:
        """Rows by (corpus, toxic, low quality): summed log ratios of each text."""
        out = []
        for _, _, raw, offsets in W.pieces(column):
            one, first, two, pair_first = ngrams(raw, offsets)
            parts = []
            for values, ranges in ((self.corpus[one], first), (self.toxic[one], first), (self.junk[two], pair_first)):
                total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                parts.append(total[ranges[1:]] - total[ranges[:-1]])
            out.append(np.stack(parts, 1))
        return np.concatenate(out) if out else np.zeros((0, 3))

    def log_weight(self, column: pa.Array) -> np.ndarray:
        return (self.sums(column) - np.array(self.floors)).min(axis=1)


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that depends on a value alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _kth(keys: DataFrame, k: int) -> float:
    """The k-th largest key (scaled to whole numbers), by histograms that refine one bucket a level; nothing is sorted."""
    bits, prefix, before = 10, None, 0
    code = (F.least(F.greatest(F.round(F.col("key") * SCALE), F.lit(-float(1 << 38))), F.lit(float(1 << 38))).cast("long") + F.lit(1 << 39)).alias("code")
    codes = keys.select(code)
    for level in range(LEVELS - 1, -1, -1):
        digit = F.shiftright("code", level * bits)
        rows = codes if prefix is None else codes.where(F.shiftright("code", (level + 1) * bits) == prefix)
        counts = sorted(((r["digit"], r["n"]) for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for digit_value, n in counts:  # at most 1024 rows
            prefix = digit_value
            if before + n >= k:
                break
            before += n
    return (prefix - (1 << 39)) / SCALE


def _keys(model: Model, docs: DataFrame, id_column: str, text_column: str, seed: int) -> DataFrame:
    """(doc_id, log_weight, key) of every row."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.log_weight(batch.column(1)), pa.float64())], ["doc_id", "log_weight"])

    scored = source.mapInArrow(W.tidy(run), f"doc_id {source.schema[0].dataType.simpleString()}, log_weight double")
    return scored.withColumn("key", F.col("log_weight") / TEMPERATURE + gumbel(F.col("doc_id"), seed))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Models, floors and the cut of the k-th key.

    ``labels`` has (doc_id, quality, toxic). At most ``sample`` labelled rows,
    those with the smallest hash of their id, are used: one half makes the
    target, low-quality and toxic models, the other half the floors. The corpus
    model and k count every document. Without labels everything is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, JUNK)
    known = labels.select(F.col("doc_id").alias("label_id"), kind.cast("long").alias("kind")).where("kind is not null and label_id is not null")
    known = known.groupBy("label_id").agg(F.max("kind").alias("kind")).orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(sample)
    known = scratch.keep(known.withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "label_id"), F.lit(2)) == 0))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    marked = scratch.keep(texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", "kind", "held"))  # sample rows at most
    counts = np.zeros((6, 1 << BITS))
    fitted = marked.where(~F.col("held")).select("text", "kind").mapInArrow(W.tidy(_labelled), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = fitted.toArrow()
    counts.reshape(-1)[found.column("key").to_numpy()] = found.column("n").to_numpy()
    corpus = np.zeros(1 << BITS)
    for row in texts.select("text").mapInArrow(W.tidy(_corpus), "block long, counts binary").repartition("block").mapInArrow(W.tidy(_add), "block long, counts binary").collect():
        corpus[row["block"] << BLOCK : (row["block"] + 1) << BLOCK] = np.frombuffer(row["counts"], np.int64)
    good = counts[GOOD * 2]
    model = Model(_ratios(good, corpus, 1, 3, True), _ratios(good, counts[TOXIC * 2], 1, 3, True), _ratios(counts[GOOD * 2 + 1], counts[JUNK * 2 + 1], 8, 0.7, False))
    shared = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = shared.value.sums(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(sums[:, i], pa.float64()) for i in range(3))], ["kind", "a", "b", "c"])

    held = marked.where("held").select("text", "kind").mapInArrow(W.tidy(calibrate), "kind long, a double, b double, c double").toArrow()
    sums = np.stack([held.column(c).to_numpy() for c in ("a", "b", "c")], 1)
    kinds = held.column("kind").to_numpy()
    if not (kinds == GOOD).any():
        return model
    model.floors = tuple(np.quantile(sums[kinds == GOOD], CLEAN_LOSS, axis=0, method="lower").tolist())
    keys = scratch.keep(_keys(model, docs, id_column, text_column, seed))
    k = keys.where("log_weight >= 0").count()
    model.cut = _kth(keys, k) if k else np.inf
    scratch.drop(marked, keys)
    return model


def score(docs: DataFrame, model: Model, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, log_weight, key, kept), one row for each input row.

    Null and empty texts have no n-grams and sums of 0. Repeated rows have one
    key and share their fate, as do keys that tie with the k-th. Other columns
    of the input are not read.
    """
    keys = _keys(model, docs, id_column, text_column, seed)
    return keys.withColumn("kept", F.round(F.col("key") * SCALE) >= F.lit(model.cut) * SCALE)


def keep(docs: DataFrame, model: Model, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that score() keeps, with all their columns; nothing is shuffled.

    Null and empty texts have sums of 0, repeated rows share their fate, columns
    may have any names, an empty input gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.names.index(text_column)
    noise = "_" * (1 + max(map(len, schema.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            key = m.log_weight(batch.column(at)) / TEMPERATURE + batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            stay = pa.array(np.floor(key * SCALE + 0.5) >= m.cut * SCALE)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(stay)

    return docs.withColumn(noise, gumbel(F.col(id_column), seed)).mapInArrow(W.tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
