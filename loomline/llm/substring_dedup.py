"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of a text start at its words; the tree is sparse. Of the PREFIX-word
prefixes inside a window of 20 words the one with the smallest hash is the
window's anchor: equal windows have equal anchors at equal offsets, and about one
suffix in seven starts at one. A window is read as a rotated string, from its
anchor right to its end and then left to its start, so equal windows are equal
paths from the root.

1. Prefixes of PREFIX words are counted; a suffix whose prefix nobody shares is a
   leaf below it and goes no further.
2. The other suffixes get the words that their windows span and are partitioned
   by prefix. A prefix with more than GROUP suffixes is extended, by STEP words at
   a time, until its parts fit a task; at full depth a prefix is a window itself
   and its suffixes are read as a stream.
3. A task takes whole prefixes, as many as fit, and builds their trees as suffix
   and LCP arrays, one over the words right of the anchors and one over the words
   left of them. A pair of nodes of depth 20 in all that holds several leaves is a
   repeat; all its leaves but the earliest lose their words.

Equal suffixes inside one task of the readers are settled before any shuffle, so
a passage of a third of all documents comes once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, sized, table

PREFIX, STEP = 8, 6  # words of the shortest prefix; words that a prefix is extended by
GROUP = 50_000  # suffixes that a prefix may have
TASK = 16_384  # suffixes in the arrays of one step of a task
RUNS = 400_000  # suffixes of one reader that are settled together
HOT = 200_000  # equal suffixes that a reader remembers
NULL_ID = -(1 << 63)  # stands for a null doc_id, which comes before all others

_ROW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("spot", pa.int32()), ("lead", pa.int16()), ("many", pa.int16()), ("depth", pa.int16()), ("words", pa.binary())])
_ROW_SQL = "key long, doc long, spot int, lead short, many short, depth short, words binary"
_RUN_SQL = "doc long, start long, many long"


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(W.MULTIPLIER) + hashes[i : i + len(out)]
    return W.mix(out + np.uint64(k))


def anchored_windows(hashes: np.ndarray, first: np.ndarray, size: int, prefix: int):
    """Runs of windows with one anchor: (row, word of the anchor, words from the first window to the anchor, windows, key of the prefix, hash of the run)."""
    total = len(hashes)
    if total < size:
        return None
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(total - size + 1)
    starts = starts[row_of[starts] == row_of[starts + size - 1]]
    if not len(starts):
        return None
    short = _rolled(hashes, prefix)
    best = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, size - prefix + 1)
    for a in range(0, len(starts), 16384):
        part = starts[a : a + 16384]
        best[a : a + 16384] = part + view[part].argmin(axis=1)
    at = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    many = np.diff(np.concatenate([at, [len(starts)]]))
    names = _rolled(hashes, size)  # the first and the last window of a run cover it
    anchor, begin = best[at], starts[at]
    whole = W.mix(names[begin] + W.mix(names[begin + many - 1] + (anchor - begin).astype(np.uint64) * np.uint64(64) + many.astype(np.uint64)))
    return row_of[begin], anchor, anchor - begin, many, short[anchor], whole


def _spread(doc: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Keys for rows that need no partner."""
    return W.mix(doc.astype(np.uint64) * np.uint64(W.MULTIPLIER) + spot.astype(np.uint64))


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc = batch.column(0).to_numpy()
    return batch if (doc[1:] >= doc[:-1]).all() else batch.take(pa.array(np.argsort(doc, kind="stable")))


def _prefixes(size: int, prefix: int):
    """(key, doc, spot, times) of every suffix; equal prefixes read together: the first has their number, the others have 0 and a key of their own."""

    def settle(parts: list) -> pa.RecordBatch:
        key, doc, spot = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, back, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        times = np.zeros(len(key), np.int64)
        times[first] = counts
        key = np.where(times > 0, key, _spread(doc, spot))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(spot.astype(np.int32)), pa.array(times.astype(np.int32))], ["key", "doc", "spot", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for a, _, raw, offsets in W.pieces(batch.column(1)):
                _, _, hashes, first = W.word_hashes(raw, offsets)
                if (found := anchored_windows(hashes, first, size, prefix)) is None:
                    continue
                rows, anchor, _, _, key, _ = found
                parts.append((key, docs[a + rows], anchor - first[rows]))
                held += len(key)
                if held > RUNS:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _prefixes sorted by key in; (doc, spot, key) out: suffixes whose prefix is shared (key null), and prefixes with more than GROUP suffixes (doc null)."""
    last, total, waits = None, 0, None  # the key so far, its suffixes, its only row
    for batch in batches:
        if not len(batch):
            continue
        key, doc, spot, times = (batch.column(i).to_numpy() for i in range(4))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(times.astype(np.int64), at)
        sizes = np.diff(np.concatenate([at, [len(key)]]))
        go_on = key[0] == last
        shared = np.repeat((sizes > 1) | (sums > 1) | (times[at] == 0), sizes)
        out_doc, out_spot = [doc[shared]], [spot[shared]]
        if go_on:
            head = np.arange(sizes[0])
            out_doc.append(doc[head][~shared[head]])
            out_spot.append(spot[head][~shared[head]])
            if waits is not None:
                out_doc.append(np.array([waits[0]]))
                out_spot.append(np.array([waits[1]], np.int32))
            sums[0] += total
        big = key[at][:-1][sums[:-1] > GROUP]
        if not go_on and total > GROUP:
            big = np.concatenate([[last], big])
        waits = (doc[-1], spot[-1]) if sizes[-1] == 1 and not shared[-1] and not (go_on and len(at) == 1) else None
        last, total = key[-1], sums[-1]
        docs = np.concatenate(out_doc)
        yield _found(docs, np.concatenate(out_spot), big)
    if total > GROUP:
        yield _found(np.zeros(0, np.int64), np.zeros(0, np.int32), np.array([last]))


def _found(doc: np.ndarray, spot: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(big)
    columns = [pa.concat_arrays([pa.array(doc, pa.int64()), pa.array(none, pa.int64())]), pa.concat_arrays([pa.array(spot, pa.int32()), pa.array(none, pa.int32())]), pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(big, pa.int64())])]
    return pa.RecordBatch.from_arrays(columns, ["doc", "spot", "key"])


def _suffixes(size: int, prefix: int):
    """(doc, text, spots) in; the chosen suffixes with the words of their windows out. Those equal to an earlier one of this reader come without words: all their windows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # name, doc, spot of the earliest
        for batch in batches:
            batch = _ordered(batch)
            docs = batch.column(0).to_numpy()
            for a, b, raw, offsets in W.pieces(batch.column(1), 4 * W.PIECE):
                _, _, hashes, first = W.word_hashes(raw, offsets)
                if (found := anchored_windows(hashes, first, size, prefix)) is None:
                    continue
                rows, anchor, lead, many, key, whole = found
                spots = batch.column(2).slice(a, b - a)
                marked = np.repeat(np.arange(b - a), np.diff(spots.offsets.to_numpy())) << 32 | spots.flatten().to_numpy()
                spot = anchor - first[rows]
                chosen = np.flatnonzero(np.isin(rows << 32 | spot, marked))
                if not len(chosen):
                    continue
                anchor, lead, many, key, whole, spot = (x[chosen] for x in (anchor, lead, many, key, whole, spot))
                doc = docs[a + rows[chosen]]
                names, at, back, counts = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                known = (doc != doc[at][back]) | (spot != spot[at][back])  # rows come in order: the first is the earliest
                place = np.minimum(np.searchsorted(hot[0], names), max(len(hot[0]) - 1, 0))
                met = hot[0][place] == names if len(hot[0]) else np.zeros(len(names), bool)
                if met.any():
                    i, p = at[met], place[met]
                    known[i] |= (doc[i] > hot[1][p]) | ((doc[i] == hot[1][p]) & (spot[i] > hot[2][p]))
                new = (counts > 1) & ~met
                if new.any():
                    hot = [np.concatenate([x, y[new]]) for x, y in zip(hot, (names, doc[at], spot[at]), strict=True)] if len(hot[0]) < HOT else [names[new], doc[at][new], spot[at][new]]
                    order = np.argsort(hot[0])
                    hot = [x[order] for x in hot]
                code = ((hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).tobytes()
                begin = (anchor - lead) * 4
                end = begin + (many + size - 1) * 4
                blobs = [None if k else code[x:y] for k, x, y in zip(known.tolist(), begin.tolist(), end.tolist(), strict=True)]
                key = np.where(known, _spread(doc, spot), key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(spot.astype(np.int32)), pa.array(lead.astype(np.int16)), pa.array(many.astype(np.int16)), pa.array(np.full(len(key), prefix, np.int16)), pa.array(blobs, pa.binary())], schema=_ROW)

    return run


def _extend(size: int, depth: int):
    """Suffixes in; every window as a suffix of its own out, its prefix being ``depth`` words of its rotated string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, doc, spot, lead, many = (batch.column(i).to_numpy() for i in range(5))
            code, to = _codes(batch.column(6))
            index = np.repeat(np.arange(len(doc)), many)
            step = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many)
            offset = lead[index] - step  # of the anchor in the window
            begin = to[index] + step
            name = offset.astype(np.uint64) * (np.uint64(1) if depth == size else (offset > size - depth).astype(np.uint64))
            for i in range(depth):
                place = np.where(i < size - offset, offset + i, size - 1 - i)
                name = name * np.uint64(W.MULTIPLIER) + code[begin + place]
            blobs = [None] * len(index) if depth == size else [code[x : x + size].tobytes() for x in begin.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(W.mix(name + np.uint64(depth)).view(np.int64)), pa.array(doc[index]), pa.array(spot[index]), pa.array(offset.astype(np.int16)), pa.array(np.ones(len(index), np.int16)), pa.array(np.full(len(index), depth, np.int16)), pa.array(blobs, pa.binary())], schema=_ROW)

    return run


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all rows and where each row starts."""
    raw, offsets = W.text_buffer(column)
    return np.frombuffer(raw.tobytes(), np.uint32), offsets[:-1] // 4


def _node_array(columns: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of rows of words below their keys, and for each place the words shared with the place before (-1: another key)."""
    order = np.lexsort((*columns.T[::-1], key))
    same = columns[order[1:]] == columns[order[:-1]]
    shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return order, np.concatenate([[-1], np.where(key[order[1:]] == key[order[:-1]], shared, -1)])


def repeats(key, doc, spot, lead, many, code, to, size: int, prefix: int) -> np.ndarray:
    """For suffixes in order of key, doc and spot: whether the window with the anchor at offset o (columns) repeats an earlier one."""
    n, left_most = len(key), size - prefix
    end = np.concatenate([to[1:], [len(code)]])
    right, left = np.zeros((n, size), np.uint32), np.zeros((n, left_most), np.uint32)
    for i in range(size):
        at = to + lead + i
        right[:, i] = np.where(at < end, code[np.minimum(at, len(code) - 1)], 0)
    for i in range(left_most):
        left[:, i] = np.where(lead > i, code[np.maximum(to + lead - 1 - i, 0)], 0)
    (order_r, shared_r), (order_l, shared_l) = _node_array(right, key), _node_array(left, key)
    out = np.zeros((n, left_most + 1), bool)
    for o in range(left_most + 1):
        active = np.flatnonzero((lead >= o) & (lead - many < o))
        if len(active) < 2:
            continue
        node = np.empty(n, np.int64)
        node[order_r] = np.cumsum(shared_r < size - o) * (n + 1)
        other = np.empty(n, np.int64)
        other[order_l] = np.cumsum(shared_l < o)
        _, first, back = np.unique((node + other)[active], return_index=True, return_inverse=True)
        earliest = active[first][back]
        out[active, o] = (doc[active] != doc[earliest]) | (spot[active] != spot[earliest])
    return out


def _trees(size: int, prefix: int):
    """Suffixes sorted by key, doc and spot in; runs of window starts that occur earlier out."""
    names = ["doc", "start", "many"]

    def build(rows: pa.Table) -> pa.RecordBatch:
        key, doc, spot, lead, many = (rows.column(i).to_numpy().astype(np.int64) for i in range(5))
        code, to = _codes(rows.column(6).combine_chunks())
        found = repeats(key, doc, spot, lead, many, code, to, size, prefix)[:, ::-1]  # in order of the windows' starts
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, up = np.nonzero(edge == 1)
        _, down = np.nonzero(edge == -1)
        start = spot[row] - (size - prefix) + up
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(start), pa.array(down - up)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, stream = [], 0, None  # rows of whole prefixes and of the last one; the earliest suffix of the last prefix of full depth
        for batch in batches:
            settled = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            full = batch.column(5).to_numpy() == size
            if settled.any():
                key, doc, spot, lead, many = (batch.column(i).to_numpy().astype(np.int64)[settled] for i in range(5))
                goes = np.ones(len(key), bool)
                if (whole := full[settled]).any():  # rows of full depth, one window each, in order
                    k, d, s = (x[whole] for x in (key, doc, spot))
                    new = np.concatenate([[stream is None or stream[0] != k[0]], k[1:] != k[:-1]])
                    at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                    first_d, first_s = (np.where(at >= 0, x[at], 0 if stream is None else stream[i]) for i, x in ((1, d), (2, s)))
                    goes[whole] = (d != first_d) | (s != first_s)
                    stream = (k[-1], first_d[-1], first_s[-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[goes]) for x in (doc, spot - lead, many)], names)
            part = batch.filter(pa.array(~settled))
            if not len(part):
                continue
            held.append(part)
            count += len(part)
            if count >= TASK:
                rows = pa.Table.from_batches(held)
                key = rows.column(0).to_numpy()
                stop = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if stop:
                    yield build(rows.slice(0, stop))
                    held = rows.slice(stop).to_batches()
                    count = len(rows) - stop
        if held:
            yield build(pa.Table.from_batches(held))

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            starts, many = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                words = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                kept = words
                if starts[i].is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s, m = starts[i].values.to_numpy(), many[i].values.to_numpy()
                    np.add.at(edge, np.minimum(s, len(words)), 1)
                    np.add.at(edge, np.minimum(s + m + size - 1, len(words)), -1)
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _lists(rows: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """(doc, lists of columns), for a join to the documents; it grows with them, so it is not marked for broadcast."""
    return scratch.keep(rows.groupBy("doc").agg(*(F.collect_list(c).alias(c) for c in columns)))


def remove_repeats(docs: DataFrame, size: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts without the words of repeated passages.

    A window is ``size`` consecutive words (runs outside white space, unchanged).
    Every word of a window whose word sequence also starts earlier (smaller
    doc_id, or the same document further left) goes; windows are judged on the
    input. Returns (doc_id, n_words, n_removed, kept), kept being the other
    words joined by one space. A null text has no words; a text shorter than a
    window loses nothing. A null doc_id comes before all others. Rows that
    repeat a doc_id are one document: a window is never earlier than itself.
    Other columns of the input are not read. Words are compared by 64-bit hashes
    in the prefix and 31-bit codes beyond it.
    """
    prefix = min(PREFIX, size)
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    doc = F.coalesce("doc_id", F.lit(NULL_ID))
    numbered = source.select(doc.alias("doc"), "text")
    prefixes = numbered.mapInArrow(W.tidy(_prefixes(size, prefix)), "key long, doc long, spot int, times int")
    shared = scratch.keep(prefixes.repartition("key").sortWithinPartitions("key").mapInArrow(W.tidy(_repeated), "doc long, spot int, key long"))
    marks = _lists(shared.where("doc is not null").select("doc", "spot"), scratch, "spot")
    suffixes = numbered.join(marks, "doc").select("doc", "text", "spot").mapInArrow(W.tidy(_suffixes(size, prefix)), _ROW_SQL)
    big = scratch.keep(shared.where("doc is null").select("key"))
    depth = prefix
    if depth < size and not big.isEmpty():
        rows, parts = scratch.keep(suffixes), []
        while True:
            depth = min(depth + STEP, size)
            large = sized(big, 16)
            parts.append(rows.join(large, "key", "left_anti").select(*_ROW.names))
            rows = scratch.keep(rows.join(large, "key", "left_semi").select(*_ROW.names).where("words is not null").mapInArrow(W.tidy(_extend(size, depth)), _ROW_SQL))
            big = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"))
            if depth == size or big.isEmpty():
                break
        suffixes = rows
        for part in parts:
            suffixes = suffixes.unionAll(part)
    groups = suffixes.repartition("key").sortWithinPartitions("key", "doc", "spot")
    runs = _lists(scratch.keep(groups.mapInArrow(W.tidy(_trees(size, prefix)), _RUN_SQL)), scratch, "start", "many")
    cuts = source.join(runs, doc == F.col("doc"), "left").select("doc_id", "text", "start", "many")
    return cuts.mapInArrow(W.tidy(_cut(size)), "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).mapInArrow(W.tidy(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")
