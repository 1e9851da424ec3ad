"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a pre-token are a linked list. A queue has one bucket for each merge
rank, holding the list positions whose pair has that rank; a two-level bitmap
over the ranks gives the next rank by find-first-set. A popped position is stale
if its pair has changed since, and is skipped. Every merge costs a constant
number of queue operations, so a very long pre-token takes time in proportion
to its length (but for the order inside one bucket).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded, table
from .words import tidy

HELD = 64 << 20  # estimated bytes of chunks that a worker remembers
PART = 2 << 20  # characters that are cut and merged together; longer texts are cut into parts at a space
LONG = 256  # bytes; longer pre-tokens have a queue of their own


class RankQueue:
    """Positions by merge rank; pop gives the smallest rank, leftmost position first."""

    __slots__ = ("buckets", "high", "low")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.high = 0  # bit w: word w of the bitmap is not zero
        self.low: dict[int, int] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 255)
        self.high |= 1 << word

    def fill(self, rank_at: list[int]) -> None:
        for position, rank in enumerate(rank_at):
            if rank >= 0:
                self.buckets.setdefault(rank, []).append(position)
        for rank in self.buckets:
            word = rank >> 8
            self.low[word] = self.low.get(word, 0) | 1 << (rank & 255)
            self.high |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        if not self.high:
            return None
        word = (self.high & -self.high).bit_length() - 1
        bits = self.low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            bits &= bits - 1
            self.low[word] = bits
            if not bits:
                self.high &= self.high - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of the lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts here; 0: no token starts here
    before = list(range(-1, n - 1))
    pair = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    queue = RankQueue()
    queue.fill(pair)
    while (item := queue.pop()) is not None:
        rank, i = item
        if pair[i] != rank or not end[i]:
            continue
        gone = end[i]
        stop = end[gone]
        end[i], end[gone], pair[gone] = stop, 0, -1
        if stop < n:
            before[stop] = i
            new = ranks.get(piece[i : end[stop]], -1)
        else:
            new = -1
        pair[i] = new
        if new >= 0:
            queue.push(new, i)
        left = before[i]
        if left >= 0:
            new = ranks.get(piece[left:stop], -1)
            if new != pair[left]:
                pair[left] = new
                if new >= 0:
                    queue.push(new, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """Rank of the token that two neighbouring tokens make, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.keys = np.array([*np.array(keys, np.int64)[order], np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([*np.array(merged, np.int64)[order], -1], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], table: PairTable) -> Ragged:
    """merge() of many short pre-tokens in one queue: their linked lists lie side by side and one pop serves every pre-token whose next rank it is."""
    whole = [ranks.get(p) for p in pieces]
    places = [i for i, r in enumerate(whole) if r is None and pieces[i]]
    if len(places) < len(pieces):
        rest = merge_all([pieces[i] for i in places], ranks, table) if places else Ragged([], np.int64)
        start, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[places], count[places] = rest.start, rest.count
        ready = [i for i, r in enumerate(whole) if r is not None]
        start[ready], count[ready] = len(rest.flat) + np.arange(len(ready)), 1
        out = Ragged.of(np.concatenate([rest.flat, np.array([whole[i] for i in ready], np.int64)]), count)
        out.start = start
        return out
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    token = of_byte[raw]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    first = np.cumsum(sizes) - sizes
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    after[first + sizes - 1] = -1
    before[first] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, -1, np.int64)
    linked = np.flatnonzero(after >= 0)
    pair[linked] = table.rank(token[linked], token[linked + 1])
    buckets: dict[int, list[np.ndarray]] = {}
    high, low = 0, {}

    def push(found: np.ndarray, positions: np.ndarray) -> None:
        nonlocal high
        order = np.argsort(found, kind="stable")
        found, positions = found[order], positions[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(found[starts].tolist(), starts, [*starts[1:], len(found)], strict=True):
            bucket = buckets.get(rank)
            if bucket:
                bucket.append(positions[a:b])
                continue
            buckets[rank] = [positions[a:b]]
            word = rank >> 8
            low[word] = low.get(word, 0) | 1 << (rank & 255)
            high |= 1 << word

    ready = np.flatnonzero(pair >= 0)
    if len(ready):
        push(pair[ready], ready)
    while high:
        word = (high & -high).bit_length() - 1
        bits = low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        low[word] = bits
        if not bits:
            high &= high - 1
        parts = buckets.pop(rank)
        i = parts[0] if len(parts) == 1 else np.concatenate(parts)
        i = i[pair[i] == rank]  # the others are stale
        if not len(i):
            continue
        if len(i) > 1:
            i = np.sort(i)
            i = i[np.concatenate([[True], i[1:] != i[:-1]])]
            own = owner[i]
            again = np.concatenate([[False], own[1:] == own[:-1]])
            if again.any():  # of one pre-token the leftmost comes first, and what it makes may come before the next
                push(np.full(int(again.sum()), rank), i[again])
                i = i[~again]
        j = after[i]
        k = after[j]
        token[i] = rank
        after[i] = k
        alive[j] = False
        pair[j] = -1
        right = k >= 0
        before[k[right]] = i[right]
        new = np.full(len(i), -1, np.int64)
        new[right] = table.rank(token[i[right]], token[k[right]])
        pair[i] = new
        h = before[i]
        left = h >= 0
        h = h[left]
        side = table.rank(token[h], token[i[left]])
        pair[h] = side
        made, places = np.concatenate([new, side]), np.concatenate([i, h])
        real = made >= 0
        if real.any():
            push(made[real], places[real])
    return Ragged.of(token[alive], np.bincount(owner[alive], minlength=len(pieces)))


class Ragged:
    """Rows of unequal length in one flat array; take() lines up the chosen rows."""

    def __init__(self, rows: list, kind):
        self.count = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.fromiter(chain.from_iterable(rows), kind, int(self.count.sum()))

    @classmethod
    def of(cls, flat: np.ndarray, count: np.ndarray) -> Ragged:
        out = cls([], flat.dtype)
        out.flat, out.count, out.start = flat, count.astype(np.int64), np.cumsum(count) - count
        return out

    def add(self, new: Ragged) -> None:
        self.start = np.concatenate([self.start, new.start + len(self.flat)])
        self.count = np.concatenate([self.count, new.count])
        self.flat = np.concatenate([self.flat, new.flat])

    def take(self, at: np.ndarray) -> np.ndarray:
        count = self.count[at]
        to = np.cumsum(count)
        total = int(to[-1]) if len(to) else 0
        return self.flat[np.repeat(self.start[at] - (to - count), count) + np.arange(total)]


class Codec:
    """Encoder and decoder of one vocabulary.

    A single space between two characters that are not white space always starts
    a pre-token (PATTERN has a space only in front of a token or inside a run of
    white space), so texts are cut there into chunks. Chunks get local numbers;
    only new chunks are split by the pattern, and all new pre-tokens of about PART
    characters are merged together. Texts with other spacing are split whole.
    What is remembered is bounded in bytes (HELD) and dropped when a task ends.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.mixed = regex.compile(r" \s|\s ").search
        self.gap = regex.compile(r"\S(?= \S)").search
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.bytes_of = Ragged(by_id, np.uint8)
        self.text_of = Ragged([b"%d," % i for i in range(size)], np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drops all chunks; their numbers start anew."""
        fresh: list[str] = []  # those without ids as yet
        numbers = count()

        class Spaced(dict):
            def __missing__(self, chunk: str) -> int:
                self[chunk] = number = next(numbers)
                fresh.append(" " + chunk)
                return number

        class Plain(dict):
            def __missing__(self, chunk: str) -> int:
                self[chunk] = number = next(numbers)
                fresh.append(chunk)
                return number

        self.fresh, self.spaced, self.plain, self.held = fresh, Spaced(), Plain(), 0
        self.ids_of = Ragged([], np.int32)

    def _learn(self) -> None:
        """Ids of the chunks that came since the last call."""
        if not self.fresh:
            return
        pieces: dict[str, int] = {}
        new = Ragged([array("q", [pieces.setdefault(p, len(pieces)) for p in self.split(c)]) for c in self.fresh], np.int64)
        raw = [p.encode() for p in pieces]
        short = merge_all([p if len(p) <= LONG else b"" for p in raw], self.ranks, self.table)
        long = [i for i, p in enumerate(raw) if len(p) > LONG]
        if long:  # each has a queue of its own
            own = Ragged([[self.ranks[p]] if p in self.ranks else merge(p, self.ranks) for p in (raw[i] for i in long)], np.int64)
            short.start[long], short.count[long] = own.start + len(short.flat), own.count
            short.flat = np.concatenate([short.flat, own.flat])
        sums = np.concatenate([[0], np.cumsum(short.count[new.flat])])
        to = np.concatenate([[0], np.cumsum(new.count)])
        self.ids_of.add(Ragged.of(short.take(new.flat).astype(np.int32), sums[to[1:]] - sums[to[:-1]]))
        self.held += sum(map(len, self.fresh)) + 250 * len(self.fresh)
        self.fresh.clear()

    def _parts(self, texts: Iterable[str]) -> Iterator[tuple[str, bool]]:
        """(part, last of its text); a part ends before a space between two characters that are not white space."""
        for text in texts:
            at = 0
            while len(text) - at > PART and (m := self.gap(text, at + PART)):
                yield text[at : m.start() + 1], False
                at = m.start() + 1
            yield (text[at:] if at else text), True

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Token ids of each text; texts of PART characters together are cut first, then their new pre-tokens are merged in one queue."""
        rows, size, before = [], 0, []

        def settle() -> Iterator[np.ndarray]:
            self._learn()
            for row, last in rows:
                ids = self.ids_of.take(np.frombuffer(row, np.int64) if row else np.zeros(0, np.int64))
                if last:
                    yield np.concatenate([*before, ids]) if before else ids
                    before.clear()
                else:
                    before.append(ids)
            rows.clear()
            if self.held > HELD:
                self.forget()

        for text, last in self._parts(texts):
            if self.mixed(text):
                row = array("q", map(self.plain.__getitem__, self.split(text)))
            else:
                head, *rest = text.split(" ")
                row = array("q", map(self.spaced.__getitem__, rest))
                if head:
                    row.insert(0, self.plain[head])
            rows.append((row, last))
            size += len(text)
            if size >= PART:
                yield from settle()
                size = 0
        yield from settle()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return self.bytes_of.take(np.asarray(ids, np.int64)).tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str, shared=None) -> Codec:
    """One codec for each vocabulary and Python worker; ``shared`` is read only if there is none yet."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path) if shared is None else shared.value, pattern)
    return _CODECS[path, pattern]


def _run(path: str, pattern: str, shared, make: Callable[[Codec, np.ndarray, pa.Scalar], tuple], fields: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, shared)
        try:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                encoded = codec.encode_all(x.as_py() or "" for x in texts)
                rows = [make(codec, ids, text) for ids, text in zip(encoded, texts, strict=True)]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *(f"v{i}" for i in range(len(fields)))])
        finally:
            codec.forget()  # the next task, perhaps of another operator, gets the memory

    return run


def _ids(codec: Codec, ids: np.ndarray, text: pa.Scalar) -> tuple:
    return (ids.astype(np.int32),)


def _checked(codec: Codec, ids: np.ndarray, text: pa.Scalar) -> tuple:
    return len(ids), ids.astype(np.int32), codec.decode(ids) == (text.as_buffer().to_pybytes() if text.is_valid else b"")


def _round_trip(codec: Codec, ids: np.ndarray, text: pa.Scalar) -> tuple:
    listed = codec.text_of.take(ids)[:-1]
    return len(ids), hashlib.sha256(listed.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text, without special tokens.

    ``path`` is a file of base64 tokens and ranks, ``pattern`` splits a text into
    pre-tokens. The vocabulary (of fixed size) is read by the driver and sent to
    the executors once. A null or empty text has no ids. Every row is encoded by
    itself: repeated rows repeat, other columns are not read.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(tidy(_run(path, pattern, shared, _ids, [pa.list_(pa.int32())])), f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))
    source = tokens.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, shared)
        for batch in batches:
            texts = [codec.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(tidy(run), f"doc_id {source.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Nulls, empty and very long texts, repeated rows and other columns: as for encode().
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(_run(path, pattern, shared, _round_trip, [pa.int64(), pa.string(), pa.string()])), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids and whether they decode to the text.

    A null or empty text has no ids and is exact; a null doc_id stays null. Very
    long texts are encoded part by part, which changes no id; repeated rows
    repeat, other columns are not read.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(_run(path, pattern, shared, _checked, [pa.int64(), pa.list_(pa.int32()), pa.bool_()])), f"doc_id {kind}, n_tokens long, ids array<int>, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
