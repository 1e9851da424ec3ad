"""N-gram Jaccard join by parity sketches.

Every distinct shingle of a document flips one bit of one block of a sketch (a
block has 2**64 virtual bits and is kept as the XOR of the codes of its flipped
bits). A shingle touches one block only, so the number of blocks in which two
sketches differ is at most the Hamming distance of the sketches, which is at
most the symmetric difference of the sets. Jaccard >= t bounds that difference
by d; a sketch of a size band has d + 1 + e blocks, so two linked documents
agree in at least 1 + e blocks. Blocks without shingles are not joined on: if
one of the two has at most e of these, a filled block agrees. Documents with
more than e empty blocks also emit a sketch under the next seed, and so on,
until one has at most e: no pair is lost and no bucket is capped.

Equal sets are one class from the start; a task emits the blocks of a class once.
Classes that agree in a block are chained where the Hamming distance of a second sketch of SKETCH_BITS plain bits,
again a lower bound, allows a link; connected chains are families of similar
documents. Families are compared exactly (set sizes and intersections), in
memory-bounded tasks. A family larger than a task is first sketched again under
other seeds, which separates documents that were chained by a shared passage
only; what is still too large is split into chunks. Chunks are compared with a few
members first; only members that those don't join to the largest component are
compared with all chunks. Inside a task a class that has been reached is
compared no further, so a family of copies costs about one pass, and only a
spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, components, sized, table

TASK_CLASSES = 1200
TASK_BYTES = 12 << 20
BAND = 1.6
SKETCH_BITS = 2048
RESEEDS = 1
PIVOTS = 4  # members that all chunks of a large family are compared with first
SEEN = 200_000  # signatures that a task remembers


@lru_cache(maxsize=65536)
def band_of(n: int) -> int:
    """Number of the size band of n; bands start at 1 and grow by BAND."""
    k = 0
    while band_start(k + 1) <= n:
        k += 1
    return k


@lru_cache(maxsize=None)
def band_start(k: int) -> int:
    return 1 if k <= 0 else max(band_start(k - 1) + 1, int(band_start(k - 1) * BAND))


@lru_cache(maxsize=None)
def blocks_of(k: int, percent: int) -> tuple[int, int]:
    """(blocks, spare blocks e) of the sketch that documents of band k compare by."""
    low, high = band_start(k), band_start(k + 1) - 1
    most = 2 * high * (100 - percent) // (100 + percent)
    spare = 0
    if most:
        for _ in range(20):
            mean = (most + 1 + spare) * np.exp(-low * percent / 100 / (most + 1 + spare))
            spare = int(mean + np.sqrt(mean) + 0.5)
    return most + 1 + spare, spare


def sketch_keys(values: np.ndarray, percent: int, seed_from: int = 0) -> np.ndarray:
    """Join keys of a set of shingle hashes: one for each filled block, for its own band and, if a partner there can be large enough, the next."""
    n, out = len(values), []
    own = band_of(n)
    bands = [own, own + 1] if 100 * n >= percent * band_start(own + 1) else [own]
    for k in bands:
        count, spare = blocks_of(k, percent)
        seed = seed_from
        while True:
            h = W.mix(values ^ np.uint64((0x5851F42D4C957F2D * (seed * 4096 + k + 1)) & (2**64 - 1)))
            # the high half picks the block, the mixed whole is the bit's code
            block = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            filled, first = np.unique(block[order], return_index=True)
            code = np.bitwise_xor.reduceat(W.mix(h)[order], first)
            out.append(W.mix(code ^ W.mix((filled + 1).astype(np.uint64) + np.uint64((k << 40) + (seed << 56)))))
            if count - len(filled) <= spare or n < 2:
                break
            seed += 1
    return np.concatenate(out)


def _sets(batch_text: pa.Array, size: int) -> Iterator[np.ndarray]:
    for a, b, raw, offsets in W.pieces(batch_text):
        _, _, hashes, first = W.word_hashes(raw, offsets, lower=True)
        values, to = W.shingles(hashes, first, size)
        for i in range(b - a):
            yield np.unique(values[to[i] : to[i + 1]])


def _signature(values: np.ndarray) -> tuple[int, int]:
    one = W.mix(values + np.uint64(0x1234567))
    total = np.array([one.sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)
    return int(W.mix(total).astype(np.int64)[0]), int(np.bitwise_xor.reduce(W.mix(one)).astype(np.int64)) if len(values) else 0


def parity(values: np.ndarray) -> bytes:
    """A sketch; every shingle flips one bit. It has SKETCH_BITS bits, and more for larger sets: a full one would tell nothing."""
    size = max(SKETCH_BITS, 1 << (len(values) - 1).bit_length())
    bits = (W.mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of fewer bytes of the same set: bits that a shorter sketch doesn't tell apart are added up."""
    out = np.frombuffer(sketch, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _near(percent: int):
    """Rows (key, node, n, sketch) in runs of one key in; edges that join the nodes of a bucket whose sketches allow a link out."""

    def far(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        both = n[i] + n[j]
        return (apart * (100 + percent) > both * (100 - percent)) | (np.minimum(n[i], n[j]) * 100 < percent * np.maximum(n[i], n[j]))

    def settle(rows: pa.Table) -> pa.RecordBatch:
        keys, nodes, n = (rows.column(i).to_numpy() for i in range(3))
        blobs = rows.column(3).to_pylist()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.minimum.reduceat(np.array([len(b) for b in blobs]), at)  # of a bucket; its sets are of one size band
        of_row = np.repeat(least, np.diff(np.concatenate([at, [len(keys)]])))
        out = []
        for size in np.unique(least).tolist():
            some = np.flatnonzero(of_row == size)
            out.append(joined(keys[some], nodes[some], n[some], np.stack([folded(blobs[i], size) for i in some.tolist()])))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def joined(keys: np.ndarray, nodes: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([at, [len(keys)]]))
        two = at[sizes == 2]
        two = two[~far(two, two + 1, n, sketch)]
        a, b = [nodes[two]], [nodes[two + 1]]
        for start, size in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            rest = np.arange(start, start + size)
            while len(rest):
                queue, rest = [int(rest[0])], rest[1:]
                root = nodes[queue[0]]
                while queue and len(rest):
                    i = queue.pop()
                    hit = ~far(np.full(len(rest), i), rest, n, sketch)
                    if hit.any():
                        found, rest = rest[hit], rest[~hit]
                        queue += found.tolist()
                        a.append(np.full(len(found), root))
                        b.append(nodes[found])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            stop = int(np.searchsorted(keys, keys[-1]))
            if held and (stop or held[-1].column(0)[0].as_py() != keys[0]):
                yield settle(pa.Table.from_batches([*held, batch.slice(0, stop)]))
                held = []
            elif stop:
                yield settle(pa.Table.from_batches([batch.slice(0, stop)]))
            held.append(batch.slice(stop))
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _profile(size: int, percent: int):
    """Sets by size and signature; join keys and a sketch for the first document of a signature in a task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            n, sig, sig2, keys, sketches = [], [], [], [], []
            for values in _sets(batch.column(1), size):
                n.append(len(values))
                s = _signature(values)
                sig.append(s[0])
                sig2.append(s[1])
                again = not len(values) or s[0] in done
                if len(done) > SEEN:  # copies that come again later cost rows, no result
                    done.clear()
                done.add(s[0])
                sketches.append(None if again else parity(values))
                keys.append(np.zeros(0, np.int64) if again else sketch_keys(values, percent).view(np.int64))
            to = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(sig2, pa.int64()), pa.ListArray.from_arrays(pa.array(to), pa.array(flat)), pa.array(sketches, pa.binary())], ["doc_id", "n", "sig", "sig2", "keys", "sketch"])

    return run


def _fetch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, blobs, sizes, sketches = [], [], [], []
            want = batch.column(2).to_pylist()
            for i, values in enumerate(_sets(batch.column(1), size)):
                if _signature(values)[0] == want[i]:
                    keep.append(i)
                    blobs.append(values.tobytes())
                    sizes.append(len(values))
                    sketches.append(parity(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "n", "sketch", "values"])

    return run


def link_groups(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the smallest id that it reaches by links. Exact: a set is compared with every set not yet reached."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    to = np.concatenate([[0], np.cumsum(sizes)])
    rows = [flat[to[i] : to[i + 1]] for i in range(count)]
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    rest, root = np.arange(count), [0] * count
    while len(rest):
        queue, rest, group = [int(rest[0])], rest[1:], []
        while queue:
            i = queue.pop()
            group.append(i)
            n = sizes[i]
            fit = (sizes[rest] * 100 >= percent * n) & (n * 100 >= percent * sizes[rest])
            near = rest[fit]
            if not len(near):
                continue
            mark[rows[i]] = 1
            shared = np.add.reduceat(mark[np.concatenate([rows[j] for j in near])], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[rows[i]] = 0
            hit = 100 * shared >= percent * (n + sizes[near] - shared)
            if hit.any():
                queue += near[hit].tolist()
                gone = np.zeros(count, bool)
                gone[near[hit]] = True
                rest = rest[~gone[rest]]
        low = min(ids[i] for i in group)
        for i in group:
            root[i] = low
    return root


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        first = {d: v for d, v in zip(group.column("doc_id").to_pylist(), group.column("values").to_pylist(), strict=True)}
        ids = sorted(first)
        root = link_groups(ids, [np.frombuffer(first[d], np.uint64) for d in ids], percent)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(root, pa.int64())})

    return run


def _rekey(percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch_keys(np.frombuffer(v, np.uint64), percent, seed * 16) for v in batch.column(2).to_pylist()]
            to = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(to), pa.array(flat))], ["doc_id", "family", "keys"])

    return run


def _chains(rows: DataFrame, bucket: list[str], node: str, sketches: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between nodes that share a bucket and whose parity sketches are near enough for a link, or that a chain of such pairs connects.

    Buckets that hold the same nodes (near copies agree in many blocks) become
    one, named by count, least node and XOR of hashes, before sketches are joined.
    """
    order, whole = Window.partitionBy(*bucket).orderBy(node), Window.partitionBy(*bucket)
    once = rows.withColumn("before", F.lag(node).over(order)).where(F.col("before").isNull() | (F.col("before") != F.col(node)))
    met = once.withColumns({"many": F.count("*").over(whole), "least": F.min(node).over(whole), "mark": F.bit_xor(F.xxhash64(F.col(node))).over(whole)}).where("many > 1")
    shared = scratch.keep(met.select(F.xxhash64("many", "least", "mark").alias("key"), F.col(node).alias("node")).distinct())
    full = shared.join(sketches, "node").select("key", "node", "n", "sketch")
    near = full.repartition("key").sortWithinPartitions("key", "node").mapInArrow(W.tidy(_near(percent)), "a long, b long")
    out = scratch.keep(near.distinct())
    scratch.drop(shared)
    return out


def _chunks(many: str, size: str):
    """Tasks that so many sets of so many bytes are dealt to."""
    return F.greatest(F.lit(1), F.ceil(F.col(many) / TASK_CLASSES), F.ceil(F.col(size) / TASK_BYTES)).cast("int")


def _linked(plan: DataFrame, held: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join the linked members of each family; plan: (doc_id, family, bytes), held: (doc_id, values).

    A family larger than a task is cut into chunks. Every chunk is compared in
    itself and with PIVOTS members of the family, which joins copies into one
    component, the core. Only the members outside the core are then compared with
    all chunks: two members of the core need no further comparison.
    """
    sizes = plan.groupBy("family").agg(F.count("*").alias("many"), F.sum("bytes").alias("all")).where("many > 1")
    placed = plan.join(sizes.select("family", _chunks("many", "all").alias("chunks")), "family")
    placed = scratch.keep(placed.select("doc_id", "family", "bytes", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("part")))

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = scratch.keep(dealt.distinct())
        tasks = held.join(sized(dealt, 32), "doc_id").select("family", "i", "j", "doc_id", "values")
        return scratch.keep(tasks.groupBy("family", "i", "j").applyInArrow(_compare(percent), "a long, b long"))

    cut = placed.where("chunks > 1")
    pivots = cut.groupBy("family", "chunks").agg(F.array(*(F.min_by("doc_id", F.xxhash64(F.lit(seed), "doc_id")) for seed in range(PIVOTS))).alias("ids"))
    pivots = pivots.select(F.explode("ids").alias("doc_id"), "family", "chunks").select("doc_id", "family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(0).alias("j"))
    edges = compare(placed.select("doc_id", "family", F.col("part").alias("i"), F.lit(0).alias("j")).unionAll(pivots))
    if cut.isEmpty():
        return edges
    whole = components(edges.where("a <> b"), scratch)
    rooted = scratch.keep(cut.join(whole, cut["doc_id"] == whole["node"], "left").select("doc_id", "family", "bytes", "chunks", "part", F.coalesce("root", "doc_id").alias("root")))
    core = rooted.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("core"))
    rooted = rooted.join(core, "family").withColumn("inside", F.col("root") == F.col("core"))
    many = rooted.where("not inside").groupBy("family").agg(F.count("*").alias("many"), F.sum("bytes").alias("all")).select("family", _chunks("many", "all").alias("sides"))
    side = F.pmod(F.xxhash64(F.lit(PIVOTS), "doc_id"), F.col("sides")).cast("int")
    upto = lambda column: F.sequence(F.lit(0), F.col(column) - 1)
    # chunks outside the core meet each other (i <= j) and those of the core (j from sides on)
    outside = F.concat(F.transform(upto("sides"), lambda x: F.struct(F.least(side, x).alias("i"), F.greatest(side, x).alias("j"))), F.transform(upto("chunks"), lambda x: F.struct(side.alias("i"), (F.col("sides") + x).alias("j"))))
    inside = F.transform(upto("sides"), lambda x: F.struct(x.alias("i"), (F.col("sides") + F.col("part")).alias("j")))
    dealt = rooted.join(many, "family").select("doc_id", "family", F.explode(F.when(F.col("inside"), inside).otherwise(outside)).alias("at"))
    return edges.unionAll(compare(dealt.select("doc_id", "family", "at.i", "at.j")))


def jaccard_join(docs: DataFrame, percent: int = 85, size: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents linked by the Jaccard similarity of their word shingles.

    Two documents link if 100 * intersection >= percent * union of their sets of
    ``size``-word shingles (A-Z lower-cased). Returns (doc_id, n_shingles,
    component_id), one row for each input row; component_id is the smallest
    doc_id reachable. Null, empty and blank texts have no shingles, link with
    nothing and are their own component. Texts of fewer words are one shingle.
    Repeated rows give repeated results; a null doc_id is a document that takes
    the component of its copies and is never a component itself. Other columns
    of the input are not read. Sets are compared by 64-bit hashes of shingles.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    seen = scratch.keep(source.mapInArrow(W.tidy(_profile(size, percent)), "doc_id long, n long, sig long, sig2 long, keys array<long>, sketch binary"))

    blocks = seen.select("sig", F.explode("keys").alias("key"))
    sketches = seen.where("sketch is not null").groupBy(F.col("sig").alias("node")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    chains = _chains(blocks, ["key"], "sig", sketches, percent, scratch)
    profile = scratch.keep(seen.select("doc_id", "n", "sig", "sig2"))
    scratch.drop(seen)
    classes = profile.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    family = scratch.keep(components(chains, scratch).withColumnRenamed("node", "sig").withColumnRenamed("root", "family"))

    # classes of families, the sets of which are read again from the texts
    member = scratch.keep(family.join(classes, "sig").where("rep is not null").select("sig", "family", "rep", "n"))
    wanted = member.select(F.col("rep").alias("doc_id"), "sig")
    texts = source.join(sized(wanted, 16), "doc_id").select("doc_id", "text", "sig")
    held = scratch.keep(texts.mapInArrow(W.tidy(_fetch(size)), "doc_id long, n long, sketch binary, values binary"))
    marks = held.groupBy(F.col("doc_id").alias("node")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    plan = member.select(F.col("rep").alias("doc_id"), "family", (F.col("n") * 8).alias("bytes"))
    for seed in range(1, RESEEDS + 1):
        large = scratch.keep(plan.groupBy("family").agg(F.count("*").alias("many"), F.sum("bytes").alias("bytes")).where((F.col("many") > TASK_CLASSES) | (F.col("bytes") > TASK_BYTES)).select("family"))
        if large.isEmpty():
            break
        inside = scratch.keep(plan.join(sized(large, 8), "family"))
        keys = held.join(sized(inside, 24), "doc_id").select("doc_id", "family", "values").mapInArrow(W.tidy(_rekey(percent, seed)), "doc_id long, family long, keys array<long>")
        rows = keys.select("doc_id", "family", F.explode("keys").alias("key"))
        again = _chains(rows, ["family", "key"], "doc_id", marks, percent, scratch)
        split = components(again, scratch)
        inner = inside.join(split, inside.doc_id == split.node).select("doc_id", F.xxhash64("family", "root").alias("family"), "bytes")
        plan = scratch.keep(plan.join(sized(large, 8), "family", "left_anti").select("doc_id", "family", "bytes").unionByName(inner))
    edges = _linked(plan, held, percent, scratch)
    whole = components(edges.where("a <> b"), scratch).select(F.col("node").alias("rep"), F.col("root").alias("low"))

    # classes with more than one document or a link; the others are their own component
    of_class = classes.where("copies > 1").select("sig", "sig2", F.col("n").alias("size"), "rep")
    of_class = of_class.unionByName(member.join(classes.where("copies = 1"), ["sig", "rep", "n"]).select("sig", "sig2", F.col("n").alias("size"), "rep"))
    of_class = scratch.keep(of_class.join(whole, "rep", "left").select("sig", "sig2", "size", F.coalesce("low", "rep").alias("low")))
    return profile.join(of_class, (profile.sig == of_class.sig) & (profile.sig2 == of_class.sig2) & (profile.n == of_class["size"]), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
