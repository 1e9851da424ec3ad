"""The corpus pipeline and its stages against plain Python, on rows with nulls, empties, repeats and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import mixing, quality, secrets, stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, cut int, whole int, source_size int, row string, key string"
KEY = "password = Zx81kQv7Lm20PtRw"


def _rows(seed=5, n=240):
    rng = random.Random(seed)
    good, junk, toxic = ([f"{c}{i}" for i in range(12)] for c in "gjt")
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 0, 0, 1, 2])
        words = [rng.choice((good, junk, toxic)[kind]) for _ in range(rng.choice([60, 90, 150]))]
        if kind == 0 and i % 6 == 0:
            words[30:30] = [KEY]
        if kind == 0 and i % 4 == 1 and rows and rows[-1][1].startswith("g"):
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", "b", "c", None])))
        if i % 2 == 0:
            labels.append((i, int(kind == 0), int(kind == 2)))
    rows += [(n, None, "en", "a"), (n + 1, "", "en", "b"), (None, rows[2][1], "en", "a"), (None, None, None, None)]
    rows += [rows[3], rows[3], (4, "another text of the id " + " ".join(good[::-1] * 4), "de", "c")]
    return [(*r, len(r[1] or ""), "t", 1, 2, 3, "r", "k") for r in rows], labels


def _tables(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _as_rows(df):
    return Counter(tuple(r) for r in df.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).collect())


def _near(rows):
    """What is left when one row of each group of near copies stays."""
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if sets[i]:
            groups[find(i)].append(r)
    return [r for r, s in zip(rows, sets, strict=True) if not s], [g for g in groups.values()]


def test_drop_near_duplicates_equals_brute_force(spark, tmp_path):
    rows, _ = _rows()
    for some in (rows, [r for r in rows[:240]]):  # with and without repeated and null ids
        got = _as_rows(stages.drop_near_duplicates(spark, spark.createDataFrame(some, SCHEMA).repartition(5), ""))
        free, groups = _near(some)
        assert sum(got.values()) == len(free) + len(groups)
        assert not Counter(free) - got
        for g in groups:
            ids = [r[0] for r in g if r[0] is not None]
            stays = [r for r in set(g) if got[r]]
            assert len(stays) == 1 and stays[0][0] == (min(ids) if ids else None)


def test_take_keeps_clashing_columns(spark):
    rows, _ = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in rows:
        want[r] += copies[r[0], len(WORD.findall(r[1] or ""))]
    assert _as_rows(mixing.take(docs)) == +want
    assert mixing.take(docs.limit(0)).count() == 0


def test_targets_by_hand(spark):
    rows, _ = _rows()
    words = Counter()
    for r in rows:
        words[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(words.values()) - sum(3 * words[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * words[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * words[s] if s in full else weight[s] * level for s in order}
    taken = Counter()
    source = {(r[0], len(WORD.findall(r[1] or ""))): r[3] for r in rows}
    for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        s = source[r.doc_id, r.size]
        assert r.target == pytest.approx(target[s]) and r.source_size == words[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 160 for s in order)


def test_run_equals_plain_python(spark, tmp_path):
    rows, labels = _rows()
    sf_dir = _tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages.keep_quality(spark, docs, sf_dir)
    now = list(_as_rows(kept).elements())
    assert not Counter(now) - Counter(rows) and not any((r[1] or "").startswith(("j", "t")) for r in now)
    assert sum((r[1] or "").startswith("g") for r in now) >= 0.97 * sum((r[1] or "").startswith("g") for r in rows)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    free, groups = _near(now)
    one = free + [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    novelty, clean = secrets.Novelty(), []
    for r in one:
        text = r[1]
        for a, _, b in sorted(secrets.base_spans(text or "") + secrets.novel_spans(text or "", secrets.base_spans(text or ""), novelty), reverse=True):
            text = text[:a] + "[secret]" + text[b:]
        clean.append((r[0], text))
    assert any("[secret]" in (t or "") for _, t in clean) and not any(KEY in (t or "") for _, t in clean)
    import public_tokenizers
    import tiktoken

    from loomline.llm.bpe import load_ranks

    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = {(i, tuple(enc.encode_ordinary(t or ""))) for i, t in clean}
    assert {(r.doc_id, tuple(r.ids)) for r in out} <= ids and all(r.exact and r.n_tokens == len(r.ids) for r in out)
    times = Counter((r.doc_id, tuple(r.ids)) for r in out)
    assert max(times.values()) <= 3 and len(out) > len(clean) / 2


def test_stages_of_an_empty_table(spark, tmp_path):
    sf_dir = _tables(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
