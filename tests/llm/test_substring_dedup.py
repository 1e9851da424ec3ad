"""Substring dedup against brute force: hot passages, extended prefixes, many steps of a task."""

import random
import re

import pytest

from loomline.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    first, lost = {}, {}
    ordered = sorted({(-(1 << 63) if i is None else i, t) for i, t in rows}, key=lambda r: r[0])
    for i, text in ordered:
        w = WORD.findall(text or "")
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, text in ordered:
        w = WORD.findall(text or "")
        gone = lost.setdefault((i, text), [False] * len(w))
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] != (i, s):
                gone[s : s + size] = [True] * size
    out = []
    for i, text in rows:
        w, gone = WORD.findall(text or ""), lost[-(1 << 63) if i is None else i, text]
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def corpus(seed, n=240):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]  # few words: prefixes are shared, with many contexts
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([5, 19, 20, 45, 120]))]
        if i % 3 == 0:  # a third of all documents hold one passage, whole or from somewhere to somewhere
            a = rng.choice([0, 0, rng.randrange(50)])
            t[len(t) // 2 : len(t) // 2] = passage[a : rng.choice([70, rng.randrange(a, 71)])]
        if i % 5 == 0 and rows:
            t = WORD.findall(rows[rng.randrange(len(rows))][1]) + t
        if i % 7 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = "x"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a " * 100), (None, rows[3][1]), (7, rows[7][1]), (n + 3, "b" * 100_000 + " " + rows[8][1])]


@pytest.mark.parametrize("group,task,runs", [(50_000, 16_384, 400_000), (20, 64, 50), (3, 16_384, 400_000), (0, 8, 400_000)])
def test_equals_brute_force(spark, monkeypatch, group, task, runs):
    for name, value in (("GROUP", group), ("TASK", task), ("RUNS", runs)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = corpus(group + 1)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spot string").repartition(7)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=repr)
    assert got == brute(rows)


def test_long_texts_and_nothing(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    rows = [(2, long), (1, long), (3, "q " + long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    half = len((long[: len(long) // 2]).split())
    assert got[1] == (200_000, 0) and got[2] == (200_000, 200_000) and got[3][0] == half + 1 and got[3][1] in (half, half - 1)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
