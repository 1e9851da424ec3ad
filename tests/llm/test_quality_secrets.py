"""Quality classifier against a plain form of importance resampling; secret scans against plain patterns and planted secrets."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import quality, secrets
from loomline.llm import words as W


def _grams(text):
    raw, offsets = W.text_buffer(__import__("pyarrow").array([text]))
    one, _, two, _ = quality.ngrams(raw, offsets)
    return one.tolist(), two.tolist()


def _corpus(seed=3, n=400):
    rng = random.Random(seed)
    kinds = {0: [f"g{i}" for i in range(15)], 1: [f"j{i}" for i in range(15)], 2: [f"t{i}" for i in range(15)]}
    rows = []
    for i in range(n):
        kind = rng.choice([0, 0, 1, 2])
        rows.append((i, " ".join(rng.choice(kinds[rng.choices([kind, 0], [5, 1])[0]]) for _ in range(rng.choice([5, 30, 80]))), kind))
    return rows


def test_classifier_equals_plain_importance_resampling(spark):
    rows = _corpus()
    texts = rows + [(400, None, None), (401, "", None), rows[7], rows[7], (None, rows[9][1], None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in texts], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, int(k == 0), int(k == 2)) for i, _, k in rows[:300]], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()

    # the models: counts of words and word pairs of half of the labelled texts, and of words of all texts
    held = {r.doc_id: r.h == 0 for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(2)).alias("h")).collect()}
    of_kind = {k: (Counter(), Counter()) for k in range(3)}
    corpus = Counter()
    for i, t, _ in texts:
        one, two = _grams(t or "")
        corpus.update(one)
        if i is not None and i < 300 and not held[i]:
            kind = rows[i][2]
            of_kind[kind][0].update(one)
            of_kind[kind][1].update(two)

    def ratio(target, raw, x, smooth, least, one_sided):
        size = min(target.total(), raw.total())
        value = math.log((target[x] * size / target.total() + smooth) / (raw[x] * size / raw.total() + smooth))
        value = value if abs(value) >= least else 0.0
        return min(value, 0.0) if one_sided else value

    def sums(t):
        one, two = _grams(t or "")
        return [sum(ratio(of_kind[0][0], corpus, x, 1, 3, True) for x in one), sum(ratio(of_kind[0][0], of_kind[2][0], x, 1, 3, True) for x in one), sum(ratio(of_kind[0][1], of_kind[1][1], x, 8, 0.7, False) for x in two)]

    calibration = [sums(t) for i, t, k in texts if i is not None and i < 300 and held[i] and rows[i][2] == 0]
    floors = [np.quantile([c[j] for c in calibration], quality.CLEAN_LOSS, method="lower") for j in range(3)]
    weight = {(i, t): min(s - f for s, f in zip(sums(t), floors, strict=True)) for i, t, _ in texts}
    noise = {r.doc_id: r.u for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), 7).alias("u")).collect()}
    keys = sorted((weight[i, t] / quality.TEMPERATURE + noise[i] for i, t, _ in texts), reverse=True)
    k = sum(weight[i, t] >= 0 for i, t, _ in texts)
    want = Counter((i, round(weight[i, t], 3), weight[i, t] / quality.TEMPERATURE + noise[i] >= keys[k - 1] - 0.5 / quality.SCALE) for i, t, _ in texts)
    assert Counter((r.doc_id, round(r.log_weight, 3), r.kept) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert np.mean([i in kept for i, _, kind in rows if kind == 0]) > 0.95
    assert quality.keep(docs, quality.fit(docs, labels)).columns == docs.columns


def test_gumbel_noise_has_its_distribution(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"), 3)).collect()])
    assert abs(u.mean() - 0.5772) < 0.03 and abs(u.std() - math.pi / math.sqrt(6)) < 0.03


def test_fit_without_labels_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(docs, model).where("kept").count() == 2


ALPHABET = string.ascii_letters + string.digits + "+/_.=-"


def _secret_texts(seed=4):
    rng = random.Random(seed)
    value = lambda n, of=ALPHABET: "".join(rng.choice(of) for _ in range(n))
    texts = [None, "", "no secrets here"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 8)):
            parts.append(rng.choice([
                lambda: rng.choice(["password", "PassWd", "api_key", "APIKEY", "Token", "secret"]) + rng.choice(["", '"', "'"]) + rng.choice(["", " ", "  "]) + rng.choice(":=") + rng.choice(["", " "]) + rng.choice(["", '"']) + value(rng.choice([5, 11, 12, 13, 40])),
                lambda: "AKIA" + value(rng.choice([3, 13, 14, 16, 20]), string.ascii_uppercase + string.digits),
                lambda: value(rng.choice([3, 15, 16, 17, 64]), "0123456789abcdef"),
                lambda: rng.choice(["the", "é", "x" * 40, "token", "=", "AKIAAKIA", "passwordtoken=", "日本"]),
            ])())
        texts.append(rng.choice([" ", "", "\n", ","]).join(parts))
    return texts + [" ".join(["word"] * 200_000) + " secret=" + value(20)], value


def _plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_scan_equals_plain_patterns(spark):
    texts, _ = _secret_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        base = _plain(text)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("novel")] == (joined.split(",") if joined else [])
        taken = [(a, b) for a, _, b in base]
        for s in (s for s in every if s.startswith("novel")):
            a, b = map(int, s.split(":")[1:])
            assert all(b <= x or y <= a for x, y in taken) and re.fullmatch(r"[A-Za-z0-9+/_=.~-]{16,}", text[a:b])
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [20, 64, 513, 700, 5000])
@pytest.mark.parametrize("letters", [string.ascii_letters + string.digits, string.ascii_letters])
@pytest.mark.parametrize("context", ["Authorization: Bearer {}", "auth: {}", "private key for production-database-host: {}", "signature={}", 'curl -H "X-Auth-Key: {}" https://example.com/items'])
def test_novel_strings_of_any_length_are_found(context, letters, size):
    rng = random.Random(size)
    value = "".join(rng.choice(letters) for _ in range(size))
    text = "def load_settings(path):\n    return parse(path)\n" + context.format(value) + "\nthe end of the settings file"
    found = secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty())
    assert (text.index(value), 3, text.index(value) + size) in found


def test_names_and_words_are_left_alone():
    novelty = secrets.Novelty()
    for text in ("key: https://www.example.com/path/to/the/settings/file.html", "authentication: internationalization_of_the_default_settings", "the private signature: __init__.configuration_default_value", "password for production-database-host is not here"):
        assert secrets.novel_spans(text, [], novelty) == []
