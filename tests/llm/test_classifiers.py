"""The two trained classifiers against plain versions by dictionaries, and the bounds of what teaches them."""

from __future__ import annotations

import math

import numpy as np
import pytest

from treeline.llm import common, langid, quality

M = 1 << 32
TEXTS = ["", "   ", "one", "one one two", "Ünï cödé wörds, twice twice", "a b c d e f g a b c", "x" * 5000 + " " + "y" * 4097, "tab\tand\nline  two", " odd space"]


def plain_quality(text):
    words = (text or "").split()
    hashes, found = [], []
    for w in words:
        data = f"<{w}>".encode()
        h, place = 0, 1
        for i, c in enumerate(data):
            place = 0x01000193 if i % 4096 == 0 else place * 0x01000193 % M
            h = (h + (c + 1) * place) % M
        hashes.append(h)
        found.append(((h ^ h >> 15) * 0x2C1B3C6D % M) >> 16)
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                g = (data[i] * 0x9E3779B1 + data[i + 1]) % M
                for k in range(3, n + 1):
                    g = (g * 0x9E3779B1 + data[i + k - 1] + k) % M
                found.append(((g ^ g >> 15) * 0x85EBCA6B % M) >> 16)
    for a, b in zip(hashes, hashes[1:], strict=False):
        found.append(0 if a == b else 1 + ((a * 0x9E3779B1 % M ^ b * 0x85EBCA6B % M) >> 7) % (quality.BUCKETS - 1))
    return sorted(found)


def plain_grams(text):
    c = [ord(x) for x in text.lower()]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B + 1) % M for a, b in zip(c, c[1:], strict=False)]
    three = [(a * 0xC2B2AE35 + b * 0x27D4EB2F + 2) % M for a, b in zip(two, c[2:], strict=False)]
    mixed = [a * 0x165667B1 % M for a in c] + two + three
    return sorted(((m ^ m >> 15) * 0x2C1B3C6D % M) >> (32 - 15) for m in mixed)


@pytest.mark.parametrize("text", TEXTS)
def test_features_equal_plain(text):
    assert sorted(quality.text_buckets(text).tolist()) == plain_quality(text)
    if text:
        assert sorted(langid.grams(text).tolist()) == plain_grams(text)


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_sgd_equals_plain():
    """The whole training of a few documents, one weight at a time in dictionaries, and the scores of its model."""
    texts = [(1, "good words make good texts"), (0, "spam spam buy now"), (1, "other words of a good text"), (0, "buy spam cheap"), (0, "now now now")]
    rows = [(y, *quality.text_features(t)) for y, t in texts]
    got = quality.fit(rows, 0.25, epochs=3)
    draw, dims = np.random.default_rng(5), range(quality.DIMENSIONS)
    first = draw.uniform(-1.0 / quality.DIMENSIONS, 1.0 / quality.DIMENSIONS, (quality.BUCKETS, quality.DIMENSIONS))
    counts = []
    for y, t in texts:
        per: dict = {}
        for b in plain_quality(t):
            per[b] = per.get(b, 0) + 1
        counts.append((y, per))
    vector = {b: first[b].tolist() for _, per in counts for b in per}
    output, bias, done = [[0.0] * quality.DIMENSIONS for _ in range(2)], [0.0, 0.0], 0
    for _ in range(3):
        for i in draw.permutation(len(counts)):
            y, per = counts[i]
            total = sum(per.values())
            mean = [sum(n / total * vector[b][d] for b, n in per.items()) for d in dims]
            p = plain_softmax([sum(output[k][d] * mean[d] for d in dims) + bias[k] for k in (0, 1)])
            error = [p[k] - (k == y) for k in (0, 1)]
            rate = 0.5 * (1 - done / (3 * len(counts)))
            back = [sum(error[k] * output[k][d] for k in (0, 1)) for d in dims]
            for k in (0, 1):
                output[k] = [output[k][d] - rate * error[k] * mean[d] for d in dims]
                bias[k] -= 0.1 * rate * error[k]
            for b, n in per.items():
                vector[b] = [vector[b][d] - rate * 50 * n / total * back[d] for d in dims]
            done += 1
    prior = math.log(0.25 / 0.75) - math.log(0.4 / 0.6)
    assert got.bias == pytest.approx(bias[1] - bias[0] + prior, abs=1e-9)
    gain = {b: sum(v[d] * (output[1][d] - output[0][d]) for d in dims) for b, v in vector.items()}
    assert {b: float(got.gain[b]) for b in gain} == pytest.approx(gain, abs=1e-6)
    for _, t in texts:
        found = plain_quality(t)
        logit = got.bias + sum(gain[b] for b in found) / len(found)
        assert got.score(t) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
    assert got.score("") == got.score(None) == pytest.approx(1 / (1 + math.exp(-got.bias)))


def test_ftrl_equals_plain():
    """The leader after some rows, by one dictionary a class: proximal weights, adaptive rates, both penalties."""
    rows = [([0, 2, 5], [1.0, 0.5, 2.0], 0), ([2, 3], [1.0, 1.0], 1), ([0, 5], [0.25, 1.0], 2), ([2, 5], [1e-6, 1e-6], 1), ([0, 2, 3, 5], [1.0, 1.0, 1.0, 1.0], 0)] * 3
    model = langid.Ftrl(6, 3, rate=0.5, smooth=1.0, l1=0.01, l2=0.001)
    z, n = {}, {}

    def weight(f, k):
        s, q = z.get((f, k), 0.0), n.get((f, k), 0.0)
        return 0.0 if abs(s) <= 0.01 else -(s - math.copysign(0.01, s)) / ((1.0 + math.sqrt(q)) / 0.5 + 0.001)

    for at, x, label in rows:
        model.learn(np.array(at), np.array(x), label)
        w = {(f, k): weight(f, k) for f in at for k in range(3)}
        p = plain_softmax([sum(w[f, k] * v for f, v in zip(at, x, strict=True)) for k in range(3)])
        for f, v in zip(at, x, strict=True):
            for k in range(3):
                g = v * (p[k] - (k == label))
                q = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(q + g * g) - math.sqrt(q)) / 0.5 * w[f, k]
                n[f, k] = q + g * g
    want = [[weight(f, k) for k in range(3)] for f in range(6)]
    assert np.allclose(model.weights(slice(None)), want, atol=1e-12)
    assert want[1] == want[4] == [0.0] * 3 and any(w != 0 for w in want[5])


def test_language_scores_equal_plain():
    rows = [(lang, *np.unique(langid.grams(t), return_counts=True)) for lang, t in (("en", "the cat and the dog"), ("de", "der hund und die katze"), ("en", "the house"), ("de", "das haus"))]
    model = langid.fit([(lang, at, n / n.sum()) for lang, at, n in rows])
    for text in ("the dog", "die katze", "zzz", "x" * 40_000 + " the"):
        found = plain_grams(text)
        logits = [(sum(float(model.weights[b, k]) for b in found) / len(found) + model.bias[k]) / model.temperature for k in range(2)]
        p = plain_softmax(logits)
        lang, score = model.predict(text)
        assert (lang, score) == (model.languages[p.index(max(p))], pytest.approx(max(p), abs=1e-4))
    assert model.predict("the dog")[0] == "en" and model.predict("die katze")[0] == "de" and model.predict("12 34")[0] == "und"


def test_repeated_ids_teach_once(spark):
    """One document id with a thousand rows sends one row to the driver, whichever order they come in."""
    rows = [(7, f"good text number {i}", "en") for i in range(1000)] + [(8, "bad spam", "en"), (9, "der hund", "de"), (None, "ohne nummer", "de"), (None, "auch ohne", "de")]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    one, two = (spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(5) for r in (rows, rows[::-1]))
    a, b = quality.train(one, labels), quality.train(two, labels)
    assert a.bias == b.bias and np.array_equal(a.gain, b.gain)
    least = one.filter("doc_id = 7").selectExpr("min(struct(xxhash64(text) as h, text)).text").first()[0]
    alone = quality.train(one.filter(one.text.isin(least, "bad spam")), labels)
    assert a.bias == alone.bias and np.array_equal(a.gain, alone.gain)
    x, y = langid.train(one), langid.train(two)
    assert x.languages == y.languages == ["de", "en"] and np.array_equal(x.weights, y.weights) and x.temperature == y.temperature


def test_bounds_of_samples(spark, monkeypatch):
    rows = spark.createDataFrame([(4, [1, 2]), (1, [1, 2, 3]), (3, [5]), (3, [6, 7]), (2, [1, 2])], "draw long, at array<int>")
    kept = lambda most: sorted(r["draw"] for r in common.first_features(rows, most, "test").collect())
    assert [kept(m) for m in (10, 9, 8, 7, 5, 4, 2)] == [[1, 2, 3, 3, 4], [1, 2, 3, 3], [1, 2, 3, 3], [1, 2], [1, 2], [1], []]
    assert common.first_features(rows.limit(0), 5, "test").count() == 0
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, f"text {i} of it", "abc"[min(i % 4, 2)]) for i in range(40)] + [(99, "rare", "zz")], "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["a", "c"]
