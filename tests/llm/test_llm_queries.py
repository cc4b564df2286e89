"""The numbered queries as they are registered: columns, folds and digests on a whole small table."""

from __future__ import annotations

import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import plain_components
from treeline.llm import queries, urls

COLUMNS = {
    "op1_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op3_media_tiles": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op7_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op8_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op9_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
}


@pytest.fixture(scope="module")
def results(spark, sf):
    return {name: [r.asDict() for r in q(spark, sf).collect()] for name, q in queries.queries().items()}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, texts, spark, sf, name):
    got = results[name]
    assert COLUMNS[name] <= set(got[0])
    assert len(got) == (spark.read.parquet(f"{sf}/pages.parquet").count() if name.startswith(("op6", "op11")) else len(texts))


@pytest.mark.parametrize(("name", "folds", "out"), [("op5_quality", 5, 0), ("op10_language_id", 4, 2)])
def test_folds(results, name, folds, out):
    for r in results[name]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) and 0 <= r["score"] <= 1
        assert "predicted" not in r or r["predicted"] == int(r["score"] >= 0.3)


def test_leak_digests(results):
    for r in results["op2_decontaminate"]:
        assert r["contaminated"] == (r["n_hit"] > 0) == (r["n_items"] > 0)
        assert (r["items_sha256"] == hashlib.sha256(b"").hexdigest()) == (r["n_items"] == 0)


def plain_hash(image):
    """The difference hash of an image by exact areas: 8 x 9 means, neighbours compared."""
    h, w = image.shape

    def weights(n, cells):
        rows = np.zeros((cells, n))
        for c in range(cells):
            a, b = c * n / cells, (c + 1) * n / cells
            for i in range(n):
                rows[c, i] = max(0.0, min(b, i + 1) - max(a, i))
        return rows

    small = weights(h, 8) @ image.astype(float) @ weights(w, 9).T / (h / 8 * w / 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes().hex()


def test_media_digests(results, texts):
    for r in results["op3_media_tiles"][::20]:
        data = (texts[r["doc_id"]] or "").encode()
        full = max(1, -(-len(data) // 576)) * 576
        payload = data.ljust(full, b"\xff")
        stored = io.BytesIO()
        np.save(stored, np.frombuffer(payload, dtype=np.uint8).reshape(-1, 24, 24))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), full, zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        assert r["feature"] == plain_hash(np.frombuffer(payload, dtype=np.uint8).reshape(-1, 24))


def test_components_of_the_table(results, texts):
    want = plain_components(list(texts.items()))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in results["op8_jaccard_join"]} == want


def plain_scores(rows, seeds, told=None):
    """Naive Bayes in rounds over tokens of rows(key, tokens, full): log odds for block. told: rules' verdicts."""
    told = told or {}
    label, before, scores = {k: told.get(k, int(full or any(t.removeprefix("/") in seeds for t in tokens))) for k, (tokens, full) in rows.items()}, None, {}
    while label != before:
        before_label, before = label, sum(label.values())
        count = {}
        for k, (tokens, _) in rows.items():
            for t in tokens:
                count.setdefault(t, [0, 0])[label[k]] += 1
        v, allow, block = len(count), sum(c[0] for c in count.values()), sum(c[1] for c in count.values())
        prior = math.log((before + 1) / (len(rows) - before + 1))
        scores = {k: prior + sum(math.log((count[t][1] + 1) / (block + v + 1)) - math.log((count[t][0] + 1) / (allow + v + 1)) for t in tokens) for k, (tokens, _) in rows.items() if tokens}
        label, before = {k: told.get(k, int(label[k] or scores.get(k, 0) > 0)) for k in rows}, before_label
    return scores


def test_url_scores_are_naive_bayes(spark):
    rng = np.random.default_rng(3)
    words = "casino poker bonus garden music school weather history".split()
    pages = [(i, f"http://{rng.choice(words)}{rng.choice(words)}.example/{rng.choice(words)}/{i}?x", " ".join(words * 20)) for i in range(120)]
    got = [r.asDict() for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    rows = {}
    for r in got:
        path = [t for t in re.split("[^a-z0-9]+", re.sub("[0-9]+", "0", r["path"].lower())) if t]
        rows[r["page_id"]] = ([*r["words"].split(" "), *("/" + t for t in path)], True)  # every page's text is full of seeds
    full = plain_scores(rows, urls.SEEDS)
    assert all(r["score"] == pytest.approx(full[r["page_id"]]) for r in got)
    bare = [(i, u, "garden music " * 50 + " ".join(words)) for i, u, _ in pages]
    got = [r.asDict() for r in urls.judge(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()]
    want = plain_scores({k: (tokens, False) for k, (tokens, _) in rows.items()}, urls.SEEDS)
    assert all(r["score"] == pytest.approx(want[r["page_id"]]) and r["verdict"] == ("block" if r["score"] > 0 else "allow") for r in got)


def test_rules_teach_the_given_pages(spark, sf):
    """Urls without a rule are judged by what the rules' urls teach: plain Bayes agrees, and both verdicts are given."""
    got = [r.asDict() for r in urls.judge(spark.read.parquet(f"{sf}/pages.parquet")).collect()]
    full = {r["page_id"] for r in spark.read.parquet(f"{sf}/pages.parquet").filter(urls.full_of(F.col("html"), urls.SEEDS)).collect()}
    rows, told = {}, {}
    for r in got:
        path = [t for t in re.split("[^a-z0-9]+", re.sub("[0-9]+", "0", r["path"].lower())) if t]
        rows[r["page_id"]] = ([*filter(None, r["words"].split(" ")), *("/" + t for t in path)], r["page_id"] in full)
        if r["rule"]:
            told[r["page_id"]] = int(r["verdict"] == "block")
    want = plain_scores(rows, urls.SEEDS, told)
    free = [r for r in got if not r["rule"]]
    assert told and all(r["score"] == pytest.approx(want[r["page_id"]]) and r["verdict"] == ("block" if r["score"] > 0 else "allow") for r in free)
    assert {r["verdict"] for r in free} == {"allow", "block"}
