"""Archives, spelling variants and whitening against plain Python, on the small tables and on awkward rows."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import queries, variants, warc, whitening

# --- archives ---------------------------------------------------------------------------------------------------------


def plain_archive(rows):
    """rows(page_id, html) with unique ids -> page_id: (bytes, digest, type, refers_to)."""
    data = {p: (h or "").encode() for p, h in rows}
    kept = {}
    for p, d in data.items():
        kept[d] = max(p, kept.get(d, p))
    return {p: (len(d), hashlib.sha1(d).hexdigest(), *(("response", None) if len(d) < 1000 or kept[d] == p else ("revisit", kept[d]))) for p, d in data.items()}


def as_plain(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_archives_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert as_plain(queries.op11_warc(spark, sf)) == plain_archive([(r["page_id"], r["html"]) for r in pages.collect()])


def test_archives_equal_their_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    result = duck.execute(queries.oracle_sql()["op11_warc"])
    names = [x[0] for x in result.description]
    assert sorted(map(tuple, queries.op11_warc(spark, sf).select(*names).collect())) == sorted(result.fetchall())


def test_copies_are_revisits(spark):
    long, short = "é" * 500, "x" * 999
    rows = [(1, None, long), (2, "http://a b\n/c", long), (7, "u", long), (3, "u", short), (4, "u", short), (5, "u", None), (6, "", ""), (-8, "u", long + "y" * 200_000), (9, "u", long + "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("told", F.lit("x")).withColumn("size", F.lit(1))
    assert as_plain(warc.round_trip(pages)) == plain_archive([(p, h) for p, _, h in rows])
    twice = warc.round_trip(pages.unionByName(pages).unionByName(pages.withColumn("page_id", F.lit(None).cast("long")))).collect()
    assert len(twice) == 3 * len(rows)
    same = [(r["page_id"], r["record_type"], r["refers_to"]) for r in twice if r["payload_digest"] == hashlib.sha1(long.encode()).hexdigest()]
    assert sorted(x[1] for x in same) == ["response"] + ["revisit"] * 8 and {x[2] for x in same if x[1] == "revisit"} == {7} and (7, "response", None) in same
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_files(spark, tmp_path):
    rows = [(i, f"http://host/{i}", "".join(random.Random(i).choices("abcdefgh <>é", k=5000 + i))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, f"{tmp_path}/out", most=20_000)
    assert manifest.count() > 4
    records = [r for r in warc.read_archives(manifest, payloads=True).collect() if r["type"] != "warcinfo"]
    assert {(r["page_id"], r["uri"], r["payload"].decode()) for r in records} == set(rows)
    assert all(r["verified"] and r["error"] is None for r in records)
    # Each record is a member of its own at its offset, and any reader of gzip reads the whole file.
    for r in records[:10]:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    whole = b"".join(gzip.open(r["file"]).read() for r in manifest.collect())
    assert whole.count(b"WARC/1.1\r\n") == sum(r["records"] for r in manifest.collect())


def response(payload, digest=None, length=None, tail=b"\r\n\r\n", level=6):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Payload-Digest: sha1:{digest or hashlib.sha1(payload).hexdigest()}\r\nX-Long: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return gzip.compress(head.encode() + block + tail, level)


def read(data):
    return [(r.get("payload"), r.get("error")) for r in warc.records_of(io.BytesIO(data), keep=True)]


def test_reader_finds_damage():
    good, big = response(b"good"), response(bytes(range(256)) * 2000, level=0)
    assert read(good + big + response(b"")) == [(b"good", None), (bytes(range(256)) * 2000, None), (b"", None)]
    assert read(b"") == []
    for bad, error in [
        (response(b"x", digest="0" * 40), "payload's digest"),
        (response(b"x" * 40, length=10), "longer than its Content-Length"),
        (response(b"x" * 40, length=1000), "shorter than its Content-Length"),
        (response(b"x", tail=b""), "shorter than its Content-Length"),
        (response(b"x", tail=b"\r\n\r\nmore"), "more than one record"),
        (response(b"x", digest="!"), "no digest"),
        (gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n\r\n\r\n"), "no Content-Length"),
        (gzip.compress(b"something else\r\n\r\n"), "no WARC record"),
        (gzip.compress(b"WARC/1.0\r\n"), "header does not end"),
        (good[:-6] + b"\0\0" + good[-4:], "damaged member"),
        (big[:300_000], "the file ends inside a member"),  # what it lacks is taken from the members after it, which are read again
        (b"not gzip at all", "damaged member"),
    ]:
        got = read(good + bad + good + good)
        assert got[0] == got[-1] == got[-2] == (b"good", None), error
        assert error in got[1][1] and len(got) == 4
    assert read(good + good[:-3]) == [(b"good", None), (None, "the file ends inside a member")]


def test_revisits_that_lead_nowhere(spark):
    rows = [("response", "a", 1, None, "d1"), ("revisit", "b", 2, "a", "d1"), ("revisit", "c", 3, "z", "d1"), ("revisit", "e", 4, "a", "d2")]
    records = spark.createDataFrame([(*r, None) for r in rows], "type string, record_id string, page_id long, refers_to string, payload_digest string, error string")
    assert {r["page_id"]: (r["refers_page"], r["error"]) for r in warc.resolved(records).collect()} == {1: (None, None), 2: (1, None), 3: (None, "nothing to refer to"), 4: (1, "another payload")}


# --- spelling variants ------------------------------------------------------------------------------------------------


def plain_words(rows):
    count = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def as_variants(df):
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_variants_of_the_table(spark, sf):
    words = plain_words([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert words and as_variants(queries.op12_spelling_variants(spark, sf)) == plain_variants(words)


@pytest.mark.parametrize("leaf", [1, 30, 400, 10**6])
def test_near_words_at_every_cut(spark, leaf):
    """However early states become initial ones, the near words are the same."""
    rng = random.Random(leaf)
    words = {"".join(rng.choices("abÿ", k=rng.randint(1, 7))): rng.randint(1, 500) for _ in range(400)} | {"a" * n: n for n in range(1, 12)} | {"abc" * 40 + x: 3 for x in ("", "a", "b", "ab", "ba", "z" * 300)}
    got = {r["word"]: (r["near"], r["form_n"], r["form"]) for r in variants.near_table(spark.createDataFrame(list(words.items()), "word string, n long"), leaf).collect()}
    near = plain_near(words)
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    assert got == {w: (len(near[w]), words[b], b) for w, b in best.items()}


def test_acceptor_is_minimal():
    """As many states as there are different sets of what can follow a prefix."""
    rng = random.Random(5)
    for _ in range(50):
        words = sorted({"".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 30))})
        machine = variants.Acceptor(words)
        rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
        assert len(machine.arcs) == len(rights)
        accepted, todo = [], [(machine.start, "")]
        while todo:
            q, w = todo.pop()
            accepted += [w] if machine.final[q] else []
            todo += [(r, w + c) for c, r in machine.arcs[q].items()]
        assert sorted(accepted) == words


def test_forms_lead_to_roots(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 3, "zzzzzzx": 30, "zzzzzxz": 30, "zzzzzzy": 29}
    texts = [(None, " ".join(w for w, n in counts.items() for _ in range(n)))]
    docs = spark.createDataFrame(texts, "doc_id string, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("state", F.lit(1))
    want = plain_variants(plain_words(texts))
    got = as_variants(variants.variants(docs))
    assert got == want
    rows = spark.createDataFrame(list(zip("abcdefgh", "bcdefghi", strict=True)), "word string, form string")
    assert {r["word"]: r["root"] for r in variants.rooted(rows).collect()} == dict.fromkeys("abcdefgh", "i")


def test_variants_awkward(spark):
    long = "word" * 300
    rows = [(1, None), (2, ""), (3, "ÀÉ×÷ÿaZ ÀÉ×÷ÿaz short 12345678 日本語"), (3, "ÀÉ×÷ÿaZ"), (None, long + "a " + long), (None, long + "a " + long + " " + long + "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_words(rows))
    assert as_variants(variants.variants(docs)) == want and want
    huge = "word" * 50_000
    words = spark.createDataFrame([(huge, 2), (huge[:100] + "x" + huge[101:], 7), (huge + "z", 1), ("x" + huge[1:], 7)], "word string, n long")
    assert {(r["word"], r["near"], r["form"]) for r in variants.near_table(words).collect()} == {(huge, 3, min(huge[:100] + "x" + huge[101:], "x" + huge[1:])), (huge[:100] + "x" + huge[101:], 1, huge), (huge + "z", 1, huge), ("x" + huge[1:], 1, huge)}
    assert variants.variants(docs.limit(0)).count() == 0 and variants.variants(docs.filter("doc_id = 2")).count() == 0


# --- whitening --------------------------------------------------------------------------------------------------------


def exact_covariance(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dim)]
    y = [[n * r[d] - s[d] for d in range(dim)] for r in x]
    return y, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(dim)] for i in range(dim)]


def test_whitening_of_the_table(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = collections.defaultdict(dict)
    for r in queries.op13_whitening(spark, sf).collect():
        got[r["vec_id"]][r["component"]] = r
    y, covariance = exact_covariance(vectors.values())
    n, exact = len(vectors), np.array([[float(c) for c in row] for row in covariance])
    values, axes = np.linalg.eigh(exact)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    white = np.array([[got[v][k]["whitened"] for k in range(1, 9)] for v in vectors])
    want = np.array(y, dtype=float) / n @ axes / np.sqrt(values)
    want *= np.sign((want * white).sum(axis=0))
    assert set(got) == set(vectors) and np.allclose(white, want, atol=1e-8)
    centred = white - white.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(8)).max()
    for (v, rows), own in zip(((v, got[v]) for v in vectors), y, strict=True):
        for k in range(1, 9):
            r = rows[k]
            assert (r["n"], r["deviation"]) == (n, sum(a * a for a in own)), v
            assert r["explained"] == pytest.approx(values[k - 1] / np.trace(exact), rel=1e-9) and r["identity_error"] == pytest.approx(error, abs=1e-12)


def test_covariance_is_exact_at_any_size(spark):
    """Entries of many sizes: 64-bit numbers, limbs and Python's numbers all give the exact covariances."""
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e4, 1e8, 1e12, 4e15):
        vectors = (rng.standard_normal((300, 5)) * scale / 4).tolist()
        rows = whitening.whole(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
        y, want = exact_covariance(vectors)
        sums = whitening.totals(rows, 5, whitening.sums_of)
        got = whitening.covariance(rows, 5, 300, [sums[i] for i in range(5)])
        assert (got == np.array([[float(c) for c in r] for r in want])).all()
        deviation = {r["vec_id"]: r["deviation"] for r in whitening.project(rows, whitening.fit(rows)).collect()}
        exact = [sum(a * a for a in r) for r in y]
        assert all(deviation[i] == (d if d < 10**38 else None) for i, d in enumerate(exact))


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<float>, component int, n int, whitened string"
    good = [(i, [float(i), float(i * i % 7), float(i % 3)], 0, 0, "") for i in range(20)]
    bad = [(50, None, 0, 0, ""), (51, [1.0, None, 2.0], 0, 0, ""), (52, [1.0, float("nan"), 2.0], 0, 0, ""), (53, [1.0, float("inf"), 2.0], 0, 0, ""), (54, [1.0], 0, 0, ""), (55, [], 0, 0, ""), (56, [3e38, 1.0, 1.0], 0, 0, "")]
    got = whitening.whiten(spark.createDataFrame(good + bad + [(None, [5.0, 1.0, 2.0], 0, 0, ""), good[3]], schema)).collect()
    assert len(got) == 22 * 3 and {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {22}
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 3 for r in got) == 6
    assert got[0]["identity_error"] < 1e-9
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 1.0], 0, 0, "") for i in range(9)], schema)).collect()
    assert len(flat) == 9 and all(r["explained"] == pytest.approx(1) for r in flat)
    for rows in ([], bad[:2], good[:1], [good[1]] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
