"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document is the mean of learned vectors, one for each hashed feature: its words, their character 3- to 5-grams with
marks at word ends, and its word pairs (a word that repeats the one before it is one feature, whichever the word).
Vectors and output weights are trained together by stochastic gradient descent in numpy, on a bounded, class-balanced
sample of labelled rows; the output's bias is then set back to the labels' true shares.

Because the output is linear in the mean, scoring needs one number a feature: the difference of the two classes'
products with its vector.

What teaches is bounded by two parameters: PER_CLASS documents of a class, one row of each document, and FEATURES
distinct features of them all; every whole text is scored.

Defined cases: null, empty and wordless texts have no features and get the bias alone; labels other than 0 and 1 and
labels of unknown documents teach nothing, nor do those of a document that is labelled both ways; of several texts of one
doc_id the one of the least hash teaches; without labels every score is 0.5; repeated rows are scored alike; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import first_features, per_row, small_batches
from treeline.llm.langid import crc_mod, softmax

BUCKETS = 1 << 16
DIMENSIONS = 10
PER_CLASS = 1500
#: Distinct features of all sampled documents together: what goes to the driver.
FEATURES = 16_000_000


#: Weights of a byte by its place in a word; words are hashed as weighted sums, places beyond the table start it again.
PLACES = np.cumprod(np.full(4096, 0x01000193, dtype=np.uint32), dtype=np.uint32)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, bucket 0 where they are equal."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))
    return np.where(a == b, np.uint32(0), 1 + (mixed >> np.uint32(7)) % np.uint32(BUCKETS - 1))


def text_buckets(text: str | None) -> np.ndarray:
    """Buckets of all features of a text: marked words, their 3- to 5-grams of bytes, and word pairs."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.uint32)
    data = np.frombuffer(("<" + "> <".join(words) + ">").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = data == 32
    starts = np.concatenate([[0], np.flatnonzero(space) + 1])
    word = np.cumsum(space)
    c = data.astype(np.uint32)
    place = (np.arange(len(c)) - starts[word]) % len(PLACES)
    hashes = np.add.reduceat(np.where(space, np.uint32(0), (c + np.uint32(1)) * PLACES[place]), starts, dtype=np.uint32)
    found = [(hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16), pair_features(hashes)]
    h = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    for n in (3, 4, 5):
        h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        inside = word[n - 1 :] == word[: len(word) - n + 1]
        inside &= ~space[: len(inside)]
        kept = h[inside]
        found.append((kept ^ (kept >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16))
    return np.concatenate(found)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    return np.unique(text_buckets(text).astype(np.int64), return_counts=True)


@dataclass
class Model:
    gain: np.ndarray  # per bucket: how much it speaks for class 1
    bias: float

    def score(self, text: str | None) -> float:
        at = text_buckets(text)
        logit = self.bias + (float(self.gain[at].mean(dtype=np.float64)) if len(at) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share_of_one: float, epochs: int = 8, rate: float = 0.5) -> Model:
    """rows: label, distinct buckets, counts. Plain stochastic gradient descent with a falling rate."""
    labels = {r[0] for r in rows}
    if labels != {0, 1}:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    draw = np.random.default_rng(5)
    vectors = draw.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            label, at, counts = rows[i]
            share = counts / max(1, counts.sum())
            mean = share @ vectors[at]
            error = softmax(output @ mean + bias)
            error[label] -= 1.0
            now = rate * (1.0 - done / steps)
            back = error @ output
            output -= now * np.outer(error, mean)
            bias -= 0.1 * now * error
            # A feature's step is scaled by its share; 50 makes up for the thousands of features that share one mean.
            vectors[at] -= (now * 50.0) * np.outer(share, back)
            done += 1
    ones = sum(r[0] for r in rows) / len(rows)
    prior = np.log(share_of_one / (1 - share_of_one)) - np.log(ones / (1 - ones))
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0] + prior))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): at most per_class rows of each class, those with the smallest hashes."""
    small_batches(docs.sparkSession)
    given = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").select("doc_id", "quality")
    counts = dict(known.groupBy("quality").count().collect())  # two rows
    if set(counts) != {0, 1}:
        return fit([], 0.5)
    draw = F.xxhash64("doc_id", F.lit(5))
    picked = [known.filter(F.col("quality") == q).select("quality", "doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(per_class) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    out = pa.schema([("quality", pa.int32()), ("draw", pa.int64()), ("hash", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def make():
        def each(quality, draw, hashed, text):
            at, n = text_features(text)
            return quality, draw, hashed, at.tolist(), n.tolist()

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = texts.join(F.broadcast(sample), "doc_id").groupBy("quality", "doc_id", "draw").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    rows = drawn.select("quality", "draw", "t.hash", "t.text")  # at most 2 * per_class rows
    taught = first_features(rows.mapInArrow(per_row(make, out), "quality int, draw long, hash long, at array<int>, n array<int>"), FEATURES, "quality-sample")
    got = taught.toArrow().sort_by([("draw", "ascending"), ("hash", "ascending")])
    arrays = lambda c: [x.values.to_numpy() for x in got[c]]
    return fit(list(zip(got["quality"].to_pylist(), arrays("at"), arrays("n"), strict=True)), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score between 0 and 1, higher for better."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        own = shared.value

        def each(doc_id, text):
            return doc_id, own.score(text)

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_row(make, out), "doc_id long, score double")


def held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Scores of all docs by a model of the labels outside fold 0: doc_id, held_out, score, predicted."""
    model = train(docs, labels.filter(crc_mod(F.col("doc_id"), folds) != 0))
    scored = score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
