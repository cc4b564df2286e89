"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of a text's lower-cased characters, as shares of its n-grams times their inverse
document frequency. The model is trained by follow-the-regularised-leader with an elastic-net penalty (L1 keeps it
sparse), on a bounded sample per language, and its softmax is then cooled or warmed by one temperature fitted on
sampled rows that the training has not seen.

What teaches is bounded by four parameters: the LANGUAGES most frequent languages, of them about PER_LANGUAGE documents
each and SAMPLE in all, by the smallest hashes and one row of each document, and FEATURES distinct n-grams of them all.
Every whole text is scored.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything where there is nothing
to learn from; rows without a language teach nothing; of several rows of one doc_id and language the text of the least hash teaches; repeated rows are scored alike; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import first_features, per_row, small_batches

BUCKETS = 1 << 15
PER_LANGUAGE = 900
#: Documents of all languages together in the sample.
SAMPLE = 20_000
#: Languages that are learned, the most frequent first; the model is this wide at most.
LANGUAGES = 256
#: Distinct n-grams of all sampled documents together: what goes to the driver.
FEATURES = 16_000_000
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of the lower-cased characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B) + np.uint32(1)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
    one = c * np.uint32(0x165667B1)
    mixed = np.concatenate([one, two, three])
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, with the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at = grams(text)
        share = np.bincount(at, minlength=BUCKETS).astype(np.float32) if len(at) > BUCKETS else None
        sums = share @ self.weights if share is not None else self.weights[at].sum(axis=0, dtype=np.float64)
        p = softmax((sums / len(at) + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one adaptive rate per weight, L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, rate: float = 0.5, smooth: float = 1.0, l1: float = 1e-4, l2: float = 1e-5):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.smooth + np.sqrt(n)) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, scale: float = 30.0) -> Model:
    """rows: language, distinct buckets, their shares. Every fifth row of a language calibrates instead of teaching."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    place = {x: i for i, x in enumerate(languages)}
    df = np.zeros(BUCKETS)
    seen = dict.fromkeys(languages, 0)
    teach, check = [], []
    for language, at, share in rows:
        df[at] += 1
        seen[language] += 1
        (check if seen[language] % 5 == 0 else teach).append((place[language], at, share))
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    model = Ftrl(BUCKETS + 1, len(languages))
    draw = np.random.default_rng(10)
    for _ in range(epochs):
        for i in draw.permutation(len(teach)):
            label, at, share = teach[i]
            model.learn(np.append(at, BUCKETS), np.append(share * idf[at] * scale, 1.0), label)
    w = model.weights(slice(None))
    full, bias = w[:BUCKETS] * (idf * scale)[:, None], w[BUCKETS]
    temperature = 1.0
    if check:
        logits = np.array([share @ full[at] + bias for _, at, share in check])
        truth = np.array([label for label, _, _ in check])
        temperature = calibrate(logits, truth)
    return Model(languages, full.astype(np.float32), bias, temperature)


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature, between 1/20 and 20, under which the true classes are likeliest."""
    each = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in each]
    return float(each[int(np.argmin(loss))])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs(doc_id, text, lang): the rows to learn from."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {lang: n for lang, n in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit([])
    per_language = min(per_language, max(1, SAMPLE // len(counts)))
    draw = (F.xxhash64("doc_id", F.lit(10)) / F.lit(2.0**64)) + 0.5
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    out = pa.schema([("lang", pa.string()), ("draw", pa.float64()), ("hash", pa.int64()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def make():
        def each(lang, text, draw, hashed):
            at, n = np.unique(grams(text), return_counts=True) if has_letter(text) else (np.zeros(0, dtype=int), np.zeros(0))
            return lang, draw, hashed, at.tolist(), (n / max(1, n.sum())).tolist()

        return each

    drawn = known.withColumn("draw", draw).filter(F.col("draw") < chance[F.col("lang")])
    sample = drawn.groupBy("lang", "doc_id", "draw").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")).select("lang", "t.text", "draw", "t.hash")
    rows = sample.mapInArrow(per_row(make, out), "lang string, draw double, hash long, at array<int>, share array<float>").filter(F.size("at") > 0)
    got = first_features(rows, FEATURES, "language-sample").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending"), ("hash", "ascending")])
    arrays = lambda c: [x.values.to_numpy() for x in got[c]]
    return fit(list(zip(got["lang"].to_pylist(), arrays("at"), arrays("share"), strict=True)))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, and the carried columns after them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *(batch.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", *carry])

    return rows.mapInArrow(run, ", ".join(["doc_id long", "lang_pred string", "score double", *(f"{c} {kinds[c]}" for c in carry)]))
