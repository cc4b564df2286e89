"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they do not cover.

DataFrame functions only. Base matches (seeds) and other words with a digit or an @ (candidates) become mentions: a value, its
shape (digits as 9, letters as a) and the word before it. A lexical pattern is a word before and a shape. Patterns
and values form a graph that Spark scores in rounds: a pattern's confidence in a kind is the mean score of its
distinct values, a value's score the noisy-or of its confident patterns, seeds staying at 1. Scores never fall, and
rounds go on until none rises by more than RISE. Values over the threshold that no base pattern covers give
new spans of that kind. A candidate is one word, so an identifier that is written in several words and that no base
pattern knows is found word by word or not at all.

A text is cut at its matches into lengths, and matches become rows: positions are running sums of lengths over a text's rows, and
a candidate that touches a seed is told by the running maximum of where seeds end. So the work on a text of n matches is that of sorting n small rows.

Base kinds, leftmost and non-overlapping each: email; ip with parts to 255; card of 16 to 19 digits passing Luhn;
phone of 8 to 15 digits. Matches that fail are dropped, not retried. Positions are code points, ends exclusive.

Defined cases: null and empty texts have no spans; repeated rows each get their own result; values that several kinds
claim go to the likeliest, then the first of the list above; an empty table gives an empty result; columns other than
doc_id and text are never read. Regular expressions never go back over a run of characters that has failed, so they take
linear time on very long texts and words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Runs are possessive and start at a run's first character, or where the last match ended: the same matches as the
#: plain forms, in linear time.
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
CANDIDATE = "(?<!\\S)[^\\s0-9@]*+[0-9@]\\S*+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: A pattern counts from this confidence on and with at least so much of seeds' score behind it; a value from this score on.
CONFIDENT, SUPPORT, FOUND = 0.6, 3.0, 0.8
#: Rounds end when no score rises by more.
RISE = 0.001


def cut_at(text: Column, pattern: str) -> Column:
    """array<struct<value, before>> of a pattern's matches in order; before is what stands between this match and the last one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("before"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    each = F.split(F.reverse(number), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(f"^(?:{PART}\\.){{3}}{PART}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]", "a")


def word_before(before: Column) -> Column:
    """The last word of what stands before, lower-cased, without marks around it."""
    return F.regexp_replace(F.lower(F.regexp_extract(before, "(?<!\\S)(\\S++)\\s*+$", 1)), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def matches(text: Column, kind: int) -> Column:
    """A kind's matches, -1 for candidates, in order: struct<kind, place, gap, size, lead, length, fits, value, pattern>.

    gap is how far the match stands behind the one before it, and size is its length. What counts of it is `length` code points from
    `lead` on, if it fits. Texts without the kind's tell-tale character are not searched.
    """
    name = KINDS[kind] if kind >= 0 else "candidate"
    there = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9]"), "candidate": text.rlike("[0-9@]")}[name]

    def one(m: Column, place: Column) -> Column:
        value = m["value"]
        if kind < 0:
            tail = F.regexp_replace(value, "^[^A-Za-z0-9]+", "")
            lead, value = F.length(value) - F.length(tail), F.regexp_replace(tail, "(?<=[A-Za-z0-9])[^A-Za-z0-9]+$", "")
            fits = F.length(value) > 0
        else:
            lead, fits = F.lit(0), passes(name, value)
        parts = [F.lit(kind).alias("kind"), place.alias("place"), F.length(m["before"]).alias("gap"), F.length(m["value"]).alias("size"), lead.alias("lead"), F.length(value).alias("length"), fits.alias("fits")]
        return F.struct(*parts, F.xxhash64(value).alias("value"), F.xxhash64(word_before(m["before"]), shape(value)).alias("pattern"))

    return F.transform(cut_at(F.when(there, text).otherwise(""), PATTERNS.get(name, CANDIDATE)), one)


def with_mentions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(row, doc_id) and mentions(row, kind, start, end, value, pattern), both written: valid base matches, and candidates, of kind -1, that touch none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    found = F.concat(*[matches(F.col("text"), k) for k in (*range(len(KINDS)), -1)])
    each = written(rows.select("row", "doc_id", F.posexplode_outer(found).alias("at", "m")).select("row", "doc_id", "at", "m.*"), "matches")
    documents = each.filter("at is null or at = 0").select("row", "doc_id")

    in_kind = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.filter("kind is not null").drop("doc_id", "at").repartition("row").withColumn("start", F.sum(F.col("gap") + F.col("size")).over(in_kind) - F.col("size") + F.col("lead"))
    placed = placed.filter("fits").withColumn("end", F.col("start") + F.col("length"))
    seed = F.col("kind") >= 0
    # Seeds come in where they begin, candidates where they end, before the seeds that begin there.
    up_to = Window.partitionBy("row").orderBy(F.when(seed, F.col("start")).otherwise(F.col("end")), seed).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    touched = F.max(F.when(seed, F.col("end"))).over(up_to)
    clear = placed.withColumn("touched", touched).filter(seed | F.col("touched").isNull() | (F.col("touched") <= F.col("start")))
    return documents, written(clear.select("row", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value", "pattern"), "mentions")


def scored_values(mentions: DataFrame) -> DataFrame:
    """mentions(kind, value, pattern) -> value, kind, score: the graph's values once no score rises by more than RISE.

    What is joined is written first, so that joins meet plain tables and can split the rows of a frequent value or pattern.
    """
    edges = written(mentions.select("pattern", "value", "kind").distinct(), "pattern-edges")
    links = written(edges.select("pattern", "value").distinct(), "pattern-links")
    scores = written(edges.filter("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "seed-values")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("values"))
    while True:
        behind = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        patterns = behind.join(sizes, "pattern").withColumn("confidence", F.col("support") / F.col("values"))
        patterns = written(patterns.filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern", "kind", "confidence"), "patterns")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        reached = links.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        both = reached.withColumn("was", F.lit(0.0)).unionByName(scores.withColumn("was", F.col("score")))
        further = written(both.groupBy("value", "kind").agg(F.max("score").alias("score"), F.max("was").alias("was")), "value-scores")
        scores = further.select("value", "kind", "score")
        if further.filter(F.col("score") > F.col("was") + RISE).isEmpty():
            return scores


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and added, arrays of struct<kind, start, end> with kind as the place in KINDS."""
    documents, mentions = with_mentions(docs)
    found = scored_values(mentions.select("kind", "value", "pattern")).filter(F.col("score") >= FOUND)
    best = written(found.groupBy("value").agg(F.max_by("kind", F.struct(F.col("score"), -F.col("kind"))).alias("found")), "found-values")
    base = mentions.filter("kind >= 0").select("row", F.struct("kind", "start", "end").alias("base"))
    added = mentions.filter("kind < 0").join(best, "value").select("row", F.struct(F.col("found").alias("kind"), "start", "end").alias("added"))
    spans = documents.unionByName(base, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)
    lists = [F.array_sort(F.collect_list(c)).alias(c) for c in ("base", "added")]
    return spans.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *lists).drop("row")


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """personal_data's rows as counts, a hash of the base spans and the text of all spans."""
    def of_kind(i: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == i

    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
