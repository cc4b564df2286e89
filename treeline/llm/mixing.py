"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Each source takes whole passes while its target allows, and fits the
rest of its budget with an even share of every length and a bounded-knapsack dynamic programme for what that leaves. Which documents of a length are
taken is decided by a seeded hash of the document's id.

Defined cases: a null or wordless text has length 0 and is taken 0 words; a null source is a source of its own, after
all others; repeated rows are separate documents (equal ones tie, and any of them may be the one taken); an empty table
gives an empty result; columns other than the three named are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import word_count, written

#: Documents of one (source, length) are ranked in buckets of about this many, so that no task holds a whole hot length.
RANKED_TOGETHER = 256

#: Documents of a source that are given back at most to meet its budget, whatever its size: the remainder that a knapsack
#: fills is never more than their words and one document's.
GIVEN_BACK = 64


def even_shares(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The same share of every length's documents, carried from the longest to the shortest, so that about one document's words are left at most."""
    take = np.zeros(len(lengths), dtype=np.int64)
    total, wanted, got = int((lengths * counts).sum()), 0.0, 0
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] <= 0:
            continue
        wanted += float(lengths[i]) * float(counts[i]) * budget / total
        n = int(min(counts[i], max(0, (min(wanted, budget) - got) // lengths[i])))
        take[i] = n
        got += n * int(lengths[i])
    return take


def kept_after(take: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """How many documents are given back and what is kept: none, then 1, 2, 4 ... of them, and at last all.

    They come from lengths spread over all, and from a length again only once every length has given one.
    """
    yield 0, take
    n, total = 1, int(take.sum())
    while n < total:
        kept, left = take.copy(), n
        while left > 0:
            used = np.flatnonzero(kept > 0)
            some = min(left, len(used))
            kept[used[(np.arange(some) * len(used) + len(used) // 2) // some]] -= 1
            left -= some
        yield n, kept
        n *= 2
    yield total, np.zeros_like(take)


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to budget, or as near below as GIVEN_BACK documents allow.

    Every length gives its even share, so short and long documents are taken alike. A bounded knapsack over what is left
    of each count fills the remainder; where that does not reach the budget, more and more documents are given back to
    widen its choice, up to GIVEN_BACK of them or to all.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64).copy()
    best, most = None, -1
    for given, kept in kept_after(even_shares(lengths, counts, budget)):
        if given > GIVEN_BACK:
            break
        rest = budget - int((kept * lengths).sum())
        tried = kept + knapsack(lengths, counts - kept, rest)
        reached = int((tried * lengths).sum())
        if reached > most:
            best, most = tried, reached
        if most == budget:
            break
    return best


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the largest sum not over budget, from few long documents rather than many short ones. Counts are split into powers of two."""
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, k = int(lengths[i]), int(counts[i]), 1
        if length <= 0 or length > budget:
            continue
        left = min(left, budget // length)
        while left > 0:
            n = min(k, left)
            items.append((int(i), n, n * length))
            left, k = left - n, 2 * k
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)
    for j, (_, _, weight) in enumerate(items):
        if weight > budget:
            continue
        new = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
        by[new] = j
        reached[new] = True
        if reached[budget]:
            break
    take = np.zeros(len(lengths), dtype=np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:  # the first item to reach a sum comes from a sum that earlier items reach
        i, n, weight = items[by[at]]
        take[i] += n
        at -= weight
    return take


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, share: float) -> DataFrame:
    """sizes(source, source_size) with weight and target: share of all words, shared by weight, no source over cap times its size.

    Sources rank by code point, null last, and take the weights in turn. The rank comes from a range partitioning and
    the level of the shares from a few sums over the table of sources, so neither passes through one task.
    """
    spark = sizes.sparkSession
    by = F.col("source").asc_nulls_last()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    ranged = written(sizes.repartitionByRange(n, by).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1 + F.col("offset")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = written(ranged.join(offsets, "part").select("source", "source_size", weight.alias("weight")), "weights")
    top = F.col("source_size") * F.lit(float(cap))
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, before_level = 0.0, -1.0
    while level != before_level:  # the level only rises, as more sources stop at their cap
        over = F.lit(level) * F.col("weight") >= top
        full, free = ranked.agg(F.coalesce(F.sum(F.when(over, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        before_level, level = level, max(level, (total - full) / free) if free > 0 else level
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), top))


def plan_lengths(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (source, size): passes over all its documents, and how many of its n documents are taken once more.

    A group is one source's distinct lengths, which the longest document bounds, however many documents there are.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")  # rows come in any order, and reruns must agree
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // total) if total else 0
        budget = int(round(target - passes * total))
        extra = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), budget)
        return rows[["source", "size", "n", "source_size", "target"]].assign(passes=passes, extra=extra)

    rows = counts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    return rows.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, passes long, extra long")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, copies, taken.

    copies is how often the mix takes the document, taken its words in the mix.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw"))
    sized = written(sized, "sized")
    counts = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, cap, share).select(F.col("source").alias("t_source"), "source_size", "target")
    plan = written(plan_lengths(counts, targets), "plan")
    key = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "source_size", "target", "passes", "extra")
    rows = sized.join(key, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    whole = rows.filter(~partly).withColumn("more", (F.col("extra") > 0).cast("long"))

    some = rows.filter(partly).withColumn("bucket", F.expr(f"pmod(draw, ceil(n / {RANKED_TOGETHER}))"))
    group = ["source", "size", "bucket"]
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = some.groupBy(*group).agg(F.count("*").alias("there"), F.first("extra").alias("all_extra"))
    quota = buckets.select(*[F.col(c).alias(f"q_{c}") for c in group], F.greatest(F.lit(0), F.col("all_extra") - F.coalesce(F.sum("there").over(before), F.lit(0))).alias("quota"))
    ranked = some.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("bucket") == F.col("q_bucket")))
    ranked = ranked.withColumn("more", (F.row_number().over(Window.partitionBy(*group).orderBy("draw", "doc_id")) <= F.col("quota")).cast("long"))

    cols = ["doc_id", "size", "source_size", "target", (F.col("passes") + F.col("more")).alias("copies")]
    return whole.select(*cols).unionByName(ranked.select(*cols)).withColumn("taken", F.col("copies") * F.col("size"))
