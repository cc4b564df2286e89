"""Benchmark decontamination: a broadcast hash set of the tests' word n-grams, against which every document's windows are scanned.

A window is `n` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit. Hash hits are verified word by word, so results are exact.

The set is broadcast in blocks of about BLOCK_WINDOWS windows. A benchmark of more windows is dealt into several blocks
by Spark, each a pass over the documents, and the hits of a document are merged: neither the driver nor a broadcast
grows with the data.

Defined cases: null, empty and wordless texts have no words and no hits; null or wordless items have no windows; an
item that is there twice counts once, by its id; items without an id count as one whose id is empty; repeated document rows each get their own result; empty tables give
empty or clean results; columns other than the named ones are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from treeline.llm.common import per_row, small_batches, written

#: Windows in one broadcast: about 50 MB of ids and hashes at the most.
BLOCK_WINDOWS = 200_000

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text after A-Z are lower-cased."""
    return WORD.findall(text.translate(LOWER)) if text else []


def word_spans(text: str | None) -> list[tuple[int, int]]:
    """Where words_of(text) stand. Lower-casing A-Z moves nothing."""
    return [m.span() for m in WORD.finditer(text.translate(LOWER))] if text else []


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * MIX + ids[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


class WindowSet:
    """Windows by length, each as sorted hashes with the ids of their words and the items that hold them."""

    def __init__(self, windows: dict[tuple[str, ...], list]):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for window in windows for w in window}))}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list]]] = {}
        for n in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == n]
            ids = np.array([[self.vocabulary[x] for x in w] for w in own], dtype=np.uint64)
            hashes = np.array([rolled(row, n)[0] for row in ids], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = hashes[order], ids[order], [windows[own[i]] for i in order]

    def hits(self, words: list[str]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        items: set = set()
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), dtype=np.uint64, count=len(words))
        for n, (hashes, rows, owners) in self.by_length.items():
            got = rolled(ids, n)
            lo = np.searchsorted(hashes, got, "left")
            for at in np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == got)):
                k = lo[at]
                while k < len(hashes) and hashes[k] == got[at]:
                    if (rows[k] == ids[at : at + n]).all():
                        covered[at] += 1
                        covered[at + n] -= 1
                        items.update(owners[k])
                    k += 1
        return np.cumsum(covered[:-1]) > 0, items


def benchmark_windows(benchmark: DataFrame, n: int, limit: int) -> DataFrame:
    """Written rows window, item, block: each item's distinct windows, words joined by spaces, dealt by hash into blocks of about limit rows."""
    out = pa.schema([("window", pa.string()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                found = sorted({" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}) if words else []
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([item] * len(part), pa.string())], schema=out)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    found = written(items.mapInArrow(run, "window string, item string").distinct(), "windows")
    blocks = max(1, -(-found.count() // limit))
    return written(found.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)).cast("int")).repartition("block"), "window-blocks") if blocks > 1 else found.withColumn("block", F.lit(0))


def window_set(rows: DataFrame) -> WindowSet:
    """One block's windows."""
    windows: dict[tuple[str, ...], list] = {}
    known: dict[str, str] = {}
    for window, item in rows.select("window", "item").toLocalIterator():
        windows.setdefault(tuple(known.setdefault(w, w) for w in window.split(" ")), []).append(item)
    return WindowSet(windows)


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RUNS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Finish:
    """A function of find_hits' values, and the columns before the carried ones that it gives."""

    each: Callable[..., tuple]
    fields: tuple[pa.Field, ...]
    schema: str


def carried(docs: DataFrame, carry: Sequence[str]) -> tuple[list[pa.Field], str]:
    """The carried columns as Arrow fields and as the end of a schema string."""
    fields = [docs.schema[c] for c in carry]
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields], "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)


def found_by(windows: WindowSet, text: str | None) -> tuple[int, list[dict], list[str]]:
    words = words_of(text)
    hit, items = windows.hits(words)
    return len(words), [{"start": a, "end": b} for a, b in runs_of(hit)], sorted(items)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS, carry: Sequence[str] = (), finish: Finish | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n_words, runs array<struct<start, end>> of hit words, items array<string>, and the carried columns.

    finish, where given, makes other columns of these values in the same pass over a row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    more, kinds = carried(docs, carry)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("runs", RUN), ("items", pa.list_(pa.string())), *more])
    schema = f"doc_id long, text string, n_words long, runs {RUNS}, items array<string>{kinds}"
    last = finish.each if finish else lambda *row: row
    if finish:
        out, schema = pa.schema([*finish.fields, *more]), finish.schema + kinds
    windows = benchmark_windows(benchmark, n, block_windows)
    blocks = windows.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    if blocks == 1:
        shared = spark.sparkContext.broadcast(window_set(windows))

        def make():
            own = shared.value
            return lambda doc_id, text, *rest: last(doc_id, text, *found_by(own, text), *rest)

        return rows.mapInArrow(per_row(make, out), schema)

    # Several passes over rows that are written once, so that a row is the same row in each. The driver and the
    # executors hold one block at a time.
    keyed = written(rows.withColumn("row", F.monotonically_increasing_id()), "leak-rows")
    some = pa.schema([("row", pa.int64()), ("runs", RUN), ("items", pa.list_(pa.string()))])
    found = None
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(window_set(windows.filter(F.col("block") == block)))

        def make_part(shared=shared):
            own = shared.value
            return lambda row, text: (row, *found_by(own, text)[1:])

        part = written(keyed.select("row", "text").mapInArrow(per_row(make_part, some), f"row long, runs {RUNS}, items array<string>").filter(F.size("runs") > 0), "block-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def make_merge():
        def each(doc_id, text, runs, items, *rest):
            hit = np.zeros(len(words_of(text)), dtype=bool)
            for r in runs or []:
                hit[r["start"] : r["end"]] = True
            return last(doc_id, text, len(hit), [{"start": a, "end": b} for a, b in runs_of(hit)], items or [], *rest)

        return each

    return keyed.join(merged, "row", "left").select("doc_id", "text", "runs", "items", *carry).mapInArrow(per_row(make_merge, out), schema)


def judged(hits: DataFrame) -> DataFrame:
    """find_hits' rows without texts: n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "runs", "items",
    )


def cleaned_text(text: str | None, runs: list) -> str | None:
    """The text without the hit words and what stands between them."""
    if not text or not runs:
        return text
    spans, kept, at = word_spans(text), [], 0
    for r in runs:
        kept.append(text[at : spans[r["start"]][0]])
        at = spans[r["end"] - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, dropped, and the carried columns.

    Spans of benchmark windows are cut from the text. A document with over drop_share of its words hit is marked dropped.
    """
    def each(doc_id, text, n_words, runs, items, *rest):
        hit = sum(r["end"] - r["start"] for r in runs)
        return doc_id, cleaned_text(text, runs), hit > drop_share * max(1, n_words), *rest

    fields = (pa.field("doc_id", pa.int64()), pa.field("text", pa.string()), pa.field("dropped", pa.bool_()))
    return find_hits(docs, benchmark, n, carry=carry, finish=Finish(each, fields, "doc_id long, text string, dropped boolean"))
