"""Substring dedup by seed and extend: every run of THRESHOLD words that starts earlier in the corpus is found and cut.

Seeds are winnowed anchors. Each window of THRESHOLD words picks, of the k-grams in it, the one with the smallest hash
(the rightmost of equals), so equal windows pick equal anchors at equal offsets, and only about two in w + 1 positions
are anchors. Documents meet on their anchors; an anchor that occurs once is dropped.

A surviving anchor is extended both ways as far as the windows that picked it reach, and goes, with these windows'
hashes, to the task that holds its other occurrences; there each window is kept where it is first and marked where
it repeats. The repeats found in a document are joined to maximal ones and cut. Whole copies of a text are told by the
text's hash and are not extended: all their windows repeat the first copy's.

No pairs are made: a group only has to know its first member. Anchors that are frequent by a table of counters need no
counting and are dealt into salted groups whose first members meet once more. A window is told by 128 bits, its
anchor's hash and its own, so that unequal runs are not taken for equal ones at any size.

Defined cases: null, empty and short texts have no windows and stay; where doc_ids repeat or are null, rows rank by
doc_id (null first), then text, so of equal rows the first stays; an empty table gives an empty result; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import keyed, packed, per_row, rolled, small_batches, steps, with_ids, word_count, word_hashes, written
from treeline.llm.counters import BITS, Counters, bucket_of, summed

THRESHOLD = 20
ANCHOR = 10
#: An anchor of more occurrences than this is salted into groups of about so many.
TOGETHER = 500


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Seeds:
    """Anchors and windows of texts, worked out for many texts at once: arrays run over all their words, end to end."""

    def __init__(self, threshold: int = THRESHOLD, anchor: int = ANCHOR):
        self.threshold, self.anchor = threshold, anchor

    def of(self, texts: list[bytes]) -> Batch:
        h, offsets = word_hashes(texts)
        grams = rolled(h, self.anchor)
        n = max(0, len(h) - self.threshold + 1)
        least, shift = grams[:n].copy(), np.zeros(n, dtype=np.int64)
        for k in range(1, self.threshold - self.anchor + 1):
            lower = grams[k : k + n] <= least
            np.copyto(least, grams[k : k + n], where=lower)
            shift[lower] = k
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(h))  # words from here to the text's end
        starts = np.flatnonzero(left >= self.threshold)
        return Batch(h, offsets, grams, starts, starts + shift[starts])


@dataclass
class Batch:
    """hashes of words, beginnings of texts, hashes of k-grams; starts of windows and the places of the anchors that they pick."""

    hashes: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    picked: np.ndarray

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1


def salts(groups: np.ndarray, seeds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """0 for most anchors; for a frequent one, which of its groups, from 1 on, the document falls in. groups: by bucket, 0 for none."""
    many = groups[bucket_of(seeds, len(groups).bit_length() - 1)].astype(np.int64)
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    return np.where(many > 0, 1 + mixed % np.maximum(many, 1), 0).astype(np.int32)


def frequent(rows: DataFrame, threshold: int, anchor: int, together: int, bits: int) -> np.ndarray:
    """By bucket, the number of groups to deal an anchor into where anchors are frequent, else 0: at most 2 bytes a bucket. It steers work only, never results."""
    out = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        seeds, counters = Seeds(threshold, anchor), Counters(bits)
        for batch in batches:
            for lo, size in steps(batch.column("text")):
                got = seeds.of(utf8(batch.column("text").slice(lo, size).to_pylist()))
                counters.add(got.grams[got.picked[np.diff(got.picked, prepend=-1) != 0]])
        for part, n, counts in counters.parts():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([counts])], schema=out)

    def groups(sums: np.ndarray, mean: float) -> np.ndarray:
        return np.where(sums > together + 4 * mean, np.minimum(-(-sums // np.uint64(together)), 65535), 0)

    return summed(written(rows.select("text").mapInArrow(run, "part int, n long, counts binary"), "anchor-counts"), bits, groups, np.uint16)


def anchors(rows: DataFrame, hot: Broadcast, threshold: int, anchor: int) -> DataFrame:
    """key, text -> one row an anchor: anchor hash (null for a frequent one, which needs no counting), key, place."""
    out = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("place", pa.int32())])

    def run(batches):
        seeds, groups = Seeds(threshold, anchor), hot.value
        for batch in batches:
            for lo, size in steps(batch.column("text")):
                part = batch.slice(lo, size)
                got = seeds.of(utf8(part.column("text").to_pylist()))
                at = got.picked[np.diff(got.picked, prepend=-1) != 0]
                text, found = got.text_of(at), got.grams[at]
                often = groups[bucket_of(found, len(groups).bit_length() - 1)] > 0
                columns = [pa.array(signed(found), mask=often), pa.array(part.column("key").to_numpy()[text]), pa.array((at - got.offsets[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.select("key", "text").mapInArrow(run, "anchor long, key long, place int")


def extensions(texts: DataFrame, hot: Broadcast, threshold: int, anchor: int) -> DataFrame:
    """key, packed, places -> one row a surviving anchor: its hash, salt, key, first window and the hashes of all windows that picked it."""
    out = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("base", pa.int32()), ("windows", pa.list_(pa.int64()))])

    def run(batches):
        seeds, unpress, groups = Seeds(threshold, anchor), zstandard.ZstdDecompressor(), hot.value
        for batch in batches:
            for lo, size in steps(batch.column("packed"), 400_000):
                part = batch.slice(lo, size)
                got = seeds.of([unpress.decompress(d) for d in part.column("packed").to_pylist()])
                lists = part.column("places")
                text = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                places = lists.flatten().to_numpy() + got.offsets[text]
                keys, found = part.column("key").to_numpy()[text], got.grams[places]
                first, last = np.searchsorted(got.picked, places, "left"), np.searchsorted(got.picked, places, "right")
                inside = np.zeros(len(got.picked) + 1, dtype=np.int64)
                inside[first] += 1
                inside[last] -= 1
                windows = signed(rolled(got.hashes, threshold, 0xC2B2AE3D27D4EB4F))[got.starts[np.cumsum(inside[:-1]) > 0]]
                base = (got.starts[first] - got.offsets[text]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(salts(groups, found, keys)), pa.array(keys), pa.array(base), pa.ListArray.from_arrays(pa.array(ends), pa.array(windows))], schema=out)

    return texts.mapInArrow(run, "anchor long, salt int, key long, base int, windows array<long>")


def later_windows(runs: DataFrame) -> DataFrame:
    """extensions' rows -> key, start of every window that is not the first of its kind.

    Rows are dealt by anchor and salt once, as runs; their windows are unfolded and ranked where they lie. The first
    windows of salted groups are ranked once more among themselves.
    """
    each = runs.repartition("anchor", "salt").select("anchor", "salt", "key", "base", F.posexplode("windows").alias("step", "window"))
    each = each.select("anchor", "salt", "window", "key", (F.col("base") + F.col("step")).alias("start"))
    ranked = each.withColumn("nth", F.row_number().over(Window.partitionBy("anchor", "salt", "window").orderBy("key", "start")))
    ranked = ranked.filter("nth > 1 or salt > 0")
    again = ranked.filter("nth = 1").withColumn("nth", F.row_number().over(Window.partitionBy("anchor", "window").orderBy("key", "start")))
    return ranked.filter("nth > 1").select("key", "start").unionByName(again.filter("nth > 1").select("key", "start"))


def copies(rows: DataFrame, threshold: int) -> DataFrame:
    """key of texts of at least threshold words that an earlier row holds whole."""
    digest = F.sha2("text", 256)
    named = written(rows.filter(word_count(F.col("text")) >= threshold).select("key", digest.alias("digest")), "digests")
    # Written, so that the join meets two plain tables and can split the copies of a frequent text.
    first = written(named.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first-copies")
    return named.join(first, "digest").filter("key != first").select("key")


def repeats(rows: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, together: int = TOGETHER, bits: int = BITS) -> DataFrame:
    """key, text -> key, starts, copy: starts of windows that begin earlier somewhere, or that the whole text is a copy."""
    small_batches(rows.sparkSession)
    hot = rows.sparkSession.sparkContext.broadcast(frequent(rows, threshold, anchor, together, bits))
    again = written(copies(rows, threshold).withColumn("copy", F.lit(True)), "copies")
    found = anchors(rows, hot, threshold, anchor)
    counted = found.filter("anchor is not null").withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1").select("key", "place")
    alive = counted.unionByName(found.filter("anchor is null").select("key", "place"))
    places = alive.join(again, "key", "left_anti").groupBy("key").agg(F.collect_list("place").alias("places"))
    texts = packed(rows).join(places.withColumn("places", F.array_sort("places")), "key").select("key", "packed", "places")
    starts = later_windows(extensions(texts, hot, threshold, anchor)).groupBy("key").agg(F.collect_list("start").alias("starts"))
    return starts.withColumn("copy", F.lit(False)).unionByName(again.select("key", F.array().cast("array<int>").alias("starts"), "copy"))


def covered(n: int, starts: list[int] | None, threshold: int) -> np.ndarray:
    """Which of n words the windows at starts cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if starts:
        np.add.at(edge, np.array(starts), 1)
        np.add.at(edge, np.array(starts) + threshold, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, texts: bool = True, together: int = TOGETHER, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the text's remaining words, one space between. together and bits steer the work and never the result."""
    rows, same = keyed(docs)
    found = repeats(rows, threshold, anchor, together, bits)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if texts else [])])

    def make():
        unpress = zstandard.ZstdDecompressor()

        def each(doc_id, data, starts, copy):
            words = unpress.decompress(data).split()
            gone = np.ones(len(words), dtype=bool) if copy else covered(len(words), starts, threshold)
            kept = b" ".join(itertools.compress(words, (~gone).tolist()))
            return (doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if texts else []))

        return each

    joined = with_ids(packed(rows).join(found, "key", "left"), rows, same)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    return joined.select("doc_id", "packed", "starts", "copy").mapInArrow(per_row(make, out), kinds)
