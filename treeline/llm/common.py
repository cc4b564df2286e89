"""What the corpus operators share: the cluster's scratch folder, cut points and regular expressions."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space, as Java and as Python write the class.
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"


#: What one Arrow batch holds at most, in rows and bytes, and what one step of numpy work on texts does, in bytes.
BATCH_ROWS, BATCH_BYTES, STEP_BYTES = 1000, 8 << 20, 1 << 20

#: Texts are wide: small row groups keep what a writing task buffers small.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir. Only in local mode, where all is one process, it may be unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts bounded by bytes; settings that ask for less already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/treeline-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives lost executors."""
    at = scratch_path(df.sparkSession, what)
    small_batches(df.sparkSession)
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def first_features(rows: DataFrame, most: int, what: str) -> DataFrame:
    """Sampled rows(draw, at, ...) in the order of their draws, until the features in `at` are over `most` in all; rows of one draw go together.

    rows are a sample of bounded length, so their draws and sizes may go to the driver; `most` bounds what follows them.
    """
    rows = written(rows, what)
    sizes = rows.select("draw", F.size("at").alias("n")).toArrow().sort_by("draw")
    total = np.cumsum(sizes["n"].to_numpy())
    over = int(np.searchsorted(total, most, side="right"))
    return rows if over == len(total) else rows.filter(F.col("draw") < F.lit(sizes["draw"][over].as_py()))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def steps(column: pa.Array, most: int = STEP_BYTES, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Cuts a string or binary column into runs (first, length) of about `most` bytes, of one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (total + n > most or i - lo >= rows):
            yield lo, i - lo
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes) - lo


def per_row(make: Callable[[], Callable[..., tuple]], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: make() is called once a task and gives a function from a row's values to a row of out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
            widest = max(wide, key=lambda c: c.nbytes, default=None)
            for lo, n in steps(widest) if widest is not None else ((lo, 512) for lo in range(0, batch.num_rows, 512)):
                part = batch.slice(lo, n)
                rows = [each(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return run


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and a unique long `key` in the order of doc_id, null first; and whether the key is doc_id itself.

    Where ids repeat or are null, rows are ranged and sorted by doc_id and text, numbered and written once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return rows.withColumn("key", F.col("doc_id")), True
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = F.col("doc_id").asc_nulls_first()
    ranged = rows.repartitionByRange(n, by).sortWithinPartitions(by, F.col("text").asc_nulls_first())
    return written(ranged.withColumn("key", F.monotonically_increasing_id()), "keyed"), False


def with_ids(results: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """results by key with their doc_id: rows and same are what keyed() gave."""
    return results.withColumn("doc_id", F.col("key")) if same else results.join(rows.select("key", "doc_id"), "key")


def packed(rows: DataFrame) -> DataFrame:
    """key and text -> key and the text's compressed UTF-8 bytes (null: empty), so that a shuffle of texts stays small."""
    out = pa.schema([("key", pa.int64()), ("packed", pa.binary())])

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def each(key, text):
            return key, press.compress((text or "").encode("utf-8", "surrogatepass"))

        return each

    return rows.select("key", "text").mapInArrow(per_row(make, out), "key long, packed binary")


#: White space of ASCII, by byte; random odd factors for the place of a byte in a word.
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FACTORS = np.random.default_rng(64).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, and their hashes."""
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    values = (data[first:].astype(np.uint64) + np.uint64(1)) * FACTORS[place & 4095]
    if place.max() >= 4096:  # in long words the factors repeat, each time times another one
        values *= np.where(place >= 4096, FACTORS[(place >> 12) & 4095], np.uint64(1))
    values[space[first:]] = 0
    h = np.add.reduceat(values, starts - first)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return starts, h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, between ASCII white space, of all texts end to end, and where each text begins, with the end of the last.

    Bytes are worked on in pieces of about STEP_BYTES that end with white space, so that a very long text takes no
    more room for its bytes than others.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    starts, hashes, lo = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], 0
    while lo < len(data):
        hi = lo + STEP_BYTES
        while hi < len(data) and not (stop := IS_SPACE[data[hi : hi + 4096]]).any():
            hi += 4096
        hi = hi + int(stop.argmax()) + 1 if hi < len(data) else len(data)
        at, h = piece_hashes(data[lo:hi])
        starts.append(at + lo)
        hashes.append(h)
        lo = hi
    at = np.fromiter(itertools.accumulate((len(t) + 1 for t in texts), initial=0), dtype=np.int64, count=len(texts) + 1)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def rolled(values: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of n values."""
    out = np.zeros(max(0, len(values) - n + 1), dtype=np.uint64)
    by = np.uint64(factor)
    for k in range(n):
        out = out * by + values[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out
