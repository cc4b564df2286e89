"""Token-ID output: documents as zstandard frames under one shared dictionary, with an offset index for single documents.

A stored corpus is a folder of Parquet files, so that any file system Spark reads will do:

* `blocks`: one row for about BLOCK_BYTES of frames. `data` is the frames end to end; `doc_ids`, `offsets` (one more
  than there are documents), `n_tokens` and `starts` (ids before the document inside its block) index it;
  `dictionary_sha256` names the dictionary. Rows are in ascending doc_id order by (shard, block).
* `index`: one row a block: its first and last doc_id and the number of ids in all blocks before it.
* `dictionary`: the dictionary's bytes, their sha256 and the width of an id (2 bytes where the vocabulary allows, else 4).

A frame holds one document's ids as little-endian unsigned integers, the end id last. The dictionary is trained on
the serialized ids of at most SAMPLE documents of at most SAMPLE_CHARS characters, those with the smallest hashes.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes first; rows with one doc_id are all
stored, next to each other in order of their frames; an empty table gives no blocks; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import per_row, scratch_path, small_batches, written

#: Documents that train the dictionary, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 400, 200_000
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 4 * 1024 * 1024
#: Words whose ids a worker remembers: about 100 MB.
REMEMBERED = 400_000


class OddSpace(Exception):
    """White space other than single spaces and newlines between other characters."""


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Ids, as little-endian 32-bit bytes, of words that follow `lead` ('' or a space). Words without a room are worked out each time."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        if not word:
            raise OddSpace
        if word.isalpha():
            ids = self.encoder.letters(self.lead + word)
        elif word[-1] in ".," and word[:-1].isalpha():
            ids = self[word[:-1]] + self.encoder.marks[word[-1]]
        elif "\n" in word:
            head, *lines = word.split("\n")
            return self.encoder.newline.join([self[head], *(self.encoder.first[x] for x in lines)])
        elif word.split() != [word]:
            raise OddSpace
        else:
            ids = self.encoder.whole(self.lead + word)
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts by the tokenizers library, word by word where words are known to be cut apart.

    The pre-tokenizer starts a new piece at a single space between two other characters, at a single newline between
    two others, and at a mark after letters, so such parts are encoded once and remembered. A text with any other white
    space is encoded in one go, as is every text where the file says that pieces are cut in another way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.byte_letters = byte_letters()
        self.first, self.later = Words(self, ""), Words(self, " ")
        self.marks = {m: self.whole(m) for m in ".,"}
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def letters(self, piece: str) -> bytes:
        """Letters, after a space or not, are one piece: the model alone encodes them."""
        written_out = piece.replace(" ", self.byte_letters[32]) if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.byte_letters)
        return packed_ids([t.id for t in self.model.tokenize(written_out)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self.whole(text)
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except OddSpace:
            return self.whole(text)


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file asks for plain byte-level BPE, cut by that method's own rule, so that words can be encoded one by one."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain_cut = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    alone = all(not t.get("lstrip") and not t.get("rstrip") and t["content"].split() == [t["content"]] and not any(map(str.isalpha, (t["content"][0], t["content"][-1]))) for t in spec.get("added_tokens") or [])
    return bool(spec.get("normalizer") is None and plain_cut and plain_model and alone)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def narrowed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes()


def widened(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")


def train_dictionary(samples: list[bytes], limit: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(limit, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-limit:]


def zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def sampled_texts(docs: DataFrame, n: int, longest: int = SAMPLE_CHARS) -> list[str | None]:
    """Texts of the rows with the n smallest hashes of id and text, the same in every run: the hashes first, then only the texts under the last of them, equal ones once. Texts of over `longest` characters are not drawn."""
    few = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= longest).select(F.xxhash64("doc_id", "text", F.lit(9)).alias("draw"), "text")
    lowest = few.select("draw").orderBy("draw").limit(n).agg(F.max("draw")).first()[0]
    if lowest is None:
        return []
    return [r[1] for r in sorted(few.filter(F.col("draw") <= lowest).dropDuplicates(["draw"]).collect(), key=lambda r: r[0])]


def store(docs: DataFrame, at: str, tokenizer: str, end_id: int) -> None:
    """Write docs(doc_id, text) to the folder `at`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width, end = id_width(tokenizer), np.array([end_id], dtype="<u4").tobytes()
    encoder = Encoder(tokenizer)
    dictionary = train_dictionary([narrowed(encoder.ids(t) + end, width) for t in sampled_texts(rows, SAMPLE)])
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary), width)], "sha256 string, dictionary binary, id_bytes int").coalesce(1).write.parquet(f"{at}/dictionary")

    def make():
        own, shared = shared_encoder(tokenizer), zstd_dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=False)

        def each(doc_id, text):
            ids = own.ids(text) + end
            return doc_id, len(ids) // 4, press.compress(narrowed(ids, width))

        return each

    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
    frames = written(rows.mapInArrow(per_row(make, out), "doc_id long, n_tokens long, frame binary"), "frames", "uncompressed")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = frames.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame").withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(blocked(name), "shard int, block int, dictionary_sha256 string, doc_ids array<long>, n_tokens array<long>, starts array<long>, offsets array<long>, data binary").write.option("compression", "uncompressed").parquet(f"{at}/blocks")

    # Ids before each block: sums inside a shard, then over the few rows that stand for whole shards.
    totals = spark.read.parquet(f"{at}/blocks").select("shard", "block", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    totals = written(totals, "totals")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = totals.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(shards, "shard")
    index.select("shard", "block", "first_doc", "last_doc", (F.col("shard_start") + F.col("inner")).alias("start")).write.parquet(f"{at}/index")


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """A Python worker serves many tasks: it keeps the encoder and the words that it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocked(dictionary_sha256: str):
    """For mapInArrow over one sorted shard: rows of `blocks`, each of about BLOCK_BYTES."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("doc_ids", longs), ("n_tokens", longs), ("starts", longs), ("offsets", longs), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shard, ids, counts, frames, held = 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int).tolist()
            values = [shard, block, dictionary_sha256, list(ids), list(counts), starts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in batches:
            for doc_id, n, frame, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B020
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield row()
                    block, ids, counts, frames, held = block + 1, [], [], [], 0
        if ids:
            yield row()

    return run


def read_dictionary(spark: SparkSession, at: str) -> tuple[bytes, int]:
    """The dictionary, checked against its hash, and the width of an id."""
    sha256, data, width = spark.read.parquet(f"{at}/dictionary").first()
    if hashlib.sha256(bytes(data)).hexdigest() != sha256:
        raise ValueError(f"the dictionary of {at} is not the one it was written with")
    return bytes(data), width


def summaries(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the frames."""
    dictionary, width = read_dictionary(spark, at)
    name = hashlib.sha256(dictionary).hexdigest()
    out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary))
        for batch in batches:
            for shard, block, sha256, ids, offsets, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha256 != name:
                    raise ValueError(f"block {block} of shard {shard} was written with another dictionary")
                rows, inner = [], 0
                for doc_id, a, b in zip(ids, offsets, offsets[1:], strict=False):
                    got = widened(unpress.decompress(data[a:b]), width)
                    rows.append((shard, block, doc_id, inner, len(got), zlib.crc32(got.tobytes())))
                    inner += len(got)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    blocks = spark.read.parquet(f"{at}/blocks").select("shard", "block", "dictionary_sha256", "doc_ids", "offsets", "data")
    rows = blocks.mapInArrow(run, "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    index = spark.read.parquet(f"{at}/index").select("shard", "block", F.col("start").alias("block_start"))
    return rows.join(index, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, at: str, doc_id: int) -> list[list[int]]:
    """Ids of the stored rows of one document: only the blocks that can hold it are read, only its frames are opened."""
    dictionary, width = read_dictionary(spark, at)
    unpress = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary))
    where = spark.read.parquet(f"{at}/index").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("shard", "block")
    blocks = spark.read.parquet(f"{at}/blocks").join(where, ["shard", "block"])
    cuts = blocks.select("shard", "block", F.explode(F.arrays_zip("doc_ids", "offsets", F.slice("offsets", 2, F.size("doc_ids")).alias("ends"))).alias("d"), "data").filter(F.col("d.doc_ids") == doc_id)
    frames = cuts.select("shard", "block", F.expr("substring(data, d.offsets + 1, d.ends - d.offsets)").alias("frame")).orderBy("shard", "block").collect()
    return [widened(unpress.decompress(bytes(r["frame"])), width).tolist() for r in frames]


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Store docs in the shared folder and return the summaries read back from there."""
    at = scratch_path(docs.sparkSession, "tokens")
    store(docs, at, tokenizer, end_id)
    return summaries(docs.sparkSession, at)
