"""Vector search: batched matrix products in tasks, bounded top-k per query, and hydration."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.common import cut, small_batches, spread

#: Values in one block of vectors, 2 MB, blocks of queries that are broadcast, 64 MB at most, and scores that a task works out at once, 4 MB.
BLOCK_VALUES, BROADCAST_BLOCKS, SCORES = 250_000, 32, 500_000
LEAST_NORM = 1e-10
#: Hits that a task holds before it hands them on, 48 MB at most.
HELD = 2_000_000
#: What scores of a matrix product may be off by.
SLACK = 1e-9


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, norms at least 1e-10."""
    wide = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: wide(p) * wide(q)), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(LEAST_NORM))
    return dot(a, b) / (norm(a) * norm(b))


def assert_dimension(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """The vectors; a row of another dimension fails the job that reads it."""
    right = F.assert_true(F.size(vec) == dim, F.lit(f"vector is not of dimension {dim}"))
    return vectors.filter(F.coalesce(right.cast("string"), F.lit("")) == "")


def blocks_of(rows: DataFrame, key: str, most: int = BLOCK_VALUES) -> DataFrame:
    """rows(key long, vec) -> dim, keys, units: vectors of unit length, packed by dimension in blocks of at most `most` values, a vector at least.

    Vectors that are null, empty or hold a null or no number are left out.
    """
    whole = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    out = pa.schema([("dim", pa.int32()), ("keys", pa.list_(pa.int64())), ("units", pa.binary())])

    def block(dim: int, keys: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        units = np.concatenate(parts)
        units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), LEAST_NORM)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(keys)], pa.list_(pa.int64())), pa.array([units.tobytes()])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy()
            values, ends = batch.column("vec").flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
            keys = batch.column(key).to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                rows = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                lo, full = 0, max(1, most // dim)
                while lo < len(at):
                    own = held.setdefault(dim, ([], []))
                    hi = lo + full - sum(map(len, own[0]))
                    own[0].append(keys[at[lo:hi]])
                    own[1].append(rows[lo:hi])
                    if sum(map(len, own[0])) == full:
                        yield block(dim, *held.pop(dim))
                    lo = hi
        for dim, own in held.items():
            yield block(dim, *own)

    small_batches(rows.sparkSession)
    return rows.select(F.col(key).cast("long").alias(key), "vec").filter(whole).mapInArrow(run, "dim int, keys array<long>, units binary")


HIT = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def paired(units: np.ndarray, asked: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores pair by pair. Equal vectors have equal ones here, whatever block they are in, which a matrix product does not promise."""
    out = np.empty(len(row))
    for lo in range(0, len(row), 8192):
        out[lo : lo + 8192] = (units[col[lo : lo + 8192]] * asked[row[lo : lo + 8192]]).sum(axis=1)
    return out


def firsts(row: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row are, ties by own, no number last, in that order."""
    order = np.lexsort((own, np.where(np.isnan(scores), np.inf, -scores), row))
    ordered = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def likely(alike: np.ndarray, k: int, floor: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that may be among a row's k best and not below its floor, of single precision scores that are off by at most `slack`.

    Columns are put in groups, and only groups whose maximum may do are looked into.
    """
    n = alike.shape[1]
    groups = min(n, max(512, 4 * k))
    even = n // groups * groups
    most = alike[:, :groups].copy()
    for lo in range(groups, even, groups):
        np.maximum(most, alike[:, lo : lo + groups], out=most)
    least = floor - slack
    if np.isneginf(least).any():
        # The k-th best of the maxima of at least k groups is no better than the k-th best of all.
        least = np.maximum(least, np.partition(most, groups - k, axis=1)[:, groups - k] - 2 * slack)
    least = least.astype(np.float32)[:, None]
    rows, group = np.nonzero(most >= least)
    at, place = np.nonzero(alike[rows[:, None], group[:, None] + np.arange(0, even, groups)] >= least[rows])
    rest, col = np.nonzero(alike[:, even:] >= least)
    return np.concatenate([rows[at], rest]), np.concatenate([place * groups + group[at], even + col])


def best_of(units: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of asked, rows of units and scores of the k best of each of asked, ties by own, in that order. Only what may be among them is scored pair by pair and sorted.

    floor: for each of asked a score; what is below it may be left out. At most about SCORES scores are worked out at once, in single
    precision, whose error for vectors of these lengths is bounded, unless some are no numbers.
    """
    floor = np.full(len(asked), -np.inf) if floor is None else floor
    scale = max(np.linalg.norm(units, axis=1).max(), 1.0) * max(np.linalg.norm(asked, axis=1).max(), 1.0) if not (np.isnan(units).any() or np.isnan(asked).any()) else np.inf
    slack = (units.shape[1] + 8) * 2.0**-23 * scale
    single = units.astype(np.float32).T if scale < 1e30 else None
    step, parts = max(1, SCORES // max(1, len(units))), []
    alike = np.empty((min(step, len(asked)), len(units)), dtype=np.float32)
    for lo in range(0, len(asked), step):
        some = asked[lo : lo + step]
        if k >= len(units):
            row, col = (x.ravel() for x in np.indices((len(some), len(units))))
        elif single is not None:
            row, col = likely(np.matmul(some.astype(np.float32), single, out=alike[: len(some)]), k, floor[lo : lo + step], slack)
        else:
            worse = -(some @ units.T)
            worse[np.isnan(worse)] = np.inf
            row, col = np.nonzero(worse <= np.partition(worse, k - 1, axis=1)[:, k - 1 : k] + SLACK)
        scores = paired(units, some, row, col)
        first = firsts(row, own[col], scores, k)
        parts.append((lo + row[first], col[first], scores[first]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def met(pairs: DataFrame, k: int) -> DataFrame:
    """pairs(dim, keys, units, qkeys, qunits) of blocks -> qid, id, score: the k best of each query among all that its block meets in a task.

    Where a block of queries meets one more block, only what is no worse than its k-th hits so far is looked at. A task that holds
    over HELD hits hands them on and begins anew, so a query may have more than k.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, ...]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for qids, row, ids, scores, _ in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(scores)], schema=HIT)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                dim, keys, units, qkeys, qunits = (c[i] for c in batch.columns)
                own, qids = keys.values.to_numpy(), qkeys.values.to_numpy()
                rows, asked = (np.frombuffer(x.as_buffer()).reshape(-1, dim.as_py()) for x in (units, qunits))
                name = hashlib.sha256(qids.tobytes()).digest()
                if name not in held:
                    none = np.zeros(0, dtype=np.int64)
                    held[name] = (qids.copy(), none, none, np.zeros(0), np.full(len(qids), -np.inf))
                qids, row, ids, scores, floor = held[name]
                new, col, alike = best_of(rows, asked, own, k, floor)
                if len(new):
                    moved = np.zeros(len(qids), dtype=bool)
                    moved[new] = True
                    kept = ~moved[row]
                    both = [np.concatenate(x) for x in ((row[~kept], new), (ids[~kept], own[col]), (scores[~kept], alike))]
                    both = [x[firsts(*both, k)] for x in both]
                    last = np.flatnonzero(np.arange(len(both[0])) - np.searchsorted(both[0], both[0]) == k - 1)
                    floor[both[0][last]] = np.where(np.isnan(both[2][last]), -np.inf, both[2][last])
                    held[name] = (qids, *(np.concatenate(x) for x in zip((row[kept], ids[kept], scores[kept]), both, strict=True)), floor)
                if sum(len(x[1]) for x in held.values()) > HELD:
                    yield from handed()
        yield from handed()

    small_batches(pairs.sparkSession)
    return pairs.select("dim", "keys", "units", "qkeys", "qunits").mapInArrow(best, "qid long, id long, score double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank, ties by id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_copies(vectors: DataFrame, k: int) -> DataFrame:
    """vectors(id, vec) with the k least ids of equal vectors: copies beyond them are among no query's k best, as they tie and ties go by id."""
    return vectors.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= k).drop("n")


def topk_of_few(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As topk, where many vectors are copies: if up to BROADCAST_BLOCKS blocks are left without them, those go to every task and the queries are dealt."""
    left = cut(first_copies(vectors.select("id", "vec"), k))
    own = cut(blocks_of(left, "id"))
    if own.limit(BROADCAST_BLOCKS + 1).count() > BROADCAST_BLOCKS:
        return topk(left, queries, k)
    asked = blocks_of(spread(queries.select("qid", "vec"), "qid"), "qid").withColumnsRenamed({"keys": "qkeys", "units": "qunits"})
    return ranked(met(asked.join(F.broadcast(own), "dim"), k), k)


def topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors(id long, vec), queries(qid long, vec) -> qid, id, score, rank: the k most alike by cosine, ties by id.

    Both sides are packed into blocks in tasks, and blocks of one dimension meet: up to BROADCAST_BLOCKS blocks of
    queries go to every task, more are met partition by partition. Of all that a task's matrix products give,
    each query's k best go on, so one small shuffle on qid finishes. Every query meets every vector: for many queries
    there are the lists of operators.inverted.
    """
    asked = cut(blocks_of(queries, "qid")).withColumnsRenamed({"keys": "qkeys", "units": "qunits"})
    few = asked.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    dealt = blocks_of(spread(vectors.select("id", "vec"), "id"), "id")
    return ranked(met(dealt.join(F.broadcast(asked), "dim") if few else cut(dealt).join(asked.hint("shuffle_replicate_nl"), "dim"), k), k)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """The best score of each (qid, id)."""
    return hits.groupBy("qid", "id").agg(F.max("score").alias("score"))


def hydrate(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Hits with their rows of table; the few hits are the side to ship."""
    return table.join(hits, "id")


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those of their ids."""
    return vectors.join(new.select("repo", "id", "owner"), ["repo", "id", "owner"], "left_anti").unionByName(new)


def remove_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, ["repo", "id"], "left_anti")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding service: signed word hashes, unit length."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        words = [(text or "").lower().split() for text in texts]
        h = np.array([zlib.crc32(word.encode("utf-8")) for own in words for word in own], dtype=np.int64)
        at = np.repeat(np.arange(len(texts)) * dim, [len(own) for own in words]) + h % dim
        rows = np.bincount(at, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * dim).reshape(-1, dim)
        return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), LEAST_NORM)).tolist()

    return embed


def embed(rows: DataFrame, embed_texts: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32, chars: int | None = 1000) -> DataFrame:
    """rows(repo, id, owner, text) -> repo, id, owner, vec, dim. Texts are cut to `chars`, unless that is None, dealt over tasks and sent in batches."""
    make = embed_texts or hashing_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                rows = part.slice(lo, batch)
                vecs = make([(t or "")[:chars] for t in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("repo", "id", "owner")), pa.array(vecs, pa.list_(pa.float32())), pa.array([len(v) for v in vecs], pa.int32())], names=["repo", "id", "owner", "vec", "dim"])

    small_batches(rows.sparkSession)
    return spread(rows.select("repo", "id", "owner", "text"), "repo", "id", "owner").mapInArrow(run, "repo string, id string, owner string, vec array<float>, dim int")
