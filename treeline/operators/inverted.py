"""Inverted lists of vectors: k-means centroids, every vector in the list of its nearest one, queries sent to near lists.

Centroids are trained by Spark on a sample of about SAMPLE vectors, chosen by a hash of their ids, and every vector of
the table is listed. A list is rows of (cell, keys, units): blocks of at most vectors.BLOCK_VALUES values, so that a
list of any length is many small rows. A search sends each query to the lists of its nearest centroids and meets them by
equality of cell. How many lists that are is found by measuring recall on a sample of queries against all vectors.

An exact search goes on: a list's radius and the query's angle to its centroid bound how near any of its vectors can be,
and each query goes to those further lists that may hold something better than its k-th hit. Its result is that of
vectors.topk. Where vectors lie in clusters few lists are left over; where they fill space evenly most are, and then
an exact search costs what topk costs.

The driver holds the centroids, at most CELLS times the dimension, and sizes of lists. One index holds vectors of one
dimension; vectors and queries of another, and those that are null, empty or hold a null or no number, are in no list and find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import vectors as vecs
from treeline.operators.common import cut

#: Vectors, about, on which centroids are trained; queries, about, by which recall is measured; rounds of k-means; centroids at most.
SAMPLE, ASKED, ROUNDS, CELLS = 50_000, 200, 6, 4096

#: Recall at K that a search reaches at least on the sampled queries.
RECALL, K = 0.95, 10

#: What bounds may be off by, as cosines are sums of rounded products.
SLACK = 1e-9

UNIT = pa.schema([("cell", pa.int32()), ("key", pa.int64()), ("unit", pa.binary()), ("alike", pa.float64())])


@dataclass(frozen=True)
class Index:
    """centroids: unit vectors, a row a cell; alike: the least cosine of a cell's vectors with its centroid; sizes: vectors in each cell."""

    lists: DataFrame
    centroids: np.ndarray
    alike: np.ndarray
    sizes: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of blocks(dim, keys, units), block by block."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, keys, units = (batch.column(c)[i] for c in ("dim", "keys", "units"))
            yield keys.values.to_numpy(), np.frombuffer(units.as_buffer()).reshape(-1, dim.as_py())


def nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell and its cosine with the centroid."""
    cells, alike = np.zeros(len(units), dtype=np.int32), np.zeros(len(units))
    for lo in range(0, len(units), 1024):
        scores = units[lo : lo + 1024] @ centroids.T
        cells[lo : lo + 1024] = scores.argmax(axis=1)
        alike[lo : lo + 1024] = scores.max(axis=1)
    return cells, alike


def trained(sample: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over sample(dim, keys, units), blocks that are written: unit centroids. A cell that loses all its vectors keeps its place."""
    out = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("total", pa.binary())])
    schema = "cell int, n long, total binary"

    def first(batches):
        for keys, units in units_of(batches):
            draw = ((keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            order = np.argsort(draw, kind="stable")[:cells]
            yield pa.RecordBatch.from_arrays([pa.array(draw[order].astype(np.int64)), pa.array([units[i].tobytes() for i in order], pa.binary())], names=["draw", "unit"])

    seeds = sample.mapInArrow(first, "draw long, unit binary").groupBy("unit").agg(F.min("draw").alias("draw")).orderBy("draw", "unit").limit(cells).collect()
    centroids = np.array([np.frombuffer(r["unit"]) for r in seeds])

    def added(batches):
        """Sums of the totals of each cell."""
        sums: dict[int, list] = {}
        for batch in batches:
            for cell, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(cell, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(total)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())], schema=out)

    for _ in range(rounds):
        at = centroids

        def dealt(batches, at=at):
            count, total = np.zeros(len(at), dtype=np.int64), np.zeros(at.shape)
            for _, units in units_of(batches):
                cell, _ = nearest(units, at)
                count += np.bincount(cell, minlength=len(at))
                np.add.at(total, cell, units)
            there = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array([total[c].tobytes() for c in there], pa.binary())], schema=out)

        moved = centroids.copy()
        for r in sample.mapInArrow(dealt, schema).repartition("cell").mapInArrow(added, schema).toLocalIterator():
            mean = np.frombuffer(r["total"])
            if np.linalg.norm(mean) > vecs.LEAST_NORM:
                moved[r["cell"]] = mean / np.linalg.norm(mean)
        if np.abs(moved - centroids).max() < 1e-6:
            break
        centroids = moved
    return centroids


def packed(rows: DataFrame, dim: int, most: int = vecs.BLOCK_VALUES) -> DataFrame:
    """rows(cell, key, unit), a cell's rows next to each other in a partition -> cell, dim, keys, units in blocks."""
    out = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("keys", pa.list_(pa.int64())), ("units", pa.binary())])

    def run(batches):
        cell, keys, units = None, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([dim], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([b"".join(units)])], schema=out)

        for batch in batches:
            for c, key, unit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if keys and (c != cell or len(keys) * dim >= most):
                    yield block()
                    keys, units = [], []
                cell = c
                keys.append(key)
                units.append(unit)
        if keys:
            yield block()

    return rows.select("cell", "key", "unit").mapInArrow(run, "cell int, dim int, keys array<long>, units binary")


def built(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = K) -> Index | None:
    """vectors(id long, vec) -> their index, None where there is no vector to list. cells: about the square root of the number of vectors by default."""
    blocks = cut(vecs.blocks_of(vectors, "id"))
    sizes = blocks.groupBy("dim").agg(F.sum(F.size("keys")).alias("n")).agg(F.max(F.struct("n", "dim"))).first()[0]
    if not sizes:
        return None
    n, dim = sizes["n"], sizes["dim"]
    cells = cells or max(1, min(CELLS, math.isqrt(n)))
    blocks = blocks.filter(F.col("dim") == dim)

    def chosen(about: int, seed: int) -> DataFrame:
        rows = vectors.filter(F.size("vec") == dim).filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n // about))) == 0)
        return rows

    centroids = trained(cut(vecs.blocks_of(chosen(sample, 1), "id")) if n > sample else blocks, cells)

    def assigned(batches):
        for keys, units in units_of(batches):
            cell, alike = nearest(units, centroids)
            for lo in range(0, len(keys), 4096):
                part = slice(lo, lo + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part]), pa.array(keys[part]), pa.array([u.tobytes() for u in units[part]], pa.binary()), pa.array(alike[part])], schema=UNIT)

    rows = cut(blocks.mapInArrow(assigned, "cell int, key long, unit binary, alike double"))
    # Ranges of (cell, key): a list that is long is several partitions.
    lists = cut(packed(rows.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key"), dim))
    alike, count = np.ones(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.min("alike").alias("alike"), F.count("*").alias("n")).toLocalIterator():
        alike[r["cell"]], count[r["cell"]] = r["alike"], r["n"]
    index = Index(lists, centroids, alike, count, len(centroids))
    probes = measured(index, vectors, chosen(ASKED, 2), rows.select(F.col("key").alias("id"), "cell"), recall, k)
    return Index(lists, centroids, alike, count, probes)


def measured(index: Index, vectors: DataFrame, asked: DataFrame, cell_of: DataFrame, recall: float, k: int) -> int:
    """The fewest lists by which the sampled queries find `recall` of their k nearest vectors."""
    asked = cut(asked.select(F.col("id").alias("qid"), "vec"))
    truth = vecs.topk(vectors, asked, k).select("qid", "id").join(cell_of, "id").groupBy("qid").agg(F.collect_list("cell").alias("cells"))
    ranks: list[int] = []
    for r in truth.join(asked, "qid").select("vec", "cells").toLocalIterator():
        order = np.argsort(-(index.centroids @ np.array(r["vec"], dtype=float)), kind="stable")
        place = np.empty(len(order), dtype=int)
        place[order] = np.arange(len(order))
        ranks += place[r["cells"]].tolist()
    return int(np.sort(ranks)[math.ceil(recall * len(ranks)) - 1]) + 1 if ranks else len(index.centroids)


def sent(index: Index, queries: DataFrame, probes: int, beyond: DataFrame | None = None, beside: int = 0) -> DataFrame:
    """queries(qid, vec) in blocks by cell: cell, qkeys, qunits. Each goes to its `probes` nearest cells, or, with beyond(qid, score), to those after the first `beside` that may hold better than its score."""
    centroids, alike, sizes = index.centroids, index.alike, index.sizes
    radius, further = np.arccos(np.clip(alike, -1, 1)), beyond is not None

    def spread(batches):
        for batch in batches:
            floor = np.full(batch.num_rows, -2.0) if not further else pa.compute.fill_null(batch.column("score"), -2.0).to_numpy(zero_copy_only=False)
            for qid, vec, least in zip(batch.column("qid").to_pylist(), batch.column("vec").to_pylist(), floor, strict=True):
                unit = np.array(vec, dtype=float)
                unit /= max(np.linalg.norm(unit), vecs.LEAST_NORM)
                near = centroids @ unit
                order = np.argsort(-near, kind="stable")
                if not further:
                    cells = order[:probes]
                else:
                    best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius))
                    cells = order[beside:]
                    cells = cells[best[cells] >= least - SLACK]
                cells = cells[sizes[cells] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([qid] * len(cells), pa.int64()), pa.array([unit.tobytes()] * len(cells), pa.binary())], names=["cell", "key", "unit"])

    whole = F.col("vec").isNotNull() & (F.size("vec") == index.dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    rows = queries.filter(whole).select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))
    if beyond is not None:
        rows = rows.join(beyond, "qid", "left")
    dealt = rows.mapInArrow(spread, "cell int, key long, unit binary")
    asked = packed(dealt.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key"), index.dim)
    return cut(asked.select("cell", F.col("keys").alias("qkeys"), F.col("units").alias("qunits")))


def search(index: Index | None, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """queries(qid long, vec) -> qid, id, score, rank, as vectors.topk: of the vectors in the nearest lists, or exactly."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    probes = min(probes or index.probes, len(index.centroids))
    hits = vecs.met(index.lists.join(sent(index, queries, probes), "cell"), k)
    if exact and probes < len(index.centroids):
        hits = cut(vecs.ranked(hits, k))
        kth = hits.filter(F.col("rank") == k).select("qid", "score")
        hits = hits.drop("rank").unionByName(vecs.met(index.lists.join(sent(index, queries, probes, kth, probes), "cell"), k))
    return vecs.ranked(hits, k)
