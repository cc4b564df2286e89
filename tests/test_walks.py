"""Walks of many seeds as bits, and components by doubling, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import graph


def plain_walk(edges, seeds, depth, known=None):
    out = {}
    for name, start in seeds:
        out.setdefault((name, start), 0)
        front, seen = {start}, {i for (n, i) in out if n == name}
        for hop in range(1, depth + 1):
            front = {b for a, b in edges if a in front and (known is None or a in known)} - seen
            seen |= front
            out |= {(name, i): hop for i in front}
    return {(*k, d) for k, d in out.items()}


def test_bits_equal_a_plain_walk(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(150)}
    seeds = [(f"s{i}", i % 60) for i in range(150)]
    e = spark.createDataFrame([("r", str(a), str(b), "calls") for a, b in edges], "repo string, src_id string, tgt_id string, kind string")
    s = spark.createDataFrame([("r", n, str(i)) for n, i in seeds], "repo string, seed string, id string")
    known = set(range(0, 60, 2)) | {1, 3}
    entities = spark.createDataFrame([("r", str(i)) for i in known], "repo string, id string")
    got = {(r["seed"], int(r["id"]), r["depth"]) for r in graph.khop(e, s, 3, "callees", entities).collect()}
    assert got == plain_walk(edges, seeds, 3, known)
    assert graph.khop(e, s.limit(0), 2).count() == 0


def test_rows_of_a_walk_grow_with_nodes(spark):
    """Ten thousand seeds at a hub: a hop has a row a node and word, not a row a node and seed."""
    e = spark.range(10_000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("src_id"), F.lit("hub").alias("tgt_id"), F.lit("calls").alias("kind"))
    e = e.unionByName(spark.range(50).select(F.lit("r").alias("repo"), F.lit("hub").alias("src_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("tgt_id"), F.lit("calls").alias("kind")))
    seeds = e.filter("tgt_id = 'hub'").select("repo", F.col("src_id").alias("seed"), F.col("src_id").alias("id")).coalesce(2)
    bits = graph.khop_bits(e, graph.numbered_seeds(seeds), 2, "callees")
    last = bits.filter("depth = 2")
    assert last.count() <= 50 * (10_000 // 64 + 2 * spark.sparkContext.defaultParallelism)
    assert last.agg(F.sum(F.bit_count("bits"))).first()[0] == 50 * 10_000


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_a_long_ring_takes_few_rounds(spark, monkeypatch, order):
    n = 4096
    names = [f"m{i:05d}" for i in range(n)]
    if order == "falling":
        names.reverse()
    elif order == "mixed":
        random.Random(2).shuffle(names)
    ring = spark.createDataFrame([("r", names[i], names[(i + 1) % n]) for i in range(n)] + [("r", names[0], "out"), ("r", "in", names[5])], "repo string, src string, tgt string")
    rounds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or real(df))
    got = graph.strong_components(ring).collect()
    assert {r["node"] for r in got} == set(names) and {r["component"] for r in got} == {"m00000"} and len(rounds) < 36  # six are not rounds


def test_components_equal_plain_ones(spark):
    rng = random.Random(12)
    rows = [(r, str(rng.randrange(40)), str(rng.randrange(40))) for r in "ab" for _ in range(55)]
    want = set()
    for repo in "ab":
        reach = {str(i): {str(i)} for i in range(40)}
        for _ in range(40):
            for r, a, b in rows:
                if r == repo:
                    for x in reach:
                        if a in reach[x]:
                            reach[x].add(b)
        for i in reach:
            same = {j for j in reach[i] if i in reach[j]}
            if len(same) > 1:
                want.add((repo, i, min(same)))
    assert {tuple(r) for r in graph.strong_components(spark.createDataFrame(rows, "repo string, src string, tgt string")).collect()} == want
    assert graph.strong_components(spark.createDataFrame([], "repo string, src string, tgt string")).count() == 0
