"""Snapshots that change as a whole, metrics kept by deltas, and inverted lists of vectors."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import graph, health, inverted, vectors
from treeline.sources.snapshots import Conflict, Store
from treeline.streaming import deltas, streams


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, *values):
    return spark.createDataFrame(list(values), "repo string, id long")


def test_commit_is_seen_as_a_whole(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.latest() is None
    with pytest.raises(KeyError):
        store.read("a")
    store.commit({"a": table(spark, ("x", 1), ("y", 2)), "b": table(spark, ("x", 10))})
    pinned = store.read("a")
    bad = table(spark, ("x", 5)).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": table(spark, ("x", 7)), "b": bad})
    assert store.versions() == [0] and rows(store.read("a")) == [("x", 1), ("y", 2)] and rows(store.read("b")) == [("x", 10)]
    assert store.commit({"a": table(spark, ("z", 3)), "b": table(spark)}) == 1
    assert rows(store.read("a")) == [("z", 3)] and rows(store.read("b")) == [] and rows(pinned) == rows(store.read("a", 0)) == [("x", 1), ("y", 2)]


def test_repositories_are_replaced_alone(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    odd = "a/b=c %7 é"
    store.commit({"a": table(spark, ("1", 1), (odd, 2), ("gone", 3), (None, 4)), "b": table(spark, ("1", 9))})
    store.commit({"a": table(spark, (odd, 5), (odd, 6))}, touched=[odd, "gone"], properties={"batch": "7"})
    assert sorted(store.read("a").collect(), key=repr) == sorted(table(spark, ("1", 1), (odd, 5), (odd, 6), (None, 4)).collect(), key=repr)
    assert rows(store.read("a", repos=[odd])) == [(odd, 5), (odd, 6)] and rows(store.read("b")) == [("1", 9)] and store.properties() == {"batch": "7"}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    base = one.commit({"a": table(spark, ("x", 1))})
    two.commit({"a": table(spark, ("x", 2))}, base=base)
    with pytest.raises(Conflict):
        one.commit({"a": table(spark, ("x", 3))}, base=base)
    assert rows(one.read("a")) == [("x", 2)]


def test_old_versions_are_collected(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    for i in range(4):
        store.commit({"a": table(spark, ("x", i))}, touched=["x"])
        store.commit({"b": table(spark, (f"r{i}", i))}, touched=[f"r{i}"])
    store.collect(2)
    assert store.versions() == [6, 7] and rows(store.read("a")) == [("x", 3)] and rows(store.read("b", 6)) == [("r0", 0), ("r1", 1), ("r2", 2)] and len(store.names("data")) == 5


def test_metrics_by_deltas_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    ids = [f"m{i % 4}.f{i}" for i in range(25)] + ["m1.len", "ext.thing"]
    live, known, store = [], {}, Store(spark, f"{tmp_path}/s")
    entity = lambda i: (i.split(".")[0][-1] in "12" and "r1" or "r2", i, "function", "_p/a.py", 1, 20 + 7 * (len(i) + ids.index(i)))
    for batch in range(4):
        gone = rng.sample(live, len(live) // 3)
        come = [(rng.choice(["r1", "r2"]), rng.choice(ids), rng.choice(ids), rng.choice(["calls", "calls", "calls", "imports"])) for _ in range(120 if batch else 0)]
        come += [("r1", i, "m1.f5", "calls") for i in ids[:8]] if batch == 1 else []
        off = rng.sample(sorted(known), len(known) // 4)
        on = [i for i in ids[:25] if i not in known and rng.random() < 0.6]
        for e in gone:
            live.remove(e)
        live += come
        known = {k: v for k, v in known.items() if k not in off} | {i: entity(i) for i in on}
        edges = spark.createDataFrame([(*e, -1) for e in gone] + [(*e, 1) for e in come], "repo string, src_id string, tgt_id string, kind string, n int")
        shape = "repo string, id string, kind string, file_path string, line_start int, line_end int, n int"
        signed = spark.createDataFrame([(*entity(i), -1) for i in off] + [(*entity(i), 1) for i in on], shape)
        need = F.col("line_end") % 2 == 0
        marks = deltas.entity_marks(signed, need).withColumn("n", F.lit(0)).limit(0).unionByName(signed.select("repo", "id", need.alias("need"), (F.col("line_end") - F.col("line_start") > 50).alias("large"), F.lit(True).alias("sized"), "n"))
        for _ in range(2):  # the batch comes again
            deltas.fold(store, batch, edges, marks)
        got = {r["repo"]: r for r in deltas.kept_metrics(store).collect()}
        assert store.latest() == batch
        if not live:
            continue
        calls = spark.createDataFrame(sorted(set(live)), "repo string, src_id string, tgt_id string, kind string").filter("kind = 'calls'")
        pairs = spark.createDataFrame(sorted({e[:3] for e in live}), "repo string, src_id string, tgt_id string").withColumn("file_path", F.lit("f"))
        ents = spark.createDataFrame(sorted(known.values()), shape[: shape.rindex(",")])
        for d, made in (("mc", health.module_coupling(calls)), ("fi", health.fan_in_concentration(calls)), ("fs", health.oversized_functions(ents))):
            assert {r["repo"]: r["value"] for r in made.collect()} == {k: pytest.approx(v[d]) for k, v in got.items()}, (d, batch)
        need_ids = ents.filter(need).join(pairs.select("repo", F.col("tgt_id").alias("id")).distinct().withColumn("called", F.lit(True)), ["repo", "id"], "left")
        dead = {r["repo"]: (r["whole"], r["part"]) for r in need_ids.groupBy("repo").agg(F.count("*").alias("whole"), F.count_if(F.col("called").isNull()).alias("part")).collect()}
        assert dead == {k: (v["needing"], v["dead"]) for k, v in got.items()}
        for r in graph.graph_counts(ents, pairs).collect():
            assert [r[c] for c in ("entity_count", "phantom_count", "relation_count")] == [got[r["repo"]][c] for c in ("entity_count", "phantom_count", "relation_count")]


def test_metrics_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("r", "a.x", "b.y", "calls", 1), ("r", "a.x", "a.z", "calls", 1)], "repo string, src_id string, tgt_id string, kind string, n int")
    df.write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/s")
    for _ in range(2):
        streams.maintain(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), lambda part, n: deltas.fold(store, n, part), f"{tmp_path}/state").awaitTermination()
    df.limit(1).withColumn("n", F.lit(-1)).write.mode("append").parquet(f"{tmp_path}/in")
    streams.maintain(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), lambda part, n: deltas.fold(store, n, part), f"{tmp_path}/state").awaitTermination()
    got = deltas.kept_metrics(store).first()
    assert (got["calls"], got["relation_count"], got["phantom_count"], store.latest()) == (1, 1, 2, 1)


# --- inverted lists ---------------------------------------------------------------------------------------------------


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_lists_hold_every_vector_and_find_most(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    index = inverted.built(v)
    assert index.lists.select(F.explode("keys").alias("id")).distinct().count() == v.count() == index.lists.agg(F.sum(F.size("keys"))).first()[0]
    want, near = hits(vectors.topk(v, asked, 10)), inverted.search(index, asked, 10)
    assert len({(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in hits(near)}) >= 0.9 * len(want)
    assert hits(inverted.search(index, asked, 10, exact=True)) == want
    assert "NestedLoop" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()


def test_clusters_are_found_in_few_lists(spark):
    """Where vectors lie in clusters a search reads few lists, and the bounds leave few others to an exact one."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16)) * 5
    rows_ = [(i, (centres[i % 20] + rng.standard_normal(16) * 0.2).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows_, "id long, vec array<double>")
    asked = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    index = inverted.built(v, cells=40)
    assert index.probes <= 8
    beyond = inverted.search(index, asked, 10).filter("rank = 10").select("qid", "score")
    further = inverted.sent(index, asked, index.probes, beyond, index.probes).agg(F.sum(F.size("qkeys"))).first()[0] or 0
    assert further <= asked.count() * 8
    assert hits(inverted.search(index, asked, 10, exact=True)) == hits(vectors.topk(v, asked, 10))


def test_lists_of_awkward_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(400)]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [1.0, 2.0]), (905, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(same + odd + [(500 + i, [float(i), 1.0, -2.0]) for i in range(50)], "id long, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.1]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, 2.0]), (5, [9.0, 1.0, -2.0])], "qid long, vec array<double>")
    index = inverted.built(v, cells=5)
    assert index.sizes.sum() == 451
    three = v.filter("size(vec) = 3")
    assert hits(inverted.search(index, asked, 7, exact=True)) == hits(vectors.topk(three, asked, 7))
    assert inverted.built(v.limit(0)) is None and inverted.search(None, asked, 3).count() == 0 and inverted.search(index, asked.limit(0), 3).count() == 0
    assert inverted.search(inverted.built(v.filter("id = 3")), asked, 3, exact=True).count() == 3
