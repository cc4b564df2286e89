"""Many patterns in one pass, against plain search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from treeline.operators import graph, patterns, quality


def hits(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_patterns_against_plain_search(spark, monkeypatch):
    """Overlapping patterns, patterns in patterns, long ones, and odd texts; in one part and in many."""
    monkeypatch.setattr(patterns, "HEAD", 5)
    rng = random.Random(3)
    some = {"".join(rng.choices("abé😀", k=rng.randint(1, 9))) for _ in range(300)} | {"aaaaaaaaaaaa", "a.b", "*"}
    texts = [(i, "".join(rng.choices("abé😀 .", k=rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 3000), (103, "x*y")]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("pattern_of", F.lit("k"))
    table = spark.createDataFrame([(p,) for p in some] + [("",), (None,), ("a.b",)], "pattern string")
    want = sorted((i, p) for i, t in texts for p in some if p in (t or ""))
    for part in (10**6, 100):
        assert hits(patterns.contained(df, "text", table, part), "id", "pattern") == want
    assert patterns.contained(df, "text", table.limit(0)).count() == 0 and patterns.contained(df.limit(0), "text", table).count() == 0


def test_a_million_patterns(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(";")).alias("pattern"))
    texts = spark.range(200).select("id", F.concat_ws(" ", *[F.concat(F.lit("p"), (F.col("id") * 4799 + k * 7).cast("string"), F.when(F.col("id") % 3 == 0, ":").otherwise(";")) for k in range(5)]).alias("text"))
    got = patterns.contained(texts, "text", table, 4_000_000)
    want = [(i, f"p{i * 4799 + k * 7};") for i in range(200) for k in range(5) if i % 3 and i * 4799 + k * 7 < 1_000_000]
    assert hits(got, "id", "pattern") == sorted(want)


def test_symbols_without_bound(spark):
    entities = spark.createDataFrame([("r", "a.b.c", "c"), ("r", "a.bc", "bc"), ("s", "a.b.c", "c"), ("r", "x", "wide_b.c_name")], "repo string, id string, name string")
    asked = spark.createDataFrame([("r", "b.c"), ("r", "c"), ("r", "nothing"), ("r", "x"), ("t", "c"), ("r", "")], "repo string, symbol string").unionByName(spark.range(12_000).select(F.lit("r").alias("repo"), F.concat(F.lit("sym"), F.col("id").cast("string")).alias("symbol")))
    assert hits(graph.lookup(entities, asked), "repo", "symbol", "id") == [("r", "b.c", "a.b.c"), ("r", "b.c", "x"), ("r", "c", "a.b.c"), ("r", "c", "a.bc"), ("r", "c", "x"), ("r", "x", "x")]


def test_blast_radius_by_repository(spark):
    files = spark.createDataFrame([("a", "x/one.py", "see y/two.py"), ("a", "y/two.py", "one.py"), ("b", "z/three.py", "one.py and y/two.py"), ("a", "q/one.sh", "two.pyc")], "repo string, rel_path string, content string")
    targets = spark.createDataFrame([("a", "x/one.py"), ("a", "y/two.py")], "repo string, path string")
    assert hits(quality.blast_radius(files, targets), "repo", "path", "rel_path") == [("a", "x/one.py", "y/two.py"), ("a", "y/two.py", "q/one.sh"), ("a", "y/two.py", "x/one.py")]
    assert hits(quality.blast_radius(files.drop("repo"), targets.drop("repo")), "path", "rel_path") == [("x/one.py", "y/two.py"), ("x/one.py", "z/three.py"), ("y/two.py", "q/one.sh"), ("y/two.py", "x/one.py"), ("y/two.py", "z/three.py")]
