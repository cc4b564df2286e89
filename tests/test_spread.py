"""Work that a small input stands for is dealt over tasks, done once, and bounded in a task."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline import catalogue
from treeline.functions.text import has_any
from treeline.operators import corpus, evidence, facts, graph, vectors
from treeline.operators.common import stepped
from treeline.plans import jobs, retrieve
from treeline.sources import readers
from treeline.streaming import deltas


def tree(spark, n):
    rows = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("a/f"), F.col("id").cast("string"), F.lit(".py")).alias("rel_path"), F.lit("@router.get('/x')\ndef a():\n    store.purge()\n").alias("content"))
    return readers.as_files(rows.coalesce(1))


def per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]


def test_one_split_of_files_is_parsed_by_many_tasks(spark):
    got = per_task(facts.extract(tree(spark, 400)))
    assert sum(got) == 400 and len(got) >= 4 and max(got) < 200


def test_one_split_of_rows_is_read_by_many_tasks(spark):
    got = per_task(evidence.in_tasks(spark.range(400).coalesce(1), "id long", lambda i: [{"id": i}]))
    assert sum(got) == 400 and len(got) >= 4 and max(got) < 200


def test_steps_are_bounded_by_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"a": ["x"] * 6 + ["y" * 100, None, "z"], "n": list(range(9))})
    parts = list(stepped(iter([batch]), 4, 50))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in parts] == [4, 2, 1, 2]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_envelope_parses_each_file_once(spark, monkeypatch):
    calls = []
    real = facts.extract
    monkeypatch.setattr(facts, "extract", lambda *a: calls.append(1) or real(*a))
    got = jobs.audit_envelope(tree(spark, 3).unionByName(readers.as_files(spark.createDataFrame([("r", "a/g.py", "@router.get('/y')\n@require_admin\ndef g():\n    pass\n")], "repo string, rel_path string, content string"))))
    assert len(calls) == 1 and "MapInArrow" not in plan(got) and {r["id"] for r in got.collect()} == {"a"}


NESTED = """@top
class A(B):
    "doc"
    @app.get('/m')
    def m(self, x: int = 1, *, y=(1, 2)): return [lambda: 1 for _ in x]
    if x:
        async def n(a, /): pass
    elif y:
        class C:
            def k(): "k"
    else:
        def o(): pass
try:
    def p():
        with q as r:
            def s(): return t.u(1)
except E:
    def v(): pass
else:
    def w(): pass
finally:
    @a.b(c="d")
    def z(): pass
for i in j:
    while k:
        @x[0]
        def l(): pass
    else:
        def y(): pass
match m:
    case 1:
        def first(): pass
    case _:
        def other[T](): pass
"""


def test_symbols_alone_are_those_of_all_facts():
    for text in (NESTED, "", "x = 1\n", Path(facts.__file__).read_text(), Path(jobs.__file__).read_text()):
        assert facts.python_symbols(text) == {"symbols": facts.python_facts(text)["symbols"]}
    with pytest.raises(SyntaxError):
        facts.python_symbols("def f(:\n")


def test_handlers_need_no_other_facts(spark):
    """A sum of 1,500 terms and a chain of 1,200 branches are deeper than Python's stack: neither is visited."""
    handler = "@app.get('/x')\ndef {}(user=Depends(current_user)):\n    return {}\n"
    branches = "if a:\n    pass\n" + "elif b:\n    pass\n" * 1200 + "else:\n    @r.post('/y')\n    def far(): pass\n"
    texts = {"plain": handler.format("plain", 1), "deep": handler.format("deep", "+".join(["1"] * 1500)), "far": branches, "broken": handler.format("broken", "("), "none": "def none(): pass\n", "null": None}
    files = readers.as_files(spark.createDataFrame([("r", f"a/{n}.py", t) for n, t in texts.items()], "repo string, rel_path string, content string"))
    got = evidence.routed_handlers(files)
    assert {(r["handler"], r["rel_path"], r["line_no"], r["guarded"]) for r in got.collect()} == {("plain", "a/plain.py", 2, True), ("deep", "a/deep.py", 2, True), ("far", "a/far.py", 2405, False)}
    assert "Contains(content" in plan(got).split("== Physical Plan ==")[1]


def test_parts_are_looked_for_in_a_text_lowered_once(spark):
    rows = spark.createDataFrame([("xAuthX", ["acl", "auth"]), ("x", ["acl"]), ("x", []), (None, ["acl"]), ("x", None)], "t string, p array<string>")
    found = rows.select(has_any(F.col("t"), F.col("p")).alias("own"), has_any(F.col("t"), ("auth",)).alias("fixed"))
    assert [tuple(r) for r in found.collect()] == [(True, True), (False, False), (False, False), (None, None), (None, False)]
    assert "Contains(lower" not in plan(found)


def test_callers_are_read_from_facts_that_are_written(spark, sf):
    assert "MapInArrow" not in plan(catalogue.queries()["caller_ids"](spark, sf))


def test_decorators_above_meet_lines_by_number(spark):
    text = "@top\n# note\n@a.b(1)\n\ndef f():\n    pass\nx = 1\n@late\ndef g():\n    pass\n"
    files = spark.createDataFrame([("r", "f.py", text), ("r", "h.py", "@k\ndef h():\n    pass\n")], "repo string, rel_path string, content string")
    symbols = spark.createDataFrame([("r", "f.py", "f", 5, []), ("r", "f.py", "g", 9, []), ("r", "f.py", "first", 1, []), ("r", "h.py", "h", 2, ["k"])], "repo string, rel_path string, name string, line_start int, annotations array<string>")
    got = corpus.decorators_above(symbols, corpus.lines(files))
    assert {(r["name"], tuple(r["decorators"])) for r in got.collect()} == {("f", ("top", "a.b")), ("g", ("late",))}
    joins = [line for line in plan(got).split("== Physical Plan ==")[1].splitlines() if "Join" in line]
    assert joins and all("line_no" in j for j in joins)


def test_best_scores_equal_a_whole_sort_and_copies_tie():
    rng = np.random.default_rng(3)
    units, asked, own = np.repeat(rng.standard_normal((9, 21)), 37, axis=0), rng.standard_normal((30, 21)), rng.permutation(333)
    units[:37], asked[4] = np.nan, 0.0
    scores = np.array([[(u * a).sum() for u in units] for a in asked])
    assert all(len(set(r[37 * i : 37 * i + 37])) == 1 for r in scores for i in range(1, 9))
    order = np.lexsort((np.broadcast_to(own, scores.shape), np.where(np.isnan(scores), np.inf, -scores)), axis=1)
    for k in (1, 50, 333, 400):
        row, col, told = vectors.best_of(units, asked, own, k)
        assert row.tolist() == np.repeat(np.arange(30), min(k, 333)).tolist() and col.tolist() == order[:, :k].ravel().tolist()
        assert np.array_equal(told, scores[row, col], equal_nan=True)


def test_blocks_and_batches_of_vectors_are_small(spark):
    rows = spark.range(3000).coalesce(1).select("id", F.array_repeat(F.col("id") + 1.0, 200).alias("vec"))
    sizes = [r["n"] for r in vectors.blocks_of(rows, "id").select(F.length("units").alias("n")).collect()]
    assert sum(sizes) == 3000 * 200 * 8 and max(sizes) <= 2 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    got = vectors.topk(rows, rows.filter("id < 2").withColumnRenamed("id", "qid"), 3)
    assert "rangepartitioning(id" not in plan(got) and "hashpartitioning(id" in plan(got) and got.count() == 6


def test_an_exact_retrieval_lists_no_vectors(spark, monkeypatch):
    """Lists are for searches of the nearest ones: an exact search of them joins most lists with most queries."""
    monkeypatch.setattr(retrieve.inverted, "built", lambda *a, **k: pytest.fail("built"))
    shape = "repo string, id string, kind string, description string"
    entities = spark.createDataFrame([("r", "a.red", "function", "function red"), ("r", "a.blue", "function", "function blue")], shape)
    relations = spark.createDataFrame([("r", "a.red", "a.blue", "calls", "a.py")], "repo string, src_id string, tgt_id string, kind string, file_path string")
    chunks = spark.createDataFrame([("r", "d1", "blue sky"), ("r", "d2", "red rose")], "repo string, id string, content string")
    asked = spark.createDataFrame([(1, "red rose")], "qid long, text string")
    got = retrieve.retrieve(asked, entities, relations, chunks, 1).collect()
    assert [r["qid"] for r in got] == [1] and "red rose" in got[0]["context"] and "function a.red" in got[0]["context"] and "a.red -calls-> a.blue" in got[0]["context"]


def test_one_split_of_texts_is_embedded_by_many_tasks(spark):
    rows = spark.range(400).coalesce(1).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("id"), F.lit("x").alias("owner"), F.lit("a b").alias("text"))
    got = per_task(vectors.embed(rows))
    assert sum(got) == 400 and len(got) >= 4 and max(got) < 200


def small_graph(spark, n=30):
    """Each relation twice: callers f0, f1, ... of g, which calls out; only callers and g are entities."""
    named = lambda c: F.concat(F.lit("m.f"), F.col(c).cast("string"))
    edge = lambda rows, a, b: rows.select(F.lit("r").alias("repo"), a.alias("src_id"), b.alias("tgt_id"), F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.col("id").alias("seq"))
    rel = edge(spark.range(n), named("id"), F.lit("m.g")).unionByName(edge(spark.range(2), F.lit("m.g"), F.lit("ext.x"))).unionByName(edge(spark.range(1), F.lit("ext.x"), F.lit("far.y")))
    ents = spark.range(n).select(named("id").alias("id")).unionByName(spark.range(1).select(F.lit("m.g").alias("id"))).select(F.lit("r").alias("repo"), "id")
    return rel.unionByName(rel), ents


def test_a_walk_both_ways_writes_each_edge_once(spark, monkeypatch):
    rel, ents = small_graph(spark)
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(real(df)) or written[-1])
    seeds = spark.createDataFrame([("r", "q", "m.f1")], "repo string, seed string, id string")
    got = {(r["id"], r["depth"]) for r in graph.khop(rel, seeds, 3, "both", ents).collect()}
    assert got == {("m.f1", 0), ("m.g", 1), ("ext.x", 2)} | {(f"m.f{i}", 2) for i in range(30) if i != 1}
    assert max(df.count() for df in written) <= rel.count()


def test_files_are_gathered_for_phantoms_alone(spark):
    rel, ents = small_graph(spark)
    got = graph.phantoms(ents, rel)
    assert {(r["id"], tuple(r["responsible_files"])) for r in got.collect()} == {("ext.x", ("f0", "f1")), ("far.y", ("f0",))}
    assert "LeftAnti" not in plan(got)


def test_a_neighbourhood_collapses_its_own_relations(spark, monkeypatch, sf):
    rel, _ = small_graph(spark)
    reached = spark.createDataFrame([("r", "q", "m.g"), ("r", "q", "ext.x"), ("r", "p", "m.f2")], "repo string, seed string, id string")
    assert {(r["src_id"], r["tgt_id"]) for r in graph.among(rel, reached).collect()} == {("m.f2", "m.g"), ("m.g", "ext.x")}
    seen, real = [], graph.collapse_edges
    monkeypatch.setattr(graph, "collapse_edges", lambda r: seen.append(r) or real(r))
    catalogue.queries()["symbol_neighbourhood"](spark, sf)
    assert [r.count() for r in seen] < [spark.read.parquet(f"{sf}/lineitem.parquet").count() // 2]


def test_deltas_meet_their_state_in_one_shuffle(spark):
    old = spark.createDataFrame([("r", "a", 2, 1), ("r", "b", 5, 5)], "repo string, id string, n long, calls long")
    more = spark.createDataFrame([("r", "a", 1, 0), ("r", "a", -1, -1), ("r", "c", 4, None)], "repo string, id string, n int, calls int")
    got = deltas.folded(old, more, ["repo", "id"], ("n", "calls"))
    physical = plan(got).split("== Physical Plan ==")[1]
    assert "Join" not in physical and physical.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [("r", "a", 2, 1, 2, 0), ("r", "b", 5, 5, 5, 5), ("r", "c", 0, 0, 4, 0)]


def test_plain_code_is_read_without_unparsing(monkeypatch):
    import ast
    import inspect

    text = "import a, b as c\n@router.get('/a1', tags=t.x)\n@own\ndef f(x: int, y: a.B = 3, z='q', *, k=None):\n    'doc'\n    return [g(x) for i in h(y) if not p.q(z)] or (lambda: r())()\n"
    for code in (text, inspect.getsource(facts), inspect.getsource(evidence), inspect.getsource(ast)):
        nodes = list(ast.walk(ast.parse(code)))
        defs = [n for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        assert all(facts.arguments_of(n.args) == ast.unparse(n.args) and all(facts.source_of(d) == ast.unparse(d) for d in n.decorator_list) for n in defs)
        assert all(facts.source_of(n) == ast.unparse(n) for n in nodes if isinstance(n, ast.Call))
        found = facts.python_facts(code)
        assert sorted(c[3] for c in found["calls"]) == sorted(n.lineno for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute))
        assert len(found["symbols"]) == len(defs) + sum(isinstance(n, ast.ClassDef) for n in nodes)
    monkeypatch.setattr(ast, "unparse", lambda *a: pytest.fail("unparsed"))
    got = facts.python_facts("@router.get('/a1')\n@own\ndef a(x: int, user=Depends(current_user, 2)):\n    return a.b(x)\n")
    assert got["symbols"][0][2] == "a(x: int, user=Depends(current_user, 2))" and got["symbols"][0][6] == ["router.get('/a1')", "own"]


def test_context_is_read_inside_each_file(spark):
    big = "\n".join(f"x = '{n}'" if n % 2 else f"y{n}" for n in range(50_000))
    texts = [("r", "a.py", "p = 'a'\r\nq\n\nr = \"b\"\ns"), ("r", "b.py", "'one'"), ("r", "c.py", ""), ("r", "d.py", None), ("r", "big.py", big)]
    files = readers.as_files(spark.createDataFrame(texts, "repo string, rel_path string, content string"))
    quoted = lambda line: line.rlike("['\"]")
    for before, after in ((2, 2), (0, 1), (3, 0)):
        got = corpus.hits_in_context(files, quoted, "is_test", before=before, after=after)
        want = corpus.line_context(corpus.lines(files), quoted(F.col("line")), before, after)
        columns = ("rel_path", "line_no", "line", "context")
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
        assert got.count() == 25_003 and "Exchange" not in plan(got)


def test_uses_of_literals_shuffle_no_lines(spark):
    files = readers.as_files(spark.createDataFrame([("r", "a.py", "if s == 'open':\n    s = \"shut\""), ("r", "t/test_a.py", "'open'"), ("r", "1.sql", "CREATE TABLE t (\n s text CHECK (s IN ('open',\n 'shut'))\n);\nSELECT 'open';")], "repo string, rel_path string, content string"))
    wanted = spark.createDataFrame([("r", "open"), ("r", "shut"), ("q", "open")], "repo string, value string")
    got = evidence.literal_uses(files, wanted)
    assert "Window" not in plan(got)
    assert {tuple(r)[:6] for r in got.collect()} == {("r", "open", "a.py", 1, False, True), ("r", "shut", "a.py", 2, False, False), ("r", "open", "t/test_a.py", 1, True, False), ("r", "open", "1.sql", 5, False, False)}


def test_a_report_brings_its_files_once(spark, monkeypatch):
    told, real = [], jobs.AUDITS["states"]
    monkeypatch.setitem(jobs.AUDITS, "states", lambda files, **k: told.append(files) or real(files, **k))
    exempt = spark.createDataFrame([], "repo string, table string, entry string, reason string, ord int")
    jobs.audit_report(tree(spark, 3).filter(F.length("content") > 1), exempt, ("states",))
    assert "Range" not in plan(told[0]) and told[0].count() == 3


def test_rounds_answer_every_conversation(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {r["conv_id"]: r["n"] for r in turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n")).collect()}
    got = catalogue.queries()["retrieve_rounds"](spark, sf).select("question", "sub_questions").collect()
    assert len(got) == len(want) and {r["question"]: r["sub_questions"] for r in got} == want and sum(want.values()) == turns.filter("role = 'user'").count()


def test_a_question_without_follow_ups_is_covered(spark):
    shape = "repo string, id string, kind string, description string"
    entities = spark.createDataFrame([("r", "a.red", "function", "function red")], shape)
    relations = spark.createDataFrame([], "repo string, src_id string, tgt_id string, kind string, file_path string")
    chunks = spark.createDataFrame([("r", "d1", "blue sky")], "repo string, id string, content string")
    asked = spark.createDataFrame([(1, 0, "blue sky"), (1, 2, "red"), (None, 0, "red")], "question long, round int, text string")
    every = spark.createDataFrame([(1,), (1,), (2,), (None,)], "question long")
    got = {r["question"]: r for r in retrieve.retrieve_rounds(asked, entities, relations, chunks, 1, questions=every).collect()}
    assert {q: (r["sub_questions"], r["covered"], r["coverage"]) for q, r in got.items()} == {1: (2, 2, 1.0), 2: (0, 0, 1.0), None: (1, 1, 1.0)}
    assert got[2]["context"] == "" and got[1]["context"].count("## Follow-up: ") == 2


def blocks(spark, n, seed, key, most):
    """Vectors of 16 distinct directions and as many again, a third of them copies, in blocks of about `most` values."""
    rng = np.random.default_rng(seed)
    vecs = np.concatenate([np.repeat(rng.standard_normal((16, 24)), n // 48, axis=0), rng.standard_normal((n - n // 48 * 16, 24))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.permutation(vecs).tolist())], f"{key} long, vec array<double>")
    return rows, vectors.blocks_of(rows.coalesce(1), key, most)


def test_a_task_hands_on_the_best_of_all_its_blocks(spark, monkeypatch):
    """Blocks after the first are cut by a query's k-th hit so far; results are those of scoring all pairs, and rows grow with tasks, not with blocks."""
    rows, own = blocks(spark, 900, 1, "id", 24 * 70)
    asked, theirs = blocks(spark, 120, 2, "qid", 24 * 50)
    pairs = own.join(F.broadcast(theirs.withColumnsRenamed({"keys": "qkeys", "units": "qunits"})), "dim").coalesce(1)
    scored = rows.crossJoin(asked.withColumnRenamed("vec", "other")).select("qid", "id", vectors.cosine(F.col("vec"), F.col("other")).alias("score"))
    want = {(r["qid"], r["rank"]): (r["id"], round(r["score"], 12)) for r in vectors.ranked(scored.withColumn("score", F.round("score", 12)), 5).collect()}
    for held, least, most in ((2_000_000, 600, 600), (1, 601, 120 * 5 * 13)):
        monkeypatch.setattr(vectors, "HELD", held)
        hits = vectors.met(pairs, 5)
        assert least <= hits.count() <= most
        assert {(r["qid"], r["rank"]): (r["id"], round(r["score"], 12)) for r in vectors.ranked(hits.withColumn("score", F.round("score", 12)), 5).collect()} == want


def test_single_precision_loses_no_near_tie():
    """Vectors that single precision cannot tell apart, one of huge and one of tiny length, and a floor."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64) / 8
    units = base + rng.standard_normal((700, 64)) * 1e-9
    units[5], units[6] = base * 1e-40, base * 1e3
    asked, own = np.concatenate([base[None], base[None] * 1e-42, rng.standard_normal((3, 64))]), rng.permutation(700)
    scores = np.array([[(u * a).sum() for u in units] for a in asked])
    order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :7]
    for floor in (None, np.take_along_axis(scores, order, axis=1)[:, 6]):
        row, col, told = vectors.best_of(units, asked, own, 7, floor)
        assert row.tolist() == np.repeat(np.arange(5), 7).tolist() and col.tolist() == order.ravel().tolist() and np.array_equal(told, scores[row, col])


def test_hashed_texts_are_sums_of_their_words():
    import zlib

    texts = ["a b  A\u2003c", "", None, "é 😀 x x x", " \n"]
    want = np.zeros((5, 7))
    for row, text in zip(want, texts, strict=True):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % 7] += 1 if h >> 16 & 1 else -1
    got = vectors.hashing_embedder(7)(texts)
    assert got == (want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), vectors.LEAST_NORM)).tolist() and vectors.hashing_embedder(7)([]) == []


def test_blocks_are_filled_whatever_the_batches(spark):
    """Batches of 7 rows do not make a block longer than the 10 vectors that fit it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(33).coalesce(1).select("id", F.array_repeat(F.col("id") + 1.0, 20).alias("vec"))
        assert [len(r["keys"]) for r in vectors.blocks_of(rows, "id", 205).select("keys").collect()] == [10, 10, 10, 3]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_few_vectors_with_many_copies_are_searched_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(np.repeat(rng.standard_normal((9, 6)), 40, axis=0)[rng.permutation(360)].tolist())], "id long, vec array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((50, 6)).tolist())], "qid long, vec array<float>")
    want = sorted(map(tuple, vectors.topk(rows, asked, 7).select("qid", "rank", "id", "score").collect()))
    assert len(want) == 350 and vectors.first_copies(rows, 7).count() == 63
    for most in (32, 0):
        monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", most)
        assert sorted(map(tuple, vectors.topk_of_few(rows, asked, 7).select("qid", "rank", "id", "score").collect())) == want
