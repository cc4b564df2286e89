"""Small literal cases of the code-graph library, and properties that must hold on any input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from treeline.functions import ids, scores, text
from treeline.operators import audit, corpus, facts, graph, health, impact, quality, resolve, runtime, sync, vectors
from treeline.plans import retrieve
from treeline.schema import assert_schema
from treeline.sources import readers, reports

R = "r"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def entities(spark, rows):
    return spark.createDataFrame([(R, i, k, p, a, b, []) for i, k, p, a, b in rows], "repo string, id string, kind string, file_path string, line_start int, line_end int, decorators array<string>").withColumn("name", F.substring_index("id", ".", -1))


def edges(spark, rows):
    return spark.createDataFrame([(R, a, b, k, 1.0, a.split(".")[0] + ".py", n) for n, (a, b, k) in enumerate(rows)], "repo string, src_id string, tgt_id string, kind string, weight double, file_path string, seq long")


def chain(spark):
    return entities(spark, [("mod.A", "class", "mod.py", 1, 9), ("mod.B", "function", "mod.py", 10, 12), ("util.C", "function", "util.py", 1, 3)]), edges(spark, [("mod.A", "mod.B", "calls"), ("mod.B", "util.C", "calls")])


@pytest.mark.parametrize(("path", "want"), [("myapp/__init__.py", "myapp"), ("a/b/c/module.py", "a.b.c.module"), ("src/components/Button.tsx", "src.components.Button")])
def test_module_ids(spark, path, want):
    assert value(spark, ids.module_id(F.lit(path))) == want


@pytest.mark.parametrize(("file", "target", "want"), [("src/orchestrator/skill-router.ts", "./tool-executor", "src.orchestrator.tool-executor"), ("src/a/b.ts", "../c/d", "src.c.d"), ("pkg/sub/m.py", ".utils", "pkg.sub.utils"), ("pkg/sub/m.py", "..base.x", "pkg.base.x"), ("m.py", ".u", "u"), ("a.py", "os.path", "os.path"), ("a/b.ts", "../../x", "...x")])
def test_import_targets(spark, file, target, want):
    assert value(spark, ids.import_target(F.lit(file), F.lit(target))) == want


@pytest.mark.parametrize(("path", "want"), [("/p/src/a.ts", "src.a"), ("/p/src/index.ts", "src"), ("/p/x.d.ts", "x"), ("/p/pkg/__init__.py", "pkg"), ("/q/a.ts", None), ("/p/node_modules/a.js", None), ("/p/noext", None)])
def test_runtime_modules(spark, path, want):
    assert value(spark, ids.runtime_module(F.lit(path), F.lit("/p"))) == want


def test_weights_and_ladders(spark):
    assert [value(spark, scores.call_weight(F.lit(n))) for n in (1, 2, 4, 8, 16, 64, 0, -5)] == [1, 2, 3, 4, 5, 5, 1, 1]
    steps = {"mc": (0.2, 0.35, 0.5, 0.6), "cd": (0, 2, 3), "dc": (0.1, 0.25, 0.45, 0.65, 0.7), "td": (1, 3, 6, 7), "mf": (0.15, 0.25, 0.4, 0.5)}
    want = {"mc": [10, 8, 6, 4], "cd": [10, 6, 3], "dc": [10, 8, 6, 4, 2], "td": [10, 8, 6, 4], "mf": [10, 8, 6, 4]}
    assert {d: [value(spark, scores.step_score(d, F.lit(float(v)))) for v in vs] for d, vs in steps.items()} == want


def test_globs_and_excludes(spark):
    seen = lambda p, *pats: value(spark, text.excluded(F.lit(p), list(pats)))
    assert seen("a/b/c.py", "a*py") and seen("x/node_modules/y.js", "**/node_modules/**") and seen("dist/a.js", "dist/**") and not seen("src/a.py", "**/dist/**")
    assert value(spark, F.expr("'GET /a/b' rlike '" + text.glob_regex("GET /*") .replace("\\", "\\\\") + "'"))


def test_hops_of_the_chain(spark):
    ents, rel = chain(spark)
    walk = lambda start, depth, way: {r["id"] for r in graph.khop(rel, spark.createDataFrame([(R, "q", start)], "repo string, seed string, id string"), depth, way, ents).filter("depth > 0").collect()}
    assert walk("mod.B", 1, "callers") == {"mod.A"} and walk("mod.B", 1, "callees") == {"util.C"}
    assert walk("mod.B", 1, "both") == {"mod.A", "util.C"} and walk("mod.A", 2, "callees") == {"mod.B", "util.C"}
    flipped = rel.select("repo", F.col("tgt_id").alias("src_id"), F.col("src_id").alias("tgt_id"), "kind")
    back = graph.khop(flipped, spark.createDataFrame([(R, "q", "mod.A")], "repo string, seed string, id string"), 2, "callers", ents)
    assert {r["id"] for r in back.filter("depth > 0").collect()} == walk("mod.A", 2, "callees")


def test_phantoms_do_not_expand(spark):
    ents, rel = chain(spark)
    more = rel.unionByName(edges(spark, [("util.C", "ext.X", "calls"), ("ext.X", "mod.Z", "calls")]))
    found = graph.with_kind(graph.khop(more, spark.createDataFrame([(R, "q", "util.C")], "repo string, seed string, id string"), 3, "callees", ents), ents)
    assert {(r["id"], r["kind"]) for r in found.collect()} == {("util.C", "function"), ("ext.X", "external")}
    assert {r["id"] for r in graph.phantoms(ents, more).collect()} == {"ext.X", "mod.Z"}
    assert {r["id"] for r in graph.prunable_phantoms(ents, more).collect()} == {"mod.Z"}


def test_last_writer_and_redirects(spark):
    rel = edges(spark, [("a.f", "b", "calls"), ("a.f", "b", "imports"), ("a.f", "p", "calls"), ("p", "c.g", "calls")])
    assert graph.collapse_edges(rel).filter("tgt_id = 'b'").first()["kind"] == "imports"
    to = spark.createDataFrame([(R, "p", "q"), (R, "q", "a.real")], "repo string, phantom_id string, real_id string")
    assert {(r["src_id"], r["tgt_id"]) for r in graph.redirect_reexports(rel, to).collect()} == {("a.f", "b"), ("a.f", "a.real"), ("a.real", "c.g")}


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("z", "z")]
    found = graph.strong_components(spark.createDataFrame([(R, *p) for p in pairs], "repo string, src string, tgt string"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_strong_components_of_many_cycles(spark):
    """Over 64 cycles of two modules that import those after them, falling ones, and random graphs, against what reaches what."""
    import random

    draw = random.Random(4)
    pairs = {("up", f"a{i:03}", f"a{j:03}") for i in range(70) for j in (i + 1, i + 8) if j < 70}
    pairs |= {("up", f"a{i:03}", f"b{i:03}") for i in range(70)} | {("up", f"b{i:03}", f"a{i:03}") for i in range(70)}
    pairs |= {("down", b, a) for _, a, b in pairs}
    pairs |= {(f"r{n}", f"n{draw.randrange(14):02}", f"n{draw.randrange(14):02}") for n in range(12) for _ in range(10 + 2 * n)}
    to = {}
    for repo, a, b in pairs:
        to.setdefault((repo, a), set()).add(b)

    def reach(repo, a):
        seen, todo = set(), [a]
        while todo:
            new = to.get((repo, todo.pop()), set()) - seen
            seen |= new
            todo += new
        return seen

    all_reach = {x: reach(*x) for x in {(r, n) for r, a, b in pairs for n in (a, b)}}
    both = {(r, n): {m for m in there if m != n and n in all_reach[r, m]} for (r, n), there in all_reach.items()}
    want = {(r, n, min(n, *ms)) for (r, n), ms in both.items() if ms}
    got = graph.strong_components(spark.createDataFrame(sorted(pairs), "repo string, src string, tgt string"))
    assert {(r["repo"], r["node"], r["component"]) for r in got.collect()} == want
    assert len({c for r, _, c in want if r == "up"}) == 70


def test_dynamic_replace(spark):
    ents, rel = chain(spark)
    old = rel.withColumn("origin", F.lit("static")).unionByName(edges(spark, [("mod.A", "util.C", "calls")]).withColumn("origin", F.lit("dynamic")))
    trace = spark.createDataFrame([(R, "mod.A->mod.B", 10), (R, "broken", 1), (R, "no.x->no.y", 2)], "repo string, edge string, times long")
    assert tuple(graph.merge_stats(old, trace, ents).first()) == (1, 1, 2)
    assert graph.merge_dynamic(old, trace, ents).filter("origin = 'dynamic'").count() == 1


def test_five_node_health(spark):
    ents = entities(spark, [("mod_a", "module", "mod_a.py", 1, 80), ("mod_b", "module", "mod_b.py", 1, 20), ("mod_a.foo", "function", "mod_a.py", 1, 10), ("mod_a._bar", "function", "mod_a.py", 12, 80), ("mod_b.baz", "function", "mod_b.py", 1, 5)])
    rel = edges(spark, [("mod_a.foo", "mod_b.baz", "calls"), ("mod_a._bar", "mod_a.foo", "calls"), ("mod_a", "mod_b", "imports")])
    got = health.health(ents, rel).first()
    assert (got["score"], got["grade"]) == (71.0, "B")
    m = {k: v.first()["value"] if v.count() else 0 for k, v in health.metrics(ents, rel).items()}
    assert m == pytest.approx({"mc": 0.5, "cd": 0, "fi": 0, "dc": 1, "fs": 1 / 3, "mf": 0.7, "re": 0})


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vec array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, vec array<float>")
    assert [(r["id"], r["rank"]) for r in vectors.topk(v, q, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert vectors.topk(v.limit(0), q, 2).count() == 0 and vectors.topk(v, q.limit(0), 2).count() == 0
    assert value(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    with pytest.raises(Exception, match="dimension"):
        vectors.assert_dimension(v, 3).count()


def test_python_project(spark):
    src = {"src/util.py": "def add(a, b):\n    return a + b\n", "src/app.py": "from .util import add\n\n\nclass App(Base):\n    @cached\n    def run(self):\n        x = Store()\n        x.get(1)\n        self.stop()\n        return add(1, 2)\n", "src/bad.py": "def ("}
    files = readers.as_files(spark.createDataFrame([(R, p, c) for p, c in src.items()], "repo string, rel_path string, content string"))
    found = facts.extract(files).cache()
    assert {r["rel_path"] for r in found.filter("error is not null").collect()} == {"src/bad.py"}
    symbols = facts.fact_table(found, "symbols")
    assert {r["name"] for r in symbols.collect()} == {"add", "App", "App.run"}
    calls = facts.fact_table(found, "calls")
    assert {("App.run", "Store.get"), ("App.run", "App.stop"), ("App.run", "add")} <= {(r["caller"], r["callee"]) for r in calls.collect()}
    routes = spark.createDataFrame([(R, "src/app.py", "/x", "GET", "App")], "repo string, rel_path string, path string, method string, handler string")
    rel = resolve.relations(calls, facts.fact_table(found, "inheritances"), facts.fact_table(found, "imports"), routes, symbols, resolve.local_packages(files))
    got = {(r["src_id"], r["tgt_id"], r["kind"]) for r in rel.collect()}
    assert {("src.app.App.run", "src.util.add", "calls"), ("src.app", "src.util", "imports"), ("GET /x", "src.app.App", "handles")} <= got
    assert {r["id"] for r in corpus.symbol_chunks(files, symbols).collect()} == {"chunk:src.util.add", "chunk:src.app.App", "chunk:src.app.App.run"}
    assert "from .util import add" in corpus.residual_chunks(files, symbols).filter("file_path = 'src/app.py'").first()["content"]


def test_sync_is_idempotent_and_equals_a_rebuild(spark):
    hashes = lambda d: spark.createDataFrame([(R, p, h) for p, h in d.items()], "repo string, rel_path string, sha256 string")
    old, new = hashes({"a": "1", "b": "2", "c": "3"}), hashes({"a": "1", "b": "9", "d": "4"})
    assert {(r["rel_path"], r["status"]) for r in sync.file_changes(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert sync.file_changes(new, new).filter("status != 'unchanged'").count() == 0
    rows = lambda d: spark.createDataFrame([(R, p, v) for p, v in d.items()], "repo string, file_path string, v string")
    full = rows({"a": "A", "b": "B2", "d": "D"})
    got = sync.replace_files(rows({"a": "A", "b": "B", "c": "C"}), full, sync.file_changes(old, new))
    assert sorted(got.collect()) == sorted(full.collect())
    assert sync.ratchet_diff(new.select(F.col("rel_path").alias("key")), new.select(F.col("rel_path").alias("key"))).count() == 0


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -5,3 +5,8 @@
@@ -20 +30 @@
diff --git a/gone.py b/gone.py
deleted file mode 100644
@@ -1,4 +0,0 @@"""


def test_diff_and_overlap(spark):
    lines = spark.createDataFrame([("c1", i, x) for i, x in enumerate(DIFF.split("\n"))], "commit string, line_no int, line string")
    got = {tuple(r) for r in readers.diff_hunks(lines).collect()}
    assert got == {("c1", "x.py", "modified", "deleted", 5, 7), ("c1", "x.py", "modified", "added", 5, 12), ("c1", "x.py", "modified", "deleted", 20, 20), ("c1", "x.py", "modified", "added", 30, 30), ("c1", "gone.py", "deleted", "deleted", 1, 4)}
    hunks = spark.createDataFrame([("c", "f", "modified", 5, 12), ("c", "f", "modified", 18, 30), ("c", "g", "added", 1, 1), ("c", "h", "deleted", 1, 9), ("c", "w", "modified", 200, 900)], "commit string, path string, change_type string, start int, end int")
    symbols = spark.createDataFrame([("f", "s", 10, 20), ("f", "t", 31, 40), ("g", "u", 1, 4), ("h", "v", 1, 2), ("w", "wide", 100, 1000)], "path string, name string, line_start int, line_end int")
    assert {(r["path"], r["name"], r["lines_changed"]) for r in impact.changed_symbols(hunks, symbols).collect()} == {("f", "s", 6), ("g", "u", 4), ("h", "", 0), ("w", "wide", 701)}


def test_impact_chain(spark):
    rel = edges(spark, [("m.bar", "m.foo", "calls"), ("m.baz", "m.bar", "calls"), ("m.imp", "m.foo", "imports")])
    changed = spark.createDataFrame([(R, "foo", "m.foo")], "repo string, seed string, id string")
    assert {(r["id"], r["depth"]) for r in impact.callers(rel, changed).collect()} == {("m.bar", 1), ("m.baz", 2)}
    assert {r["chain"] for r in impact.call_chains(rel, changed).collect()} == {"m.bar -> m.foo", "m.baz -> m.bar -> m.foo"}
    assert [r["id"] for r in impact.lazy_importers(rel, changed).collect()] == ["m.imp"]


def test_risk_levels(spark):
    changed = spark.createDataFrame([("core", "src/auth/x.py", "f", 1), ("tests", "tests/test_x.py", "t", 90), ("heavy", "src/x.py", "pub", 30), ("small", "src/x.py", "_p", 30)], "commit string, path string, name string, lines_changed long")
    reached = spark.createDataFrame([("small", f"i{i}", "src/y.py") for i in range(3)], "commit string, id string, path string")
    assert {r["commit"]: r["level"] for r in impact.risk(changed, reached).collect()} == {"core": "high", "tests": "low", "heavy": "medium", "small": "medium"}


def test_risk_names_all_tests(spark):
    changed = spark.createDataFrame([("c", "src/x.py", "f", 1)], "commit string, path string, name string, lines_changed long")
    tests = [f"tests/test_{i:02}.py" for i in range(12)]
    reached = spark.createDataFrame([("c", f"i{n}", p) for n, p in enumerate([*tests[::-1], *tests, "src/y.py"])], "commit string, id string, path string")
    assert impact.risk(changed, reached).first()["affected_tests"] == tests


def test_endpoint_verdicts(spark):
    routes = spark.createDataFrame([(R, f"GET {p}", p, "api.py") for p in ("/api/pilots/list", "/cases", "/cases/{id}/archive", "/{id}", "/lonely/widgets", "/told/gadgets")], "repo string, key string, path string, rel_path string")
    sites = spark.createDataFrame([(R, "ui.ts", "web", "/v9/api/pilots/list/x"), (R, "ui.ts", "web", "/archive"), (R, "n.md", "doc", "/told/gadgets")], "repo string, rel_path string, kind string, path string")
    mentions = spark.createDataFrame([(R, "widgets", "other.py", "code")], "repo string, token string, rel_path string, kind string")
    got = {r["key"]: r["verdict"] for r in audit.audit_endpoints(routes, sites, mentions).collect()}
    assert got == {"GET /api/pilots/list": "ok", "GET /cases": "dead", "GET /cases/{id}/archive": "ok", "GET /{id}": "ok", "GET /lonely/widgets": "suspect", "GET /told/gadgets": "suspect"}


def test_states_fold_and_verdicts(spark):
    events = [(R, "t", "status", ["open", "gone"], True, True, None, 1), (R, "t", "status", ["open", "idle", "used"], True, True, "idle", 2)]
    domains = audit.fold_domains(spark.createDataFrame(events, "repo string, table string, column string, values array<string>, is_check boolean, is_replace boolean, default_value string, seq long"))
    assert domains.first()["values"] == ["idle", "open", "used"]
    uses = spark.createDataFrame([(R, "open", False, True, "if status == open"), (R, "used", False, False, "x = used")], "repo string, value string, is_test boolean, is_read boolean, context string")
    assert {r["value"]: r["verdict"] for r in audit.audit_states(domains, uses).collect()} == {"idle": "suspect", "open": "suspect", "used": "ok"}
    writes = spark.createDataFrame([(R, "t", "status", "error", "b:2"), (R, "t", "status", "error", "a:1"), (R, "t", "status", "open", "c:3")], "repo string, table string, column string, value string, place string")
    assert [(r["value"], r["place"]) for r in audit.illegal_writes(domains, writes).collect()] == [("error", "a:1")]


def test_envelope(spark):
    handlers = spark.createDataFrame([(R, "h1", False), (R, "h2", True), (R, "h3", False), ("bare", "h", False)], "repo string, handler string, guarded boolean")
    calls = spark.createDataFrame([(R, "h1", "svc.step"), (R, "svc.step", "db.delete"), (R, "h3", "connection.execute"), ("bare", "h", "db.delete")], "repo string, src_id string, tgt_id string")
    assert [(r["start"], r["sink"], r["hop"]) for r in audit.audit_envelope(handlers, calls).collect()] == [("h1", "db.delete", 2)]


def test_exemptions(spark):
    findings = spark.createDataFrame([("e", "GET /a", "dead"), ("e", "GET /b", "dead"), ("e", "PUT /c", "dead")], "table string, id string, verdict string")
    rules = spark.createDataFrame([("e", "GET /*", "family", 1), ("e", "GET /a", "exact", 2), ("e", "old", "stale", 3)], "table string, entry string, reason string, ord int")
    assert {r["id"]: r["exempt_reason"] for r in audit.apply_exemptions(findings, rules).collect()} == {"GET /a": "exact", "GET /b": "family", "PUT /c": None}
    assert [r["entry"] for r in audit.stale_exemptions(findings, rules).collect()] == ["old"]


def test_sources(spark, tmp_path):
    policy = spark.createDataFrame([(R, "exempt:\n  e:\n    - GET /a\n    - {id: b, reason: why}\n"), ("broken", "exempt: [unclosed")], "repo string, content string")
    rows = readers.policies(policy).collect()
    assert [(r["entry"], r["reason"]) for r in rows if r["repo"] == R] == [("GET /a", ""), ("b", "why")] and [r["repo"] for r in rows if r["error"]] == ["broken"]
    lcov = "SF:a.py\nLF:10\nLH:4\nend_of_record\nSF:b.py\nLF:2\nLH:2"
    lines = spark.createDataFrame([(R, "x", i, t) for i, t in enumerate(lcov.split("\n"))], "repo string, report string, line_no int, line string")
    assert {(r["file"], r["lh"], r["lf"]) for r in readers.lcov(lines).collect()} == {("a.py", 4, 10), ("b.py", 2, 2)}
    go = spark.createDataFrame([(R, "mode: set"), (R, "m/a.go:1.2,3.4 5 1"), (R, "m/a.go:4.2,5.4 2 0")], "repo string, line string")
    assert tuple(readers.go_profile(go).first()[1:4]) == ("m/a.go", 5, 7)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("1")
    assert [r["rel_path"] for r in readers.corpus(spark, str(tmp_path), R).collect()] == ["src/a.py"]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "kind": "class", "odd": 1}, {"id": "ghost"}], "links": [{"source": "a", "target": "ghost", "kind": "calls"}]}')
    nodes, links = readers.graph_store(spark, str(tmp_path / "g.json"), R)
    assert nodes.count() == 1 and links.first()["tgt_id"] == "ghost"
    table = assert_schema(nodes, "entities")
    readers.write_table(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        assert_schema(links, "entities")


def test_retrieval_matches_plain(spark):
    """Hits deep in a long text, entities, their prefixes and neighbours, and relations, against plain Python."""
    import re

    import numpy as np

    rng = np.random.default_rng(5)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    texts = {"long": filler(1500) + " needle haystack pin\n" * 30 + filler(1500), "one": "".join(map(chr, rng.integers(97, 123, 2500))), "blank": " \n" * 900, "few": "apple pear plum", "odd": " ".join(f"é😀{i}" for i in range(400)), **{f"t{i}": filler(300) for i in range(4)}}
    ents = {"pkg": "module box", "pkg.a": "function needle thread", "pkg.b": "class pear tree", "util": "module plum", "util.c": "function haystack"}
    rels = [("pkg.a", "pkg.b", "calls"), ("pkg.b", "util.c", "calls"), ("util.c", "ext.x", "calls"), ("util", "pkg.a", "imports"), ("util", "util.c", "handles")] + [(f"far{i}", "util.c", "calls") for i in range(30)]
    asked = {1: "needle haystack pin", 2: "apple pear plum", 3: "box", 4: "w1 w2 w3 w1", 5: "q " * 700 + "needle " * 900}
    k = 3
    chunks = spark.createDataFrame([(R, *x) for x in texts.items()], "repo string, id string, content string")
    cuts = {}
    for r in retrieve.pieces(chunks).collect():
        assert len(r["content"]) <= 1000
        cuts[r["id"]] = r["content"]
    of = lambda d: [cuts[c] for c in sorted((c for c in cuts if c.split("#")[0] == d), key=lambda c: int(c.split("#")[1]))]
    assert {d: "".join(of(d)) for d in texts if d != "blank"} == {d: t for d, t in texts.items() if d != "blank"} and not of("blank")
    assert all(re.search(r"\s$", p) for d in ("long", "t0") for p in of(d)[:-1])

    def make(texts):
        import zlib

        import numpy as np

        word = lambda w: np.random.default_rng(zlib.crc32(w.encode())).normal(size=48)
        rows = [sum((word(w) for w in t.split()), np.zeros(48)) for t in texts]
        return [(v / np.linalg.norm(v)).tolist() for v in rows]

    def best(rows, q):
        score = dict(zip(rows, np.array(make(list(rows.values())), dtype=np.float32) @ np.array(make([q])[0], dtype=np.float32), strict=True))
        top = sorted(rows, key=lambda i: -score[i])
        assert len(rows) == k or score[top[k - 1]] > score[top[k]] + 1e-6, "the fixture must have no ties at the edge"
        return [(i, float(score[i])) for i in top[:k]]

    def plain(q):
        e, c, around = best(ents, q), best(cuts, q), set()
        for i, _ in e:
            seeds = {i} | ({j for j in ents if j.startswith(i + ".")} if not any(i in r[:2] for r in rels) else set())
            seen = seeds | {b for a, b, _ in rels if a in seeds} | {a for a, b, _ in rels if b in seeds}
            around |= {r for r in rels if r[0] in seen and r[1] in seen}
        return e, c, sorted(around)[:20]

    def parsed(text):
        head, *rest = re.split(r"\n\n(?=Relations:\n|Chunks:\n)", text)
        return set(head.split("\n")[1:]), rest[0].split("\n")[1:], rest[1].removeprefix("Chunks:\n")

    described = spark.createDataFrame([(R, i, d.split()[0], d) for i, d in ents.items()], "repo string, id string, kind string, description string")
    queries = spark.createDataFrame(list(asked.items()), "qid long, text string")
    got = {r["qid"]: r for r in retrieve.retrieve(queries, described, edges(spark, rels), chunks, k, embed_texts=make).collect()}
    for q, text_ in asked.items():
        e, c, around = plain(text_)
        found, told, shown = parsed(got[q]["context"])
        assert got[q]["hits"] == 2 * k and found == {f"{ents[i].split()[0]} {i}" for i, _ in e}
        assert told == [f"{a} -{kind}-> {b}" for a, b, kind in around]
        assert sorted(shown.split("\n")) == sorted("\n".join(cuts[i][:500] for i, _ in c).split("\n"))
    assert "needle haystack pin" in got[1]["context"]

    rounds = spark.createDataFrame([(9, 1, asked[2]), (9, 0, asked[1]), (8, 0, asked[4])], "question long, round int, text string")
    by = {r["question"]: r for r in retrieve.retrieve_rounds(rounds, described, edges(spark, rels), chunks, k, make).collect()}
    assert {q: (r["sub_questions"], r["covered"], r["coverage"]) for q, r in by.items()} == {9: (2, 2, 1.0), 8: (1, 1, 1.0)}
    assert by[9]["context"] == "\n\n".join(f"## Follow-up: {asked[q]}\n{got[q]['context']}" for q in (1, 2))


def test_reports(spark):
    findings = spark.createDataFrame([("e", f"id{i}", "dead", "s") for i in range(5)], "table string, id string, verdict string, summary string")
    row = reports.findings_report(findings, 2).first()
    assert row["total"] == 5 and row["report"] == "[dead] id0 s\n[dead] id1 s"


def test_traces_and_quality(spark):
    raw = spark.createDataFrame([(R, "/p/a.ts", "/p/b.ts")] * 2 + [(R, "/p/a.ts", "/p/node_modules/x.js"), (R, "/p/a.ts", "/p/a.ts")], "repo string, from string, to string")
    assert [tuple(r) for r in runtime.module_edges(raw, F.lit("/p")).collect()] == [(R, "a", "b", 2)]
    cov = spark.createDataFrame([(R, "a", 0, 10), (R, "b", 5, 10), (R, "c", 1, 10), (R, "d", 9, 10)], "repo string, file string, lh long, lf long")
    fan = spark.createDataFrame([("a", 5), ("c", 0)], "file string, n long")
    got = {r["file"]: (r["weight"], r["dead"], r["rank"]) for r in quality.coverage_rank(cov, fan).collect()}
    assert got == {"a": (9, False, 1), "b": (None, False, 2), "c": (None, True, 1)}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "path string")
    assert {tuple(r) for r in quality.manifest_closure(names("a", "b"), names("b", "c")).collect()} == {("a", "orphan"), ("c", "stale")}


def test_long_chains_and_circles_of_reexports(spark):
    """A chain of 100 links is followed to its end; what goes round in a circle moves nothing."""
    chain = [(R, f"p{i}", f"p{i + 1}") for i in range(100)] + [(R, "c1", "c2"), (R, "c2", "c3"), (R, "c3", "c1"), (R, "to", "c1"), (R, "self", "self")]
    rel = edges(spark, [("a.f", "p0", "calls"), ("a.f", "p57", "imports"), ("a.f", "to", "calls"), ("a.f", "self", "calls")])
    got = {(r["src_id"], r["tgt_id"]) for r in graph.redirect_reexports(rel, spark.createDataFrame(chain, "repo string, phantom_id string, real_id string")).collect()}
    assert got == {("a.f", "p100"), ("a.f", "to"), ("a.f", "self")}


def test_ragged_and_null_vectors(spark):
    """Vectors of one dimension meet; null, empty and broken ones take part in nothing."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 1.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (8, [1.0, 0.1])], "id long, vec array<float>")
    q = v.withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rank"]): r["id"] for r in vectors.topk(v, q, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 8, (8, 1): 8, (8, 2): 1, (7, 1): 1, (7, 2): 7, (4, 1): 4}


def test_many_query_blocks_give_what_one_gives(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    one = sorted(map(tuple, vectors.topk(v, q, 5).select("qid", "rank", "id").collect()))
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, vectors.topk(v, q, 5).select("qid", "rank", "id").collect())) == one


def test_lists_are_bounded(spark):
    from treeline.operators.common import listed

    with pytest.raises(ValueError, match="list of over 5"):
        listed(spark.range(10), 5)


def test_python_calls_are_led_to_what_they_mean(spark):
    found = facts.python_facts("import numpy as np\nfrom m import f as g\n\n\nclass A(Base):\n    def run(self):\n        super().run()\n        self.go(1)\n        x: Store = make()\n        x.put()\n        Store.of(2)\n        Outer.Inner()\n        getattr(x, 'y')\n        np.array([])\n        g()\n")
    calls = {(c[1], c[2]) for c in found["calls"]}
    assert {("Base.run", "method"), ("A.go", "method"), ("Store.put", "method"), ("Store.of", "static_method"), ("Outer.Inner.__init__", "constructor"), ("getattr", "dynamic"), ("np.array", "method"), ("g", "function")} <= calls
    imports = spark.createDataFrame([(R, "a.py", "m", ["f"], ["g"], True, None), (R, "a.py", "numpy", [], [], False, "np")], "repo string, rel_path string, module string, names array<string>, aliases array<string>, is_from boolean, alias string")
    names = resolve.imported_names(imports, spark.createDataFrame([(R, "m")], "repo string, top string"))
    assert {(r["name"], r["target"], r["external"]) for r in names.collect()} == {("g", "m.f", False), ("np", "numpy", True)}


def test_statements():
    from treeline.operators.statements import schema_events, written_literals

    sql = "CREATE TABLE a.t (\n status text DEFAULT 'new' CHECK (status IN ('new',\n 'old')),\n n int DEFAULT 3\n);\nALTER TABLE t DROP CONSTRAINT c, ADD CONSTRAINT c CHECK (\"status\" IN ('only'));\nDROP TABLE IF EXISTS u;\nSELECT 1 WHERE x IN (1, 'a');\nCREATE TYPE \"mood\" AS ENUM ('up','down');\n"
    got = [(e["event"], e["table"], e["column"], tuple(e["values"]), e["is_replace"], e["line_start"], e["line_end"]) for e in schema_events(sql)]
    assert got == [("default", "a.t", "status", ("new",), False, 2, 2), ("check", "a.t", "status", ("new", "old"), False, 2, 3), ("check", "t", "status", ("only",), True, 6, 6), ("drop_table", "u", "", (), False, 7, 7), ("enum", "", "mood", ("up", "down"), False, 9, 9)]
    code = "x('''INSERT INTO t (a, b) VALUES ('1', f(2, '3')), ('4', 'x,(y') ON CONFLICT (a) DO UPDATE SET b = '5', c = 6''')\ny = '7'\nz(\"UPDATE t SET a = '8', b='9' WHERE c = '10'\")\ninsert into\nupdate"
    assert [(t, c, v) for t, c, v, _ in written_literals(code)] == [("t", "a", "1"), ("t", "a", "4"), ("t", "b", "x,(y"), ("t", "b", "5"), ("t", "a", "8"), ("t", "b", "9")]


def test_policy_patterns(spark):
    texts = spark.createDataFrame([("a", "exempt:\n  states: [x, {name: y, reason: z}]\nenvelope:\n  gate_patterns: [mine]\nstate_columns: [flag]\n"), ("b", "{"), ("c", "")], "repo string, content string")
    got = {r["repo"]: r for r in readers.policy_files(texts).collect()}
    assert (got["a"]["gates"], got["a"]["state_columns"], got["a"]["sinks"]) == (["mine"], ["flag"], list(text.SINKS))
    assert [(e["entry"], e["reason"]) for e in got["a"]["exempt"]] == [("x", ""), ("y", "z")]
    assert got["b"]["error"] and got["b"]["gates"] == got["c"]["gates"] == list(text.GATES) and not got["c"]["error"]


def test_audit_scan_skips_folders(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.js", ".venv-p0/c.py", "vendor/d.go", "tests/e.py", "x/indexes/f.py", "pic.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    links = spark.createDataFrame([("tests/e.py",)], "rel_path string")
    assert {r["rel_path"] for r in readers.audit_corpus(spark, str(tmp_path), R).collect()} == {"src/a.py", "tests/e.py"}
    assert {r["rel_path"] for r in readers.audit_corpus(spark, str(tmp_path), R, links=links).collect()} == {"src/a.py"}
    assert {r["rel_path"] for r in readers.corpus(spark, str(tmp_path), R).collect()} == {"src/a.py", "vendor/d.go", "x/indexes/f.py"}
