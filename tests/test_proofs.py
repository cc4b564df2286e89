"""Patterns of a repository's own policy, gaps between spans, reasons of index coverage, and whether coverage may be read."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import functions as F

from treeline.functions.text import STATE_COLUMNS, excluded
from treeline.operators import corpus, quality
from treeline.operators.common import by_policy
from treeline.plans import jobs
from treeline.sources import readers


def repos(spark, files):
    return readers.as_files(spark.createDataFrame([(r, p, c) for r, p, c in files], "repo string, rel_path string, content string"))


HANDLERS = "@router.get('/a')\n@shielded\ndef a():\n    wipe()\n\n\n@router.get('/b')\ndef b():\n    wipe()\n\n\n@router.get('/c')\n@require_admin\ndef c():\n    store.purge()\n\n\n@router.get('/d')\ndef d():\n    store.purge()\n"
SCHEMA = "CREATE TABLE t (\n mood text CHECK (mood IN ('glad', 'sadly')),\n status text CHECK (status IN ('open', 'shut'))\n);\n"
POLICY = "envelope:\n  gate_patterns: [shielded]\n  sink_patterns: [wipe]\nstate_columns: [mood]\n"


def test_policies_rule_their_own_repository(spark):
    """The same files under a policy of their own, under none, under an empty one and under one that cannot be read."""
    names = ("own", "none", "empty", "broken")
    files = repos(spark, [(r, p, c) for r in names for p, c in (("api/h.py", HANDLERS), ("db/1.sql", SCHEMA))])
    policies = readers.policy_files(spark.createDataFrame([("own", POLICY), ("empty", "envelope:\n  sink_patterns: []\n"), ("broken", "{")], "repo string, content string"))
    exempt = readers.policies(spark.createDataFrame([("own", "exempt:\n  envelope: {b: known}\n")], "repo string, content string"))
    judged, _, stale = jobs.audit_report(files, exempt, ("envelope", "states"), policies)
    got = {}
    for r in judged.collect():
        got.setdefault(r["repo"], set()).add((r["table"], r["id"], r["exempt_reason"]))
    default = {("envelope", "d", None), ("states", "state:t.status='open'", None), ("states", "state:t.status='shut'", None)}
    assert got["own"] == {("envelope", "b", "known"), ("states", "state:t.mood='glad'", None), ("states", "state:t.mood='sadly'", None)}
    assert got["none"] == got["empty"] == got["broken"] == default
    assert stale.count() == 0


def test_policy_of_a_repository_counts_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "repo string, n int")
    twice = spark.createDataFrame([("a", ["y"]), ("a", ["x"]), ("b", [])], "repo string, state_columns array<string>")
    got = {r["n"]: r["state_columns"] for r in by_policy(rows, twice, "state_columns", STATE_COLUMNS).collect()}
    assert got == {1: ["x"], 2: ["x"], 3: list(STATE_COLUMNS), 4: list(STATE_COLUMNS)}


def test_gaps_equal_plain(spark):
    spans = [("f", 2, 4), ("f", 3, 9), ("f", 9, 9), ("f", 12, 11), ("f", 14, 20), ("f", 14, 15), ("f", 40, 60), ("g", 0, 2), ("g", 2, 2), ("h", -3, 0), ("i", 1, 99)]
    text = {p: "\n".join(f"{p}{n}" for n in range(1, 31)) for p in "fghijk"} | {"k": ""}
    files = repos(spark, [("r", p, c) for p, c in text.items()])
    symbols = spark.createDataFrame([("r", p, f"s{n}", a, b) for n, (p, a, b) in enumerate(spans)], "repo string, rel_path string, name string, line_start int, line_end int")
    got = {r["file_path"]: r["content"] for r in corpus.residual_chunks(files, symbols).collect()}
    want = {}
    for p, c in text.items():
        kept = [line for n, line in enumerate(c.split("\n"), 1) if not any(q == p and a <= n <= b for q, a, b in spans)]
        if "".join(kept).strip():
            want[p] = "\n".join(kept)
    assert got == want and set(got) == {"f", "g", "h", "j"}
    assert corpus.residual_chunks(files, symbols.limit(0)).count() == 5 and corpus.residual_chunks(files.limit(0), symbols).count() == 0


def test_gaps_of_one_huge_file(spark):
    """200,000 lines and 20,000 symbols of one file: time grows with both, not with their product."""
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda n: F.concat(F.lit("l"), n.cast("string"))), "\n")
    files = readers.as_files(spark.range(1).select(F.lit("r").alias("repo"), F.lit("big.py").alias("rel_path"), line.alias("content")))
    symbols = spark.range(20_000).select(F.lit("r").alias("repo"), F.lit("big.py").alias("rel_path"), F.concat(F.lit("s"), "id").alias("name"), (F.col("id") * 10 + 1).cast("int").alias("line_start"), (F.col("id") * 10 + 9).cast("int").alias("line_end"))
    began = time.monotonic()
    rows = corpus.residual_chunks(files, symbols, 10_000_000).collect()
    assert len(rows) == 1 and rows[0]["content"].split("\n") == [f"l{n}" for n in range(10, 200_001, 10)]
    assert time.monotonic() - began < 30


def test_reasons_of_index_coverage(spark):
    files = repos(spark, [("r", p, "x") for p in ("src/a.py", "src/b.py", "lib/a.py", "new/a.py", "top.py", "build/x.py")])
    indexed = files.filter("rel_path in ('src/a.py', 'lib/a.py', 'build/x.py')")
    folders = spark.createDataFrame([("r", f) for f in ("src", "lib", "new", "build", "docs", "mine", "tests")], "repo string, top string")
    patterns = [("builtin", "**/build/**"), ("builtin", "**/tests/**"), ("ignored", "mine/"), ("user", "mine/**"), ("detected", "**/tests/**")]
    got = {r["top"]: (r["scannable"], r["indexed"], r["percent"], r["status"], r["reason"]) for r in corpus.index_coverage(files, indexed, folders, patterns).collect()}
    assert got == {
        "src": (2, 1, 50.0, "partial", None), "lib": (1, 1, 100.0, "full", None), "new": (1, 0, 0.0, "none", None), "docs": (0, 0, 0.0, "skipped", None),
        "build": (1, 1, None, "excluded", "builtin: **/build/**"), "mine": (0, 0, None, "excluded", "user: mine/**"), "tests": (0, 0, None, "excluded", "detected: **/tests/**"),
    }
    for top in ("src", "build", "mine"):
        assert files.select(excluded(F.lit(top), [p for _, p in patterns])).first()[0] == (got[top][3] == "excluded")


def test_structure_asks_for_refresh(spark):
    files = repos(spark, [(r, f"{d}/x.py", "") for r, ds in (("same", "ab"), ("more", "abc"), ("undone", "a"), ("new", "a"), ("unsaid", "a")) for d in ds])
    known = spark.createDataFrame([("same", '["a","b"]', True), ("more", '["a","b"]', True), ("undone", '["a"]', False), ("unsaid", None, True), ("gone", "[]", True)], "repo string, signature string, done boolean")
    got = {r["repo"]: r["refresh"] for r in corpus.needs_refresh(files, known).collect()}
    assert got == {"same": False, "more": True, "undone": True, "new": True, "unsaid": True}


def test_coverage_is_proven(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    reports = spark.createDataFrame([("ok", "old", day(1)), ("ok", "b", day(5)), ("ok", "a", day(5)), ("stale", "a", day(3)), ("part", "a", day(9)), ("none", "a", day(9)), ("bare", "a", day(9)), ("undated", "a", None)], "repo string, report string, mtime timestamp")
    sources = [(r, f"f{n}", day(5)) for r in ("ok", "part", "none", "undated") for n in range(10)] + [("stale", f"f{n}", day(n)) for n in range(1, 11)] + [("ok", "f0", None)]
    told = [("ok", f"f{n}", 1) for n in range(9)] + [("part", "f1", 1), ("stale", "f1", 1), ("bare", "f1", 1)] + [("undated", f"f{n}", 1) for n in range(10)]
    rows = quality.coverage_proof(spark.createDataFrame(told, "repo string, file string, lh int"), spark.createDataFrame(sources, "repo string, rel_path string, mtime timestamp"), reports)
    got = {r["repo"]: (r["report"], r["on_disk"], r["in_report"], r["newer"], r["newest"], r["state"]) for r in rows.collect()}
    assert got == {
        "ok": ("a", 10, 9, 0, [], "proven"), "stale": ("a", 10, 1, 7, ["f10", "f9", "f8", "f7", "f6"], "stale"), "part": ("a", 10, 1, 0, [], "subset"),
        "none": ("a", 10, 0, 0, [], "empty"), "bare": ("a", 0, 1, 0, [], "no_sources"), "undated": ("a", 10, 10, 0, [], "proven"),
    }
