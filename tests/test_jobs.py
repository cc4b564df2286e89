"""Whole jobs on tiny projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.operators import audit, evidence, statements, vectors
from treeline.plans import jobs
from treeline.sources import readers

R = "r"


def tree(spark, files):
    return readers.as_files(spark.createDataFrame([(R, p, c) for p, c in files.items()], "repo string, rel_path string, content string"))


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


UTIL = "def add(a, b):\n    return a + b\n"
APP = "from .util import add\n\n\ndef run():\n    return add(1, 2)\n"


def test_sync_equals_rebuild(spark):
    first = tree(spark, {"src/util.py": UTIL, "src/app.py": APP, "src/old.py": "def gone():\n    pass\n"})
    before = jobs.build(first)
    before["vectors"] = vectors.embed(before["entities"].select("repo", "id", F.lit("entity").alias("owner"), F.col("description").alias("text")))
    second = tree(spark, {"src/util.py": UTIL + "\n\ndef sub(a):\n    return add(a, 1)\n", "src/app.py": APP})
    after, full = jobs.synchronise(second, before), jobs.build(second)
    for name, cols in (("entities", ("id", "kind", "file_path", "line_end")), ("relations", ("src_id", "tgt_id", "kind")), ("chunks", ("id", "content")), ("file_hashes", ("rel_path", "sha256"))):
        assert table(after[name], *cols) == table(full[name], *cols), name
    assert ("src.app.run", "src.util.add", "calls") in table(after["relations"], "src_id", "tgt_id", "kind")
    assert table(after["summary"], "added", "modified", "unchanged", "deleted") == [(0, 1, 1, 1)]
    assert "src.old.gone" not in {r["id"] for r in after["vectors"].collect()} and "src.util.sub" in {r["id"] for r in after["vectors"].collect()}
    again = jobs.synchronise(second, after)
    assert table(again["summary"], "unchanged") == [(2,)] and table(again["entities"], "id") == table(after["entities"], "id")


def test_change_is_judged(spark):
    files = tree(spark, {"src/util.py": UTIL, "src/app.py": APP})
    built = jobs.build(files)
    hunks = spark.createDataFrame([("c", "src/util.py", "modified", 2, 2)], "commit string, path string, change_type string, start int, end int")
    got = jobs.judge_change(hunks, built["entities"], built["relations"]).first()
    assert (got["commit"], got["level"], got["callers"]) == ("c", "low", 1)


PROJECT = {
    "api/routes.py": "router = APIRouter(prefix='/v1')\n\n\n@router.get('/pilots/list')\ndef pilots():\n    return 1\n\n\n@router.post('/lonely/things')\n@require_admin\ndef lonely():\n    store.delete()\n\n\n@router.post('/open/door')\ndef door():\n    wipe()\n\n\ndef wipe():\n    store.purge()\n",
    "web/client.ts": "const x = await fetch(`/v1/pilots/list?day=${d}`)\nif (order.status == 'open') { go() }\nconst s = 'idle'\n",
    ".env": "USED_KEY=1\nLOST_KEY=2\n",
    "app/conf.py": "import os\nos.environ['USED_KEY']\n",
    "db/001.sql": "CREATE TABLE orders (\n  status text CHECK (status IN ('open','idle','never'))\n);\nINSERT INTO orders (id, status) VALUES (1, 'open'), (2, 'broken');\nUPDATE orders SET status = 'idle' WHERE id = 1;\n",
}


def test_audit_of_a_project(spark):
    exempt = spark.createDataFrame([("configs", "env:*", "known", 1), ("states", "nothing", "old", 2)], "table string, entry string, reason string, ord int")
    judged, rollup, stale = jobs.audit_report(tree(spark, PROJECT), exempt)
    got = {(r["table"], r["id"], r["verdict"]) for r in judged.collect()}
    assert ("endpoints", "GET /v1/pilots/list", "suspect") not in got and ("endpoints", "GET /v1/pilots/list", "dead") not in got
    assert {("endpoints", "POST /v1/lonely/things", "dead"), ("configs", "env:LOST_KEY", "dead"), ("states", "state:orders.status='never'", "dead"), ("states", "write:orders.status='broken'", "dead"), ("envelope", "door", "suspect")} <= got
    assert not any(i in {"env:USED_KEY", "lonely", "state:orders.status='idle'", "state:orders.status='open'"} for _, i, _ in got)
    assert {r["exempt_reason"] for r in judged.filter("table = 'configs'").collect()} == {"known"}
    assert rollup.filter("table is null").first()["total"] == judged.count() and [r["entry"] for r in stale.collect()] == ["nothing"]


def test_configuration_evidence(spark):
    files = tree(spark, {"conf/settings.py": "MAX_SIZE = 1\nUSED_HERE = 2\nx = USED_HERE\n\nclass S:\n    model_config = C(env_prefix='app_')\n    port: int\n", "docker-compose.yml": "services:\n  a:\n    image: ${IMAGE_TAG:-x}\n"})
    assert table(evidence.config_constants(files), "name", "self_used") == [("MAX_SIZE", False), ("USED_HERE", True)]
    assert table(evidence.settings_keys(files), "key") == [("APP_PORT",)]
    assert table(evidence.interpolations(files), "key") == [("IMAGE_TAG",)]
    drops = evidence.drop_events(tree(spark, {"a.sql": "ALTER TABLE t DROP COLUMN c;\nDROP TABLE u;\n"}))
    assert table(drops.fillna(""), "table", "column") == [("t", "c"), ("u", "")]


def test_repositories_do_not_mix(spark):
    """Two repositories with the same paths: exemptions, commits and coverage of one say nothing of the other."""
    findings = spark.createDataFrame([("a", "e", "x1", "dead"), ("b", "e", "x1", "dead"), ("b", "e", "x2", "dead")], "repo string, table string, id string, verdict string")
    rules = spark.createDataFrame([("a", "e", "x1", "why", 1), ("a", "e", "x[2-9]", "class", 2), ("b", "e", "y*", "stale", 1)], "repo string, table string, entry string, reason string, ord int")
    assert table(audit.apply_exemptions(findings, rules).fillna("-"), "repo", "id", "exempt_reason") == [("a", "x1", "why"), ("b", "x1", "-"), ("b", "x2", "-")]
    assert table(audit.stale_exemptions(findings, rules), "repo", "entry") == [("a", "x[2-9]"), ("b", "y*")]
    body = {"m.py": "def f():\n    pass\n"} | {f"u{i}.py": "from m import f\n\n\ndef g():\n    f()\n" for i in range(12)}
    files = readers.as_files(spark.createDataFrame([("b", p, c) for p, c in body.items()] + [("a", "m.py", body["m.py"])], "repo string, rel_path string, content string"))
    built = jobs.build(files)
    hunks = spark.createDataFrame([("a", "c1", "m.py", "modified", 2, 2), ("b", "c1", "m.py", "modified", 2, 2)], "repo string, commit string, path string, change_type string, start int, end int")
    want = [("a", "c1", "low", 0), ("b", "c1", "high", 12)]
    assert table(jobs.judge_change(hunks, built["entities"], built["relations"]), "repo", "commit", "level", "callers") == want
    assert table(jobs.judge_change(hunks.drop("repo").distinct(), built["entities"], built["relations"]), "repo", "commit", "level", "callers") == want


def test_long_statements_are_read_whole():
    """However long the list of columns, what stands within the fixed reach after it is read; a literal that goes on beyond that is not."""
    for n in (3, 300, 3000):
        names = [f"column_{i}" for i in range(n)]
        text = f"INSERT INTO t ({', '.join(names)}) VALUES ('a'{', 1' * 20});\nINSERT INTO u (x, y) VALUES ('b', 'c'), (1, 'd') ON CONFLICT DO UPDATE SET x = 'e', y = 2 WHERE z = 'f'"
        got = [x[:3] for x in statements.written_literals(text)]
        assert [g for g in got if g[0] == "u"] == [("u", "x", "b"), ("u", "y", "c"), ("u", "y", "d"), ("u", "x", "e")]
        wide = f"INSERT INTO t ({', '.join(names)}) VALUES ({', '.join(['0'] * (n - 1))}, 'last')"
        assert [x[:3] for x in statements.written_literals(wide)] == ([("t", names[-1], "last")] if n <= 200 else [])
    over = "INSERT INTO t (a, b) VALUES ('x', '" + "y" * 900 + "'), ('p', 'q')"
    assert list(statements.written_literals(over)) == []


def test_paths_with_brackets(spark):
    lines = ["go('/app/(auth)/login')", "go(`/a/(b)/c/d`)", "go('/x/y/(z)')"]
    got = [sorted(r[0]) for r in spark.createDataFrame([(line,) for line in lines], "line string").select(evidence.line_paths(F.col("line"))).collect()]
    assert got == [["/login"], ["/c", "/c/d"], ["/x/y"]]


def test_settings_and_handlers_are_parsed(spark):
    code = "env_prefix: str = ''\nclass A(BaseSettings):\n    model_config = dict(env_prefix='app_')\n    Port: int\n    port: int = 1\n    host = 'x'\n\n\nclass B:\n    class Config:\n        env_prefix = 'old_'\n    url: str\n"
    files = tree(spark, {"conf/a.py": code, "conf/broken.py": "env_prefix='z_'\nclass X(:\n    y: int\n", "tests/t.py": code})
    assert table(evidence.settings_keys(files), "key") == [("APP_PORT",), ("APP_URL",), ("OLD_PORT",), ("OLD_URL",)]
    routes = "@router.get('/a')\n@require_admin\nasync def a(\n    x: int = 1,\n): return 1\n\n\n@app.route('/b', methods=['POST'])\ndef b(user=Depends(current_user)):\n    pass\n\n\n@router.post('/c')\ndef c():\n    current_user()\n\n\n@cached\ndef d(): pass\n\n\n@a.b.get('/e')\ndef e(): pass\n"
    assert table(evidence.routed_handlers(tree(spark, {"api.py": routes})), "handler", "guarded") == [("a", True), ("b", True), ("c", False)]
