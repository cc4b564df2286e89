"""Queries on checks, coverage totals, folder signals, importers and the sinks of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import ids, text
from treeline.operators import audit, corpus, evidence, quality, sync, vectors
from treeline.plans.bindings import REPO, Tables, with_tables
from treeline.sources import readers, reports

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def text_of(c: str):
    return F.col(c).cast("string")


# --- coverage and checks ----------------------------------------------------------------------------------------------

COVERED = "c AS (SELECT 'tpc' AS repo, p_brand AS file, sum(p_size//2) AS lh, sum(p_size) AS lf FROM part GROUP BY 2)"


def covered(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lit(REPO).alias("repo"), F.col("p_brand").alias("file")).agg(F.sum(F.floor(F.col("p_size") / 2)).alias("lh"), F.sum("p_size").alias("lf"))


@query(f"WITH {COVERED} SELECT repo, sum(lh)::BIGINT AS lh, sum(lf)::BIGINT AS lf, 100.0*sum(lh)/greatest(sum(lf),1) AS line_rate, count(*) AS files FROM c GROUP BY 1")
def coverage_totals(t: Tables) -> DataFrame:
    return quality.coverage_totals(covered(t))


@query("SELECT 'c_'||c_mktsegment||'/'||n AS folder, f AS files, l AS lines, s AS milestone_share FROM (SELECT c_mktsegment, c_nationkey AS n, count(*) AS f, sum(c_custkey%9) AS l, count(*) FILTER (WHERE c_custkey%4=0)/count(*)::DOUBLE AS s FROM customer GROUP BY 1,2) UNION ALL SELECT NULL, count(*), sum(c_custkey%9), count(*) FILTER (WHERE c_custkey%4=0)/count(*)::DOUBLE FROM customer")
def test_corpus(t: Tables) -> DataFrame:
    """Customers as test files of their segment and nation; every fourth is named for a milestone."""
    path = F.concat(F.lit("c_"), F.col("c_mktsegment"), F.lit("/"), text_of("c_nationkey"), F.lit("/t"), text_of("c_custkey"), F.when(F.col("c_custkey") % 4 == 0, "_milestone").otherwise(""))
    return quality.test_corpus(t.customer.select(path.alias("rel_path"), (F.col("c_custkey") % 9).alias("n_lines")))


@query("WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber IN (1,3,5,7) GROUP BY 1), k AS (SELECT s_suppkey, coalesce(n,0)+CASE WHEN s_suppkey%3=0 THEN 1 ELSE 0 END AS runs FROM supplier LEFT JOIN r ON l_suppkey=s_suppkey) SELECT 'ci/check_'||s_suppkey||'.sh' AS path, 'check_'||s_suppkey||'.sh' AS name, runs, CASE WHEN runs=0 THEN 'never' WHEN runs>1 THEN 'duplicate' ELSE 'once' END AS state FROM k")
def check_executions(t: Tables) -> DataFrame:
    """Suppliers as checkers, every third registered; line items are lines of runners, which run them, name them or stand in a comment by their number."""
    name = F.concat(F.lit("check_"), text_of("l_suppkey"), F.lit(".sh"))
    shapes = ("  bash ci/@ --all", "# bash ci/@", "step unit $PY ci/@", "echo ci/@", "\"node\" 'ci/@'", "cov a b ci/@", "spawn all /opt/x@")
    line = F.replace(F.get(F.array(*[F.lit(x) for x in shapes]), F.col("l_linenumber") - 1), F.lit("@"), name)
    checkers = t.supplier.select("s_suppkey", F.concat(F.lit("check_"), text_of("s_suppkey"), F.lit(".sh")).alias("name")).withColumn("path", F.concat(F.lit("ci/"), "name"))
    return quality.executions(t.lineitem.select(line.alias("line")), checkers, checkers.filter("s_suppkey % 3 = 0").select("path"))


@query("SELECT 'ci/check_'||s_suppkey AS path, 'orphan' AS state FROM supplier WHERE s_suppkey%5=0 UNION ALL SELECT 'ci/check_'||s_suppkey, 'stale' FROM supplier WHERE s_suppkey%7=0 AND s_suppkey%5<>0")
def manifest_closure(t: Tables) -> DataFrame:
    """Suppliers as checks: every fifth is not registered, every seventh not on disk."""
    path = F.concat(F.lit("ci/check_"), text_of("s_suppkey"))
    rows = t.supplier.select("s_suppkey", path.alias("path"))
    lines = rows.filter("s_suppkey % 5 != 0").select(F.concat("path", F.lit("|a note")).alias("line"))
    return quality.manifest_closure(rows.filter("s_suppkey % 7 != 0 or s_suppkey % 5 = 0"), readers.gate_manifest(lines))


@query("SELECT 'docs' AS repo, 'ci/'||name AS rel_path, role, len(regexp_extract_all(content,'\\bassert\\b')) AS asserts, len(regexp_extract_all(content,'\\bexit\\b')) AS exits, len(regexp_extract_all(content,'\\bskip')) AS skips FROM (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'run-'||doc_id||'.sh' WHEN 1 THEN 'check_'||doc_id||'.py' WHEN 2 THEN doc_id||'_manifest.txt' END AS name, ['runner','checker','manifest'][doc_id%4+1] AS role, replace(replace(coalesce(text,''),'the','assert'),'token','exit skips') AS content FROM documents) WHERE name IS NOT NULL")
def gate_signals(t: Tables) -> DataFrame:
    """Documents as runners, checkers and manifests."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("run-"), text_of("doc_id"), F.lit(".sh"))).when(k == 1, F.concat(F.lit("check_"), text_of("doc_id"), F.lit(".py"))).when(k == 2, F.concat(text_of("doc_id"), F.lit("_manifest.txt"))).otherwise("other.txt")
    content = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("assert")), F.lit("token"), F.lit("exit skips"))
    return evidence.gate_signals(t.documents.select(F.lit("docs").alias("repo"), F.concat(F.lit("ci/"), name).alias("rel_path"), content.alias("content")))


@query(
    "WITH s AS (SELECT s_suppkey AS k, 'ci/check_'||s_suppkey||'.py' AS checker, 'ci/run-'||s_suppkey||'.sh' AS runner FROM supplier) SELECT 'tpc' AS repo, rel_path, line_no, kind, phase, targets, detail FROM ("
    "SELECT runner AS rel_path, 3 AS line_no, 'pytest_selector' AS kind, 'unit-'||k AS phase, ['test_a'||k||'.py','test_b.py'] AS targets, 'fast and not s'||k AS detail FROM s WHERE k%2=0"
    " UNION ALL SELECT checker, 1, 'hardcoded_constant', NULL, CAST([] AS VARCHAR[]), 'assert not (len(rows) != '||k||')' FROM s WHERE k%5<2"
    " UNION ALL SELECT checker, 3, 'vacuous_scan', NULL, CAST([] AS VARCHAR[]), 'lib/gone_'||k||'.py' FROM s WHERE k%3=0)"
)
def vacuous_checks(t: Tables) -> DataFrame:
    """Suppliers as a runner and a checker each: every second selects its tests, two of five write a size down, every third scans a file that is not there."""
    k = text_of("s_suppkey")
    tests = F.concat(F.lit("  $PY -m pytest core/tests/test_a"), k, F.lit(".py \\\n   tests/test_b.py \\\n"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("   -k 'fast and not s"), k, F.lit("'"))).otherwise("   -q"))
    runner = F.concat(F.lit("pytest tests/test_out.py -k 'x'\nif selected unit-"), k, F.lit("; then\n"), tests, F.lit("\nfi\npytest tests/test_out.py -k 'x'\nif selected cut; then\npytest tests/t.py -k 'x' \\\nfi\n"))
    sized = F.when(F.col("s_suppkey") % 5 < 2, F.concat(F.lit("  assert not (len(rows) != "), k, F.lit(")\n"))).otherwise("assert len(cells) == 4\n")
    scan = F.concat(F.lit("grep -q word $ROOT/ci && rg -n 'a b' ${ROOT}/"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("lib/gone_"), k, F.lit(".py"))).otherwise(F.concat(F.lit("ci/run-"), k, F.lit(".sh"))))
    checker = F.concat(sized, F.lit("# len(x) != 3\n"), scan)
    rows = t.supplier.select(F.explode(F.array(F.struct(F.concat(F.lit("ci/run-"), k, F.lit(".sh")).alias("rel_path"), runner.alias("content")), F.struct(F.concat(F.lit("ci/check_"), k, F.lit(".py")).alias("rel_path"), checker.alias("content")))).alias("f"))
    files = readers.as_files(rows.select(F.lit(REPO).alias("repo"), "f.rel_path", "f.content"))
    runners, checkers = (files.join(evidence.gate_signals(files).filter(F.col("role") == role).select("repo", "rel_path"), ["repo", "rel_path"], "left_semi") for role in ("runner", "checker"))
    return quality.vacuous_checks(corpus.lines(runners), corpus.lines(checkers), files)


CELLS = (("lint", "style", r"(^|/)ruff\.toml$", "ruff check"), ("test", "unit", r"(^|/)pytest\.ini$", "pytest"), ("build", "image", r"(^|/)Dockerfile$", "docker build"))
MATRIX = ", ".join(f"('{a}','{b}',{n})" for n, (a, b, _, _) in enumerate(CELLS))


@query(with_tables("nat cust", f"r AS (SELECT n AS repo, n_nationkey FROM nat WHERE n IN (SELECT split_part(id,'.',1) FROM cust)), c(layer, cell, k) AS (VALUES {MATRIX})") + "SELECT repo, layer, cell, CASE WHEN (n_nationkey+k)%3=0 THEN 'OK' WHEN (n_nationkey+k)%3=1 THEN 'CONFIGURED_NOT_RUN' ELSE 'MISSING' END AS state, CASE WHEN (n_nationkey+k)%3=1 THEN ['a/ruff.toml','a/pytest.ini','a/Dockerfile'][k+1] END AS evidence FROM r, c")
def assurance_matrix(t: Tables) -> DataFrame:
    """Nations as repositories, their customers as files; each configures one check and runs another."""
    nation = t.nations().select(F.col("n").alias("repo"), "n_nationkey")
    files = t.callers().select(F.substring_index("id", ".", 1).alias("repo"), F.col("file_path").alias("rel_path"), F.lit("code").alias("kind"), F.lit("pass").alias("content"))
    for k, (_, _, _, run) in enumerate(CELLS):
        name = ("a/ruff.toml", "a/pytest.ini", "a/Dockerfile")[k]
        own = nation.join(t.callers().select(F.substring_index("id", ".", 1).alias("repo")).distinct(), "repo")
        files = files.unionByName(own.filter((F.col("n_nationkey") + k) % 3 == 1).select("repo", F.lit(name).alias("rel_path"), F.lit("other").alias("kind"), F.lit("").alias("content")))
        files = files.unionByName(own.filter((F.col("n_nationkey") + k) % 3 == 0).select("repo", F.lit(f"ci{k}.yml").alias("rel_path"), F.lit("config").alias("kind"), F.lit(f"- {run} .").alias("content")))
    rules = t.spark.createDataFrame(list(CELLS), "layer string, cell string, config_like string, run_like string")
    return quality.assurance_matrix(rules, files)


@query("WITH c AS (SELECT source, lang, doc_id, len(list_filter(['the','der','que'], lambda w: contains(lower(text), w)))-len(list_filter(['token','license'], lambda w: contains(lower(text), w))) AS score, text FROM documents WHERE text IS NOT NULL) SELECT layer, code, source, score FROM (SELECT lang AS layer, source AS code, 'd'||doc_id%7 AS source, max(score) AS score FROM c WHERE score>0 GROUP BY 1,2,3)")
def candidate_triage(t: Tables) -> DataFrame:
    """Documents as candidates: stop words speak for them, tokens and licenses against."""
    rows = t.documents.filter("text is not null").select(F.col("lang").alias("layer"), F.col("source").alias("code"), F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("source"), "text")
    return quality.triage(rows, ("the", "der", "que"), ("token", "license")).select("layer", "code", "source", "score")


# --- folders and frameworks -------------------------------------------------------------------------------------------

NAMES = ("user_config", "app_settings", "on_event", "event_handler", "view_factory", "db_adapter", "main", "other", "conftest", "x_test")
NAMED = f"f AS (SELECT split_part(id,'.',1) AS repo, key, {list(NAMES)!r}[key%10+1] AS name, balance<0 AS deep FROM cust)"


def named_files(t: Tables) -> DataFrame:
    """Customers as files of their nation's repository; those in debt lie deep."""
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("key") % 10).cast("int"))
    folder = F.when(F.col("balance") < 0, "a/b/c/d/e/").otherwise(F.concat(F.lit("s"), (F.col("key") % 3).cast("string"), F.lit("/")))
    path = F.concat(folder, name, F.when(F.col("key") % 10 == 9, ".go").otherwise(".py"))
    return readers.as_files(t.callers().select(F.substring_index("id", ".", 1).alias("repo"), path.alias("rel_path"), F.lit("x").alias("content")))


#: More names with their folders: technical layers, deep folders, and what is passed over.
LAID = ("models/user", "app/views/env_list", "app/Controllers/bus", "docs/settings", "a/b/c/d/e/f/hook", "tests/state_builder", "app/mock_options", ".x/proxy", "event", "services/command-template")
LAID_SQL = f"l AS (SELECT split_part(id,'.',1) AS repo, {list(LAID)!r}[key%10+1] AS place FROM cust WHERE balance>=2000 UNION ALL SELECT repo, CASE WHEN deep THEN 'a/b/c/d/e/' ELSE 's'||key%3||'/' END||name FROM f)"
STEMS = "g AS (SELECT repo, place, string_split(place,'/')[1:len(string_split(place,'/'))-1] AS dirs, replace(lower(string_split(place,'/')[-1]),'-','_') AS stem FROM l WHERE NOT regexp_matches(place,'^(docs|tests|\\.x)/')), d AS (SELECT DISTINCT repo, unnest(range(1,len(dirs)+1)) AS n, dirs FROM g), dd AS (SELECT repo, count(DISTINCT CASE WHEN lower(dirs[n]) IN ('models','views','controllers','services') THEN lower(dirs[n]) END) AS layers, count(DISTINCT CASE WHEN n>=5 THEN array_to_string(dirs[1:n],'/') END) AS deep FROM d GROUP BY 1)"
COUNTS = "k AS (SELECT repo, count(*) FILTER (WHERE s AND regexp_matches(stem,'config|settings|options|env|constants|defaults|schema|flags|preferences|params')) AS config, count(*) FILTER (WHERE s AND regexp_matches(stem,'event|emitter|listener|subscriber|publisher|dispatch|handler|bus|signal|observable|hook')) AS event, count(*) FILTER (WHERE s AND regexp_matches(stem,'factory|strategy|observer|adapter|decorator|builder|singleton|mediator|proxy|facade|visitor|command|state|template')) AS pattern FROM (SELECT *, len(dirs)>0 AND NOT regexp_matches(stem,'test|spec|mock|fixture') AS s FROM g) GROUP BY 1)"


@query(with_tables("cust", f"{NAMED}, {LAID_SQL}, {STEMS}, {COUNTS}") + "SELECT repo, config, event, pattern, layers, deep, config>=5 AS many_config, event>=4 AS many_event, pattern>=3 AS many_pattern, layers>=3 AS many_layers, deep>=1 AS many_deep FROM (SELECT k.*, coalesce(layers,0) AS layers, coalesce(deep,0) AS deep FROM k LEFT JOIN dd USING (repo))")
def naming_signals(t: Tables) -> DataFrame:
    more = F.get(F.array(*[F.lit(n) for n in LAID]), (F.col("key") % 10).cast("int"))
    laid = t.callers().filter("balance >= 2000").select(F.substring_index("id", ".", 1).alias("repo"), F.concat(more, F.lit(".ts")).alias("rel_path"), F.lit("x").alias("content"))
    return corpus.naming_signals(named_files(t).unionByName(readers.as_files(laid)))


@query(with_tables("cust", NAMED) + "SELECT repo, '['||string_agg('\"'||top||'\"', ',' ORDER BY top)||']' AS signature FROM (SELECT DISTINCT repo, CASE WHEN deep THEN 'a' ELSE 's'||key%3 END AS top FROM f) GROUP BY 1")
def structure_signature(t: Tables) -> DataFrame:
    return corpus.structure_signature(named_files(t))


@query(with_tables("cust", NAMED) + "SELECT repo, list_sort(list(DISTINCT CASE WHEN name='x_test' THEN 'go' ELSE 'python' END)) AS languages FROM f WHERE NOT deep GROUP BY 1")
def language_set(t: Tables) -> DataFrame:
    return corpus.language_set(named_files(t))


#: Files that show a framework or a test folder, one for each nation by its key, with what is in them.
SHOWN = (
    ("sub/conftest.py", "x"), ("a/b/conftest.py", "x"), ("pyproject.toml", "[tool.pytest.ini_options]"), ("pyproject.toml", "[tool.ruff]"), ("setup.cfg", "[tool:pytest]"), ("web/jest.config.mjs", "x"), ("package.json", '{"jest": 1}'),
    ("package.json", '{"vitest": 1}'), ("web/package.json", '{"jest": 1}'), ("cypress/a.ts", "x"), ("playwright.config.ts", "x"), ("go.mod", "x"), ("src/test/java/A.java", "x"), ("Cargo.toml", "x"), ("tests/a.rs", "x"), ("spec/b.rb", "x"), ("x/e2e/c.ts", "x"),
)
SHOWN_SQL = ", ".join(f"({n}, '{p}', '{c}')" for n, (p, c) in enumerate(SHOWN))
SCRIPTS = "['**/__tests__/**','**/*.test.ts','**/*.test.tsx','**/*.test.js','**/*.test.jsx','**/*.spec.ts','**/*.spec.tsx','**/*.spec.js','**/*.spec.jsx']"
FRAMES = f"""w AS (SELECT n AS repo, p, c FROM nat, (VALUES {SHOWN_SQL}) v(k, p, c) WHERE (n_nationkey*3+k*k)%7<2 UNION ALL SELECT n, 'm/a_test.go', 'x' FROM nat WHERE n_nationkey%2=0),
fw AS (SELECT DISTINCT repo, CASE WHEN p IN ('sub/conftest.py','setup.cfg') OR (p='pyproject.toml' AND contains(c,'pytest')) THEN 'pytest' WHEN p='web/jest.config.mjs' OR (p='package.json' AND contains(c,'jest')) THEN 'jest' WHEN p='package.json' THEN 'vitest' WHEN p='cypress/a.ts' THEN 'cypress' WHEN p='playwright.config.ts' THEN 'playwright'
  WHEN p='go.mod' AND repo IN (SELECT repo FROM w WHERE p='m/a_test.go') THEN 'go test' WHEN p='src/test/java/A.java' THEN 'java/maven' WHEN p='Cargo.toml' AND repo IN (SELECT repo FROM w WHERE p='tests/a.rs') THEN 'rust' END AS fw FROM w),
pt AS (SELECT repo, unnest(CASE fw WHEN 'pytest' THEN ['**/test_*.py','**/*_test.py','**/conftest.py','**/tests/**'] WHEN 'jest' THEN {SCRIPTS} WHEN 'vitest' THEN {SCRIPTS} WHEN 'cypress' THEN ['**/cypress/**','**/*.cy.ts','**/*.cy.js'] WHEN 'playwright' THEN ['**/*.spec.ts','**/*.spec.js','**/e2e/**'] WHEN 'go test' THEN ['**/*_test.go'] WHEN 'java/maven' THEN ['**/src/test/**'] ELSE ['**/tests/**'] END) AS pattern FROM fw WHERE fw IS NOT NULL),
dirs AS (SELECT repo, '**/'||split_part(p,'/',1)||'/**' AS pattern FROM w WHERE p IN ('tests/a.rs','spec/b.rb','cypress/a.ts') EXCEPT SELECT repo, pattern FROM pt)"""


@query(with_tables("nat", FRAMES) + "SELECT repo, list_sort(coalesce((SELECT list(fw) FROM (SELECT fw FROM fw WHERE fw.repo=r.repo AND fw IS NOT NULL UNION SELECT 'folders' FROM dirs WHERE dirs.repo=r.repo)), [])) AS frameworks, list_sort(coalesce((SELECT list(pattern) FROM (SELECT pattern FROM pt WHERE pt.repo=r.repo UNION SELECT pattern FROM dirs WHERE dirs.repo=r.repo)), [])) AS patterns FROM (SELECT DISTINCT repo FROM w) r")
def test_frameworks(t: Tables) -> DataFrame:
    """Each nation shows some of the files, and every second one has a Go test besides."""
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(p).alias("p"), F.lit(c).alias("c")) for n, (p, c) in enumerate(SHOWN)])).alias("s")
    some = t.nations().select(F.col("n").alias("repo"), "n_nationkey", every).filter((F.col("n_nationkey") * 3 + F.col("s.k") * F.col("s.k")) % 7 < 2).select("repo", F.col("s.p").alias("rel_path"), F.col("s.c").alias("content"))
    tests = t.nations().filter("n_nationkey % 2 = 0").select(F.col("n").alias("repo"), F.lit("m/a_test.go").alias("rel_path"), F.lit("x").alias("content"))
    return corpus.test_frameworks(readers.as_files(some.unionByName(tests)))


@query("SELECT DISTINCT 'parts' AS repo, '**/'||top||'/**' AS pattern FROM (SELECT ['src','.venv-p0','venv','indexes','Saas_Repos','virtualenv_3'][p_partkey%6+1] AS top FROM part) WHERE top NOT IN ('src','venv')")
def generated_patterns(t: Tables) -> DataFrame:
    top = F.get(F.array(*[F.lit(x) for x in ("src", ".venv-p0", "venv", "indexes", "Saas_Repos", "virtualenv_3")]), (F.col("p_partkey") % 6).cast("int"))
    return readers.generated_patterns(t.part.select(F.lit("parts").alias("repo"), F.concat(top, F.lit("/f"), text_of("p_partkey")).alias("rel_path")))


# --- importers, maintenance, keys -------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'tpc' AS repo, 's/m'||l_suppkey||'.py' AS rel_path FROM lineitem WHERE l_discount>0.05 AND l_suppkey<>l_partkey%10+1")
def importer_map(t: Tables) -> DataFrame:
    """Suppliers as scripts; line items of other scripts import a name of them."""
    scripts = t.supplier.select(F.lit(REPO).alias("repo"), F.concat(F.lit("s/m"), text_of("s_suppkey"), F.lit(".py")).alias("rel_path"))
    by = F.concat(F.lit("s/m"), (F.col("l_partkey") % 10 + 1).cast("string"), F.lit(".py"))
    imports = t.lineitem.filter("l_discount > 0.05").select(F.lit(REPO).alias("repo"), by.alias("rel_path"), F.concat(F.lit("s.m"), text_of("l_suppkey"), F.lit(".run")).alias("module"))
    return quality.importer_map(imports, scripts)


@query("SELECT 'f'||o_orderkey AS rel_path, CASE WHEN o_orderkey%4>0 AND o_orderkey%3>0 THEN 'h'||o_orderkey END AS sha256 FROM orders")
def reused_hashes(t: Tables) -> DataFrame:
    """Orders as files: every fourth has a new time, every third a new size; the rest keeps its hash, unread."""
    o = t.orders.select(F.lit(REPO).alias("repo"), F.concat(F.lit("f"), text_of("o_orderkey")).alias("rel_path"), F.col("o_orderkey").alias("k"))
    known = o.select("repo", "rel_path", F.lit(1).alias("mtime"), F.lit(1).alias("length"), F.concat(F.lit("h"), text_of("k")).alias("sha256"))
    now = o.select("repo", "rel_path", F.when(F.col("k") % 4 == 0, 2).otherwise(1).alias("mtime"), F.when(F.col("k") % 3 == 0, 2).otherwise(1).alias("length"))
    kept, to_read = sync.reuse_hashes(now, known)
    return kept.select("rel_path", "sha256").unionByName(to_read.select("rel_path", F.lit(None).cast("string").alias("sha256")))


@query("SELECT DISTINCT 'f'||o_custkey AS file FROM orders WHERE o_orderdate>DATE '1997-06-01'")
def changed_since(t: Tables) -> DataFrame:
    """Orders as commits to their customer's file."""
    return sync.changed_since(t.orders.select(F.concat(F.lit("f"), text_of("o_custkey")).alias("file"), F.col("o_orderdate").cast("timestamp").alias("ts")), "1997-06-01")


@query("WITH m AS (SELECT DISTINCT 'm/'||p_size||'.txt' AS f, lower(p_brand) AS p FROM part WHERE p_size<40), x AS (SELECT lower(p_brand) AS p, p_type AS a FROM part) SELECT coalesce(f,'?')||'|'||a||'|'||count(*) AS key FROM x LEFT JOIN m USING (p) GROUP BY f, a")
def vulnerability_keys(t: Tables) -> DataFrame:
    """Brands as packages, types as advisories, sizes as manifests."""
    manifests = t.part.filter("p_size < 40").select(F.concat(F.lit("m/"), text_of("p_size"), F.lit(".txt")).alias("rel_path"), F.upper("p_brand").alias("package"))
    return sync.vulnerability_keys(t.part.select(F.col("p_brand").alias("package"), F.col("p_type").alias("advisory")), manifests)


VERDICTS = "f AS (SELECT ['endpoints','configs','states'][c_nationkey%3+1] AS \"table\", c_name AS id, CASE WHEN c_acctbal<0 THEN 'dead' ELSE 'suspect' END AS verdict, c_mktsegment AS summary, c_custkey%5=0 AS exempt FROM customer)"


def customer_findings(t: Tables) -> DataFrame:
    kind = F.get(F.array(F.lit("endpoints"), F.lit("configs"), F.lit("states")), (F.col("c_nationkey") % 3).cast("int"))
    return t.customer.select(kind.alias("table"), F.col("c_name").alias("id"), F.when(F.col("c_acctbal") < 0, "dead").otherwise("suspect").alias("verdict"), F.col("c_mktsegment").alias("summary"), F.when(F.col("c_custkey") % 5 == 0, "known").alias("exempt_reason"))


@query(f"WITH {VERDICTS}, s AS (SELECT count(*) FILTER (WHERE NOT exempt AND verdict='dead')>0 AS dead, count(*) FILTER (WHERE NOT exempt)>0 AS every FROM f) SELECT mode, CASE mode WHEN 'dead' THEN dead WHEN 'any' THEN every WHEN 'new' THEN true ELSE false END AS fails FROM s, (VALUES ('dead'),('any'),('new'),('never')) m(mode)")
def fail_on(t: Tables) -> DataFrame:
    """Whether a run over customers as findings fails, by mode."""
    rollup = audit.audit_rollup(customer_findings(t))
    rows = [audit.fail_on(rollup, 1, m).select(F.lit(m).alias("mode"), "fails") for m in ("dead", "any", "new", "never")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"WITH {VERDICTS}, n AS (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY verdict, id) AS k, count(*) OVER (PARTITION BY \"table\") AS total FROM f) SELECT \"table\", total, string_agg('['||verdict||'] '||id||' '||summary, chr(10) ORDER BY k) AS report FROM n WHERE k<=20 GROUP BY 1,2")
def findings_report(t: Tables) -> DataFrame:
    return reports.findings_report(customer_findings(t))


@query("WITH d AS (SELECT source, 'd'||doc_id AS id, CASE WHEN lang='de' THEN 'fixed' ELSE 'new' END AS change FROM documents) SELECT change, count(*) AS total, string_agg(id, chr(10) ORDER BY id) AS report FROM d GROUP BY 1")
def delta_report(t: Tables) -> DataFrame:
    return reports.delta_report(t.documents.select(F.concat(F.lit("d"), text_of("doc_id")).alias("id"), F.when(F.col("lang") == "de", "fixed").otherwise("new").alias("change")))


CONTEXT = "WITH e AS (SELECT c_nationkey AS qid, 'function '||c_name AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS k FROM customer), s AS (SELECT s_nationkey AS qid, s_name AS id, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS k FROM supplier), c AS (SELECT doc_id%25 AS qid, substr(text,1,500) AS t, row_number() OVER (PARTITION BY doc_id%25 ORDER BY n_chars DESC, 'd'||doc_id) AS k FROM documents WHERE text IS NOT NULL), x AS (SELECT qid, string_agg(t, chr(10) ORDER BY k) AS e FROM e WHERE k<=10 GROUP BY 1), y AS (SELECT qid, string_agg('n'||qid||' -calls-> '||id, chr(10) ORDER BY k) AS r FROM s WHERE k<=20 GROUP BY 1), z AS (SELECT qid, string_agg(t, chr(10) ORDER BY k) AS c FROM c WHERE k<=5 GROUP BY 1)"


@query(CONTEXT + "SELECT coalesce(x.qid, y.qid, z.qid) AS qid, array_to_string(list_filter(['Entities:'||chr(10)||e, 'Relations:'||chr(10)||r, 'Chunks:'||chr(10)||c], lambda v: v IS NOT NULL), chr(10)||chr(10)) AS context FROM x FULL JOIN y ON x.qid=y.qid FULL JOIN z ON coalesce(x.qid,y.qid)=z.qid")
def context_texts(t: Tables) -> DataFrame:
    """Nations as queries: their customers are entities, suppliers relations, and documents chunks."""
    entities = t.customer.select(F.col("c_nationkey").cast("long").alias("qid"), F.col("c_name").alias("id"), F.lit("function").alias("kind"), F.col("c_acctbal").alias("score"))
    relations = t.supplier.select(F.col("s_nationkey").cast("long").alias("qid"), F.concat(F.lit("n"), text_of("s_nationkey")).alias("src_id"), F.col("s_name").alias("tgt_id"), F.lit("calls").alias("kind"))
    chunks = t.documents.filter("text is not null").select((F.col("doc_id") % 25).alias("qid"), F.concat(F.lit("d"), text_of("doc_id")).alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"))
    return reports.context(entities, relations, chunks)


# --- functions --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, regexp_extract('/srv/'||c_name||'/','([^/]*)/*$',1)||'-'||substr(sha256('/srv/'||c_name||'/'),1,10) AS repo_key, array_to_string(list_filter(['class: '||c_name, nullif(c_mktsegment,'BUILDING'), nullif(substr(repeat(c_name,20),1,200),'')], lambda x: x IS NOT NULL), ' | ') AS description FROM customer")
def identities(t: Tables) -> DataFrame:
    """Keys of customers as repositories, and their descriptions as classes."""
    path = F.concat(F.lit("/srv/"), F.col("c_name"), F.lit("/"))
    signature = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    return t.customer.select("c_custkey", ids.repo_key(path).alias("repo_key"), ids.description(F.lit("class"), F.col("c_name"), signature, F.repeat("c_name", 20)).alias("description"))


@query("SELECT conv_id, turn, list_filter([trim(replace(coalesce(text,''),'\"','')), 'second', 'third'], lambda x: x<>'') AS questions, nullif(replace(trim(coalesce(text,'')),'\"',''),'') IS NOT NULL AS salvaged FROM (SELECT conv_id, turn, replace(replace(replace(replace(coalesce(text,''),'\\',''),chr(10),' '),chr(9),' '),chr(13),' ') AS text FROM conversations)")
def model_answers(t: Tables) -> DataFrame:
    """Turns as answers: a list of questions as strings or objects by the parity of the turn, and the same in a fence with words around."""
    plain = F.replace(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\")), "[\\n\\t\\r]", " "), F.lit('"'))
    objects = F.concat(F.lit('[{"query": "'), plain, F.lit('"}, {"q": " second "}, {"text": "third"}, {"text": " "}]'))
    strings = F.concat(F.lit('["'), plain, F.lit('", "second", " third", ""]'))
    raw = F.when(F.col("turn") % 2 == 0, objects).otherwise(strings)
    fenced = F.concat(F.lit("Here it is: ```json\n"), raw, F.lit("\n``` done"))
    salvaged = text.salvaged_json(fenced)
    return t.conversations.select("conv_id", "turn", text.query_list(raw).alias("questions"), (salvaged.isNotNull() & (F.trim(plain) != "")).alias("salvaged"))


@query("WITH c(name, sink) AS (VALUES ('store.delete_all',true),('deleted',false),('db.raw_sql_now',true),('pay',true),('payload',false),('a.b.transfer-now',true),('grantee',false)) SELECT c_custkey, name, sink FROM customer, c")
def sink_calls(t: Tables) -> DataFrame:
    """Names that a sink's word makes a sink, and names that only look like it, for each customer."""
    listed = F.explode(F.array(*[F.lit(x) for x in ("store.delete_all", "deleted", "db.raw_sql_now", "pay", "payload", "a.b.transfer-now", "grantee")])).alias("name")
    return t.customer.select("c_custkey", listed).select("c_custkey", "name", text.is_sink(F.col("name")).alias("sink"))


@query("WITH q AS (SELECT page_id, 't'||page_id%40 AS token, CASE WHEN page_id%6=0 THEN 'sql' ELSE 'web' END AS kind FROM pages) SELECT DISTINCT 'web' AS repo, token, 'p'||page_id AS rel_path, kind FROM q WHERE token IN (SELECT 't'||s_suppkey%60 FROM supplier)")
def token_mentions(t: Tables) -> DataFrame:
    """Pages that hold a supplier's token."""
    files = t.pages.select(F.lit("web").alias("repo"), F.concat(F.lit("p"), text_of("page_id")).alias("rel_path"), F.when(F.col("page_id") % 6 == 0, "sql").otherwise("web").alias("kind"), F.concat(F.lit("say (t"), (F.col("page_id") % 40).cast("string"), F.lit("); ok")).alias("content"))
    return audit.token_mentions(files, t.supplier.select(F.lit("web").alias("repo"), F.concat(F.lit("t"), (F.col("s_suppkey") % 60).cast("string")).alias("token")))


@query("SELECT 'tpc' AS repo, vec_id AS id, CASE WHEN vec_id%4=0 THEN 'new' ELSE 'old' END AS owner FROM embeddings WHERE vec_id%3>0")
def vector_updates(t: Tables) -> DataFrame:
    """Vectors after every fourth is replaced and every third removed."""
    v = t.embeddings.select(F.lit(REPO).alias("repo"), F.col("vec_id").alias("id"), F.lit("entity").alias("owner"), F.col("embedding").alias("vec"), F.lit("old").alias("version"))
    after = vectors.add_vectors(v, v.filter("id % 4 = 0").withColumn("version", F.lit("new")))
    return vectors.remove_vectors(after, v.filter("id % 3 = 0").select("repo", "id")).select("repo", "id", F.col("version").alias("owner"))
