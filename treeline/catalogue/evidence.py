"""Queries on what readers and evidence operators find in texts that Spark writes from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import EVIDENCE, LANGUAGES, TEST_TOKENS
from treeline.operators import corpus, evidence, facts, impact
from treeline.operators import resolve as names
from treeline.operators.common import cut
from treeline.plans.bindings import Tables, with_tables
from treeline.sources import readers

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def text_files(rows: DataFrame, repo: str, path: Column, content: Column) -> DataFrame:
    return readers.as_files(rows.select(F.lit(repo).alias("repo"), path.alias("rel_path"), content.alias("content")))


def number(c: str) -> Column:
    return F.col(c).cast("string")


# --- paths ------------------------------------------------------------------------------------------------------------

ENDINGS = ("py", "R", "rb", "kts", "tsx", "sql", "fish", "tf", "mdx", "svelte", "CC", "hs", "xyz", "properties", "mts", "h")
FOLDERS = ("src", "tests", "lib_test", "latest", "__tests__", "spec", "testdata/a", "vendor", ".venv-p0", "indexes")
MAPPED = lambda col, pairs: "CASE " + " ".join(f"WHEN {col}='{k}' THEN '{v}'" for k, v in pairs) + " END"
KINDS = [(e, k) for k, es in EVIDENCE.items() for e in es]
PARTS = f"SELECT p_partkey, list_value({','.join(repr(x) for x in FOLDERS)})[p_partkey%10+1] AS folder, list_value({','.join(repr(x) for x in ENDINGS)})[p_size%16+1] AS ext FROM part"
LANGUAGE_SQL = f"coalesce({MAPPED('ext', LANGUAGES.items())}, {MAPPED('lower(ext)', LANGUAGES.items())})"


def part_paths(t: Tables) -> DataFrame:
    folder = F.get(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("p_partkey") % 10).cast("int"))
    ending = F.get(F.array(*[F.lit(x) for x in ENDINGS]), F.col("p_size") % 16)
    path = F.concat(folder, F.lit("/f"), number("p_partkey"), F.lit("."), ending)
    return text_files(t.part, "parts", path, F.col("p_name"))


@query(f"WITH p AS ({PARTS}) SELECT folder||'/f'||p_partkey||'.'||ext AS rel_path, {LANGUAGE_SQL} AS language, coalesce({MAPPED('lower(ext)', KINDS)}, 'other') AS kind, len(list_intersect(regexp_split_to_array(lower(folder||'/f'||p_partkey||'.'||ext), '[^a-z0-9]+'), {list(TEST_TOKENS)!r}))>0 AS is_test FROM p")
def path_facts(t: Tables) -> DataFrame:
    """Language, kind of evidence and test mark of parts as files."""
    return part_paths(t).select("rel_path", "language", "kind", "is_test")


@query(f"WITH p AS ({PARTS}) SELECT folder||'/f'||p_partkey||'.'||ext AS rel_path, folder IN ('tests','__tests__') AS by_folder, folder='tests' AS by_shape, folder IN ('tests','__tests__','spec') AS excluded, folder IN ('.venv-p0','indexes') AS generated FROM p")
def path_predicates(t: Tables) -> DataFrame:
    """The other two test marks, the built-in excludes and generated folders."""
    from treeline.functions.text import excluded, is_test_by_folder, is_test_by_shape

    path = F.col("rel_path")
    return part_paths(t).select("rel_path", is_test_by_folder(path).alias("by_folder"), is_test_by_shape(path).alias("by_shape"), excluded(path, readers.EXCLUDES).alias("excluded"), readers.is_generated(F.substring_index(path, "/", 1)).alias("generated"))


# --- reports, traces and lists ----------------------------------------------------------------------------------------


@query("SELECT source AS commit, 'd'||doc_id||'.py' AS path, CASE lang WHEN 'de' THEN 'added' WHEN 'es' THEN 'deleted' ELSE 'modified' END AS change_type, side, s AS start, s+n-1 AS \"end\" FROM (SELECT source, doc_id, lang, 'deleted' AS side, CAST(n_chars%9+1 AS INT) AS s, CAST(n_chars%4 AS INT) AS n FROM documents UNION ALL SELECT source, doc_id, lang, 'added', CAST(n_chars%7+1 AS INT), CAST(n_chars%5+1 AS INT) FROM documents) WHERE n>0")
def diff_hunks(t: Tables) -> DataFrame:
    """A diff for each source: each document is a file with one hunk."""
    d = t.documents
    path = F.concat(F.lit("d"), number("doc_id"), F.lit(".py"))
    mark = F.when(F.col("lang") == "de", "new file mode 100644").when(F.col("lang") == "es", "deleted file mode 100644").otherwise("index 1..2")
    n = lambda by, more: (F.col("n_chars") % by + more).cast("string")
    hunk = F.concat(F.lit("@@ -"), n(9, 1), F.lit(","), n(4, 0), F.lit(" +"), n(7, 1), F.lit(","), n(5, 1), F.lit(" @@ def f()"))
    lines = F.posexplode(F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), mark, hunk, F.lit("+ @@ -1 +1 @@ in a text")))
    return readers.diff_hunks(d.select(F.col("source").alias("commit"), "doc_id", lines.alias("k", "line")).select("commit", (F.col("doc_id") * 4 + F.col("k")).alias("line_no"), "line"))


def part_report(t: Tables, *lines: Column) -> DataFrame:
    rows = t.part.select(F.lit("tpc").alias("repo"), (F.col("p_partkey") % 8).cast("string").alias("report"), "p_partkey", F.posexplode(F.array(*lines)).alias("k", "line"))
    return rows.select("repo", "report", (F.col("p_partkey") * 8 + F.col("k")).alias("line_no"), "line")


@query("SELECT 'tpc' AS repo, p_brand AS file, sum(p_size//2)::BIGINT AS lh, sum(p_size)::BIGINT AS lf, sum(p_size%3)::BIGINT AS fnh, sum(p_size%3+1)::BIGINT AS fnf FROM part GROUP BY 2")
def lcov_report(t: Tables) -> DataFrame:
    """Parts as records of their brand's file; a count after the end of a record counts for none."""
    n = lambda tag, c: F.concat(F.lit(f"{tag}:"), c.cast("string"))
    size = F.col("p_size")
    return readers.lcov(part_report(t, F.concat(F.lit("SF:"), F.col("p_brand")), n("LH", F.floor(size / 2)), n("LF", size), n("FNH", size % 3), n("FNF", size % 3 + 1), F.lit("end_of_record"), F.lit("LH:1000")))


@query("SELECT 'tpc' AS repo, 'pkg/'||replace(p_brand,'#','')||'.go' AS file, sum(CASE WHEN p_size%2>0 THEN p_size ELSE 0 END)::BIGINT AS lh, sum(p_size)::BIGINT AS lf, 0::BIGINT AS fnh, 0::BIGINT AS fnf FROM part WHERE p_partkey%8<7 GROUP BY 2")
def go_cover_profile(t: Tables) -> DataFrame:
    """Parts as blocks; the last report has no mode line and is not read, the module's name goes."""
    block = F.concat(F.lit("example.com/m/pkg/"), F.replace("p_brand", F.lit("#")), F.lit(".go:1.2,3.4 "), number("p_size"), F.lit(" "), (F.col("p_size") % 2).cast("string"))
    first = t.spark.range(7).select(F.lit("tpc").alias("repo"), F.col("id").cast("string").alias("report"), F.lit(-1).cast("long").alias("line_no"), F.lit("mode: count").alias("line"))
    modules = t.spark.createDataFrame([("tpc", "example.com/m")], "repo string, module string")
    return readers.go_profile(part_report(t, block).unionByName(first), modules)


PAIRS = "p AS (SELECT 'u'||user_id AS \"from\", event_type AS \"to\", count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1,2)"


def user_calls(t: Tables) -> DataFrame:
    return t.events.filter("event_type is not null").groupBy(F.concat(F.lit("u"), number("user_id")).alias("from"), F.col("event_type").alias("to")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT 'tpc' AS repo, \"from\"||'->'||\"to\" AS edge, n AS times FROM p")
def trace_map(t: Tables) -> DataFrame:
    """A JSON map of counted calls for each user."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("->", "from", "to"), "n")))
    return readers.trace_map(user_calls(t).groupBy("from").agg(F.to_json(pairs).alias("content")).withColumn("repo", F.lit("tpc")))


@query(f"WITH {PAIRS} SELECT 'tpc' AS repo, \"from\", \"to\" FROM p")
def trace_list(t: Tables) -> DataFrame:
    """A JSON list of module loads for each user."""
    loads = F.to_json(F.collect_list(F.struct("from", "to")))
    return readers.trace_list(user_calls(t).groupBy("from").agg(loads.alias("content")).withColumn("repo", F.lit("tpc")))


POLICY_ROWS = with_tables("cust", "c AS (SELECT split_part(id,'.',1) AS n, key, c_mktsegment, row_number() OVER (PARTITION BY split_part(id,'.',1) ORDER BY key)-1 AS k FROM cust)")


@query(POLICY_ROWS + "SELECT n AS repo, CASE WHEN NOT starts_with(n,'U') THEN 'endpoints' END AS \"table\", CASE WHEN NOT starts_with(n,'U') THEN 'GET /'||key END AS entry, CASE WHEN NOT starts_with(n,'U') THEN c_mktsegment END AS reason, CASE WHEN NOT starts_with(n,'U') THEN k END AS ord, starts_with(n,'U') AS broken FROM c WHERE NOT starts_with(n,'U') OR k=0")
def policy_exemptions(t: Tables) -> DataFrame:
    """A policy for each nation exempts its customers; those of nations with U cannot be read."""
    c = t.callers().join(t.customer.select(F.col("c_custkey").alias("key"), "c_mktsegment"), "key").withColumn("n", F.substring_index("id", ".", 1))
    line = F.concat(F.lit("  - {id: GET /"), number("key"), F.lit(", reason: "), F.col("c_mktsegment"), F.lit("}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"]), "\n")
    texts = c.groupBy("n").agg(body.alias("body")).select(F.col("n").alias("repo"), F.concat(F.when(F.col("n").startswith("U"), "{").otherwise(""), F.lit("exempt:\n endpoints:\n"), F.col("body")).alias("content"))
    return readers.policies(texts).select("repo", "table", "entry", "reason", "ord", F.col("error").isNotNull().alias("broken"))


@query("SELECT c_name AS path, c_mktsegment AS note, c_nationkey%2=0 AS exempt FROM customer WHERE c_custkey%3>0")
def gate_manifest(t: Tables) -> DataFrame:
    """Customers as rows of a manifest; every third is a comment."""
    line = F.concat(F.when(F.col("c_custkey") % 3 == 0, "# ").otherwise(""), F.when(F.col("c_nationkey") % 2 == 0, "exempt:").otherwise(""), F.col("c_name"), F.lit(" | "), F.col("c_mktsegment"))
    return readers.gate_manifest(t.customer.select(line.alias("line")))


@query("SELECT c_name AS key FROM customer WHERE c_custkey%3=1")
def ratchet_baseline(t: Tables) -> DataFrame:
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("# "), F.col("c_name"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), F.col("c_name"))).otherwise("  ")
    return readers.baseline(t.customer.select(line.alias("line")))


# --- routes and calls -------------------------------------------------------------------------------------------------

URLS = "u AS (SELECT page_id, page_id%4 AS shape, regexp_extract(url,'://[^/?#]*([^?#]*)',1) AS path FROM pages)"


def page_sources(t: Tables) -> DataFrame:
    """Each page's path as a route of a Python, controller, router or Go file."""
    path, k = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.col("page_id") % 4
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    python = q("router = APIRouter(prefix='/v1', tags=['x'])\n\n\n@router.api_route('/no')\n@router.route(\n    '", path, "', methods=['GET', 'post'])\nasync def h():\n    return 1\n")
    nest = q("@Controller('cats')\nclass C {\n  @Get('", path, "')\n  all() { return api.get('/called') }\n}\nconst api = axios.create({})\n")
    express = q("const router = express.Router()\nrouter.all(\n  '", path, "', h)\nclient.get('/not/here')\n")
    go = q("v := e.Group(\"/api\")\nw := v.Group(\"/v2/\")\nw.POST(\"", path, "\", h)\nw.Get(\"/called\")\n")
    content = F.when(k == 0, python).when(k == 1, nest).when(k == 2, express).otherwise(go)
    ending = F.get(F.array(F.lit("py"), F.lit("ts"), F.lit("js"), F.lit("go")), k.cast("int"))
    return text_files(t.pages, "web", F.concat(F.lit("p"), number("page_id"), F.lit("."), ending), content)


@query(f"WITH {URLS}, c AS (SELECT *, array_to_string(list_filter(string_split(path,'/'), lambda x: x<>''),'/') AS clean FROM u) SELECT 'web' AS repo, 'p'||page_id||'.py' AS rel_path, 'router' AS var, method, '/v1'||path AS path, 6 AS line_end FROM c, (VALUES ('GET'),('POST')) m(method) WHERE shape=0 UNION ALL SELECT 'web', 'p'||page_id||'.ts', '', 'GET', '/cats/'||clean, 3 FROM c WHERE shape=1 UNION ALL SELECT 'web', 'p'||page_id||'.js', 'router', '*', path, 3 FROM c WHERE shape=2 UNION ALL SELECT 'web', 'p'||page_id||'.go', 'w', 'POST', '/api/v2/'||clean, 3 FROM c WHERE shape=3")
def route_declarations(t: Tables) -> DataFrame:
    return facts.all_routes(page_sources(t)).select("repo", "rel_path", "var", "method", "path", "line_end")


@query(f"WITH {URLS}, c AS (SELECT page_id, path, list_filter(string_split(path,'/'), lambda x: x<>'') AS s FROM u) SELECT 'web' AS repo, 'c'||page_id||'.ts' AS rel_path, CASE WHEN page_id%5=0 THEN 'test' ELSE 'code' END AS kind, path FROM (SELECT page_id, '/'||array_to_string(s,'/') AS path FROM c WHERE len(s)>1 UNION SELECT page_id, '/'||s[1] FROM c UNION SELECT page_id, unnest(['/ping','/left/door','/left','/yard/gate']) FROM c)")
def call_sites(t: Tables) -> DataFrame:
    """Each page's path as it is called: whole, after an interpolation, with a query, and parted by a segment in brackets; the declared one is not called. Every fifth file is a test."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    line = F.concat(F.lit("router.get('/declared/here')\nfetch(`${base}"), path, F.lit("`)\nhttp(\"/ping?x=1\")\ngo('/wing/(group)/left/door')\ngo('/yard/gate/(open)')\n"))
    files = text_files(t.pages, "web", F.concat(F.lit("c"), number("page_id"), F.lit(".ts")), line).withColumn("is_test", F.regexp_extract("rel_path", "([0-9]+)", 1).cast("long") % 5 == 0)
    routes = files.select("repo", "rel_path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return evidence.call_sites(files, routes)


# --- configuration ----------------------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
UPPER = f"translate(coalesce(text,''),'{LETTERS}','{LETTERS.upper()}')"
LEADING = "'(?m)^([A-Z][A-Z0-9_]{2,}) '"


def upper_text(t: Tables) -> Column:
    return F.translate(F.coalesce("text", F.lit("")), LETTERS, LETTERS.upper())


@query(f"WITH d AS (SELECT doc_id, source, lang, unnest(regexp_extract_all({UPPER}, {LEADING}, 1)) AS key FROM documents) SELECT 'docs' AS repo, key, min(source||'/.env.'||lang||doc_id) AS rel_path FROM d GROUP BY key")
def env_declarations(t: Tables) -> DataFrame:
    """Documents in upper case whose lines assign to their first word."""
    content = F.regexp_replace(upper_text(t), "(?m)^([A-Z][A-Z0-9_]{2,}) ", "$1 = ")
    return evidence.env_declarations(text_files(t.documents, "docs", F.concat(F.col("source"), F.lit("/.env."), F.col("lang"), number("doc_id")), content))


WORDS = "regexp_extract_all({}, '(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9_]{{2,}})', 1)"


@query(f"WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({UPPER}, {LEADING}, 1))) AS name, string_split(regexp_replace({UPPER}, '[^A-Z0-9_]', ' ', 'g'), ' ') AS words FROM documents WHERE regexp_full_match({UPPER}, '[\\x00-\\x7F]*')), f AS (SELECT name, min('docs/settings_'||doc_id||'.py') AS rel_path FROM d GROUP BY 1) SELECT 'docs' AS repo, f.name, f.rel_path, len(list_filter(words, lambda w: w=f.name))>1 AS self_used FROM f JOIN d ON d.name=f.name AND f.rel_path='docs/settings_'||doc_id||'.py'")
def config_constants(t: Tables) -> DataFrame:
    """Documents of ASCII alone as settings modules; what a line begins with is a constant."""
    content = F.regexp_replace(upper_text(t), "(?m)^([A-Z][A-Z0-9_]{2,}) ", "$1 = ")
    plain = t.documents.filter(F.octet_length("text") == F.length("text"))
    return evidence.config_constants(text_files(plain, "docs", F.concat(F.lit("docs/settings_"), number("doc_id"), F.lit(".py")), content))


@query(f"SELECT DISTINCT 'docs' AS repo, key, 'd'||doc_id||'.sh' AS rel_path FROM (SELECT doc_id, unnest(regexp_extract_all(replace({UPPER},'$','S'), '(?m)^([A-Z][A-Z0-9_]{{2,}}) ', 1)) AS key FROM documents)")
def interpolations(t: Tables) -> DataFrame:
    """Documents in upper case whose first words of lines are interpolated, with and without braces, by the parity of the id."""
    bare = F.replace(upper_text(t), F.lit("$"), F.lit("S"))
    with_mark = lambda to: F.regexp_replace(bare, "(?m)^([A-Z][A-Z0-9_]{2,}) ", to)
    content = F.when(F.col("doc_id") % 2 == 0, with_mark("\\${$1:-x} ")).otherwise(with_mark("\\$$1 "))
    return evidence.interpolations(text_files(t.documents, "docs", F.concat(F.lit("d"), number("doc_id"), F.lit(".sh")), content))


@query("SELECT DISTINCT 'docs' AS repo, key FROM (SELECT 'APP_F_'||upper(unnest(regexp_extract_all(lower(coalesce(text,'')), '(?m)^([a-z][a-z0-9_]*) ', 1))) AS key FROM documents WHERE doc_id%3=0)")
def settings_keys(t: Tables) -> DataFrame:
    """Documents whose first words of lines are fields of a class; every third binds a prefix, and an empty one too, the next third is tests, and the others bind none."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("(?m)^([a-z][a-z0-9_]*) "), F.lit(1))
    head = F.when(F.col("doc_id") % 3 == 0, "c = Config(env_prefix='app_')\nd = {'env_prefix': ''}\n").when(F.col("doc_id") % 3 == 1, "env_prefix = 'test_'\n").otherwise("env = 'prefix'\n")
    content = F.concat(head, F.lit("class Settings:\n    Other: int\n    none = 1\n"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("    f_"), w, F.lit(": int = 0\n"))), ""))
    path = F.concat(F.when(F.col("doc_id") % 3 == 1, "tests/").otherwise("src/"), F.lit("d"), number("doc_id"), F.lit(".py"))
    return evidence.settings_keys(text_files(t.documents, "docs", path, content))


# --- states and statements --------------------------------------------------------------------------------------------


def schema_files(t: Tables) -> DataFrame:
    """A migration for each nation: a check over several lines that lists the suppliers, a default, an enum of the regions, a later check in place of the first for every second nation, and a dropped column."""
    s = t.callees().select(F.substring_index("id", ".", 1).alias("n"), "key")
    values = F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: F.concat(F.lit("'sup"), k.cast("string"), F.lit("'"))), ",\n    ")
    per = s.groupBy("n").agg(values.alias("v"), F.max("key").alias("last")).join(t.nations(), "n")
    more = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("ALTER TABLE "), F.col("n"), F.lit("\n DROP CONSTRAINT c,\n ADD CONSTRAINT c CHECK (status IN ('only', 'sup"), number("last"), F.lit("'));\n"))).otherwise("")
    content = F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.col("n"), F.lit(" (\n  id bigint,\n  status text CHECK (status IN (\n    "), F.col("v"), F.lit("\n  ))\n);\nALTER TABLE "), F.col("n"), F.lit("\n  ADD COLUMN kind text NOT NULL DEFAULT 'plain';\nCREATE TYPE phase AS ENUM (\n 'r1', '"), F.col("r"), F.lit("');\n"), more, F.lit("ALTER TABLE "), F.col("n"), F.lit(" DROP COLUMN IF EXISTS mode;\n"))
    return text_files(per, "db", F.concat(F.lit("db/"), F.col("n"), F.lit(".sql")), content)


@query(with_tables("nat supp", "s AS (SELECT split_part(id,'.',1) AS n, list('sup'||key ORDER BY key) AS v, max(key) AS last FROM supp GROUP BY 1)") + "SELECT 'db' AS repo, n AS \"table\", 'status' AS \"column\", v AS values, true AS is_check, false AS is_replace, NULL AS default_value FROM s UNION ALL SELECT 'db', n, 'kind', ['plain'], false, false, 'plain' FROM s UNION ALL SELECT 'db', '', 'phase', ['r1', r], false, false, NULL FROM s JOIN nat USING (n) UNION ALL SELECT 'db', n, 'status', ['only', 'sup'||last], true, true, NULL FROM s JOIN nat USING (n) WHERE n_nationkey%2=0")
def state_events(t: Tables) -> DataFrame:
    return evidence.state_events(schema_files(t)).drop("seq")


@query(with_tables("nat supp", "s AS (SELECT split_part(id,'.',1) AS n, list('sup'||key ORDER BY 'sup'||key) AS v, max(key) AS last FROM supp GROUP BY 1)") + "SELECT n AS \"table\", CASE WHEN n_nationkey%2=0 THEN ['only', 'sup'||last] ELSE v END AS values FROM s JOIN nat USING (n)")
def state_domains(t: Tables) -> DataFrame:
    """What a status may be after all migrations: a later check stands in place of the first."""
    from treeline.operators.audit import fold_domains

    return fold_domains(evidence.state_events(schema_files(t))).filter("column = 'status'").select("table", "values")


@query(with_tables("supp", "s AS (SELECT DISTINCT split_part(id,'.',1) AS n FROM supp)") + "SELECT 'db' AS repo, n AS \"table\", 'mode' AS \"column\", 'db/'||n||'.sql' AS rel_path FROM s")
def drop_events(t: Tables) -> DataFrame:
    return evidence.drop_events(schema_files(t)).select("repo", "table", "column", "rel_path")


WRITES = with_tables("cust", "c AS (SELECT split_part(id,'.',1) AS n, key, c_mktsegment AS seg, row_number() OVER (PARTITION BY split_part(id,'.',1) ORDER BY key) AS k FROM cust)")


@query(WRITES + "SELECT 'app' AS repo, n AS \"table\", col AS \"column\", CASE col WHEN 'segment' THEN seg WHEN 'note' THEN 'a, (b)' WHEN 'status' THEN 'again' ELSE 'moved' END AS value, 'app/'||n||'.py:'||(CASE WHEN col IN ('segment','note') THEN 3*k-2 WHEN col='status' THEN 3*k-1 ELSE 3*k END) AS place FROM c, (VALUES ('segment'),('note'),('status'),('place')) v(col)")
def literal_writes(t: Tables) -> DataFrame:
    """A statement for each customer inside its nation's code, with an upsert, and an update; a test file writes nothing."""
    c = t.callers().join(t.customer.select(F.col("c_custkey").alias("key"), "c_mktsegment"), "key").withColumn("n", F.substring_index("id", ".", 1))
    statement = F.concat(F.lit('run("""INSERT INTO '), F.col("n"), F.lit(" (id, segment, note) VALUES ("), number("key"), F.lit(", '"), F.col("c_mktsegment"), F.lit("', 'a, (b)')\n ON CONFLICT (id) DO UPDATE SET status = 'again' WHERE kind = 'x'\"\"\")\n"), F.lit('run("UPDATE '), F.col("n"), F.lit(" SET place = 'moved' WHERE mode = 'y'\")"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", statement.alias("s")))), lambda x: x["s"]), "\n")
    texts = c.groupBy("n").agg(body.alias("body"))
    path = F.concat(F.lit("app/"), F.col("n"), F.lit(".py"))
    files = text_files(texts, "app", path, F.col("body")).unionByName(text_files(texts, "app", F.concat(F.lit("tests/"), F.col("n"), F.lit(".py")), F.col("body")))
    return evidence.literal_writes(files)


@query(with_tables("files", "l AS (SELECT rel_path, i AS line_no, lines[i] AS line FROM files, unnest(range(1, n_lines+1)) AS u(i)), u AS (SELECT DISTINCT rel_path, line_no, unnest(regexp_extract_all(line, '\"([^\"]+)\"', 1)) AS value, line FROM (SELECT rel_path, line_no, replace(replace(line, '\"', ''''), 'token', '\"token\"') AS line FROM l))") + "SELECT value, rel_path, line_no, regexp_matches(lower(line), '==|!=|\\b(where|case|match|elif|if|filter)\\b|\\b(in|includes|startswith|endswith|in_)\\s*\\(') AS is_read FROM u WHERE value='token'")
def literal_uses(t: Tables) -> DataFrame:
    """Documents in which the word token is quoted."""
    files = t.files().withColumn("content", F.replace(F.replace("content", F.lit('"'), F.lit("'")), F.lit("token"), F.lit('"token"')))
    wanted = t.spark.createDataFrame([("docs", "token")], "repo string, value string")
    return evidence.literal_uses(files, wanted).select("value", "rel_path", "line_no", "is_read")


# --- handlers, symbols and callers ------------------------------------------------------------------------------------


def handler_files(t: Tables) -> DataFrame:
    """Two handlers for each customer: the first asks for a permission if the customer is rich; both reach a sink if it is in debt."""
    c = t.callers()
    h = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    guard, sink = F.when(F.col("balance") > 4000, "@require_admin\n").otherwise(""), F.when(F.col("balance") < 0, "store.purge").otherwise("store.read")
    content = h("@router.get('/a", number("key"), "')\n", guard, "def a", number("key"), "(\n    x: int,\n):\n    return work", number("key"), "(x)\n\n\n@router.post('/b", number("key"), "')\ndef b", number("key"), "(user=Depends(current_user)):\n    return 1\n\n\ndef work", number("key"), "(x):\n    ", sink, "(x)\n")
    return text_files(c, "tpc", F.concat(F.lit("api/"), F.col("name"), F.lit(".py")), content)


@query(with_tables("cust") + "SELECT 'tpc' AS repo, handler, guarded FROM (SELECT 'a'||key AS handler, balance>4000 AS guarded FROM cust UNION ALL SELECT 'b'||key, true FROM cust)")
def routed_handlers(t: Tables) -> DataFrame:
    return evidence.routed_handlers(handler_files(t)).select("repo", "handler", "guarded")


@query(with_tables("cust") + "SELECT 'envelope' AS \"table\", 'a'||key AS id, 'suspect' AS verdict FROM cust WHERE balance<0")
def envelope_audit(t: Tables) -> DataFrame:
    """Unguarded handlers that reach a sink: those of customers in debt."""
    from treeline.plans.jobs import audit_envelope

    return audit_envelope(handler_files(t)).select("table", "id", "verdict")


@query(with_tables("cust") + "SELECT 'tpc' AS repo, caller_id, callee, call_type FROM (SELECT 'api.c'||key||'.a'||key AS caller_id, 'work'||key AS callee, 'function' AS call_type FROM cust UNION ALL SELECT 'api.c'||key||'.work'||key, CASE WHEN balance<0 THEN 'store.purge' ELSE 'store.read' END, 'method' FROM cust UNION ALL SELECT 'api.c'||key, v, 'method' FROM cust, (VALUES ('router.get'),('router.post')) d(v) UNION ALL SELECT 'api.c'||key, 'Depends.__init__', 'constructor' FROM cust)")
def caller_ids(t: Tables) -> DataFrame:
    """Every call with its caller's id: a function of the file, else the module. Decorators and defaults are called by what stands around."""
    found = cut(facts.extract(handler_files(t)))
    calls = names.resolve_callers(facts.fact_table(found, "calls").withColumn("caller", F.when(F.col("call_type") == "constructor", "").when(F.col("callee").startswith("router."), "").otherwise(F.col("caller"))), facts.fact_table(found, "symbols"))
    return calls.select("repo", "caller_id", "callee", "call_type")


@query(with_tables("cust") + "SELECT 'tpc' AS repo, src_id, tgt_id, kind FROM (SELECT 'api.c'||key||'.a'||key AS src_id, 'api.c'||key||'.work'||key AS tgt_id, 'calls' AS kind FROM cust UNION ALL SELECT 'GET /a'||key, 'api.c'||key||'.a'||key, 'handles' FROM cust UNION ALL SELECT 'POST /b'||key, 'api.c'||key||'.b'||key, 'handles' FROM cust)")
def built_relations(t: Tables) -> DataFrame:
    """The relations that a build finds: local calls, and routes with their handlers; what comes from outside is dropped."""
    from treeline.plans.jobs import build

    return build(handler_files(t))["relations"].select("repo", "src_id", "tgt_id", "kind")


@query(with_tables("cust") + "SELECT 'tpc' AS repo, 'api/c'||key||'.py' AS rel_path, 'a'||key AS name, CASE WHEN balance>4000 THEN ['require_admin','router.get'] ELSE ['router.get'] END AS decorators FROM cust UNION ALL SELECT 'tpc', 'api/c'||key||'.py', 'b'||key, ['router.post'] FROM cust")
def decorators_above(t: Tables) -> DataFrame:
    """Decorators that stand above symbols which were read without them."""
    files = handler_files(t)
    symbols = facts.fact_table(facts.extract(files), "symbols").filter("kind = 'function'").withColumn("annotations", F.array().cast("array<string>"))
    return corpus.decorators_above(symbols, corpus.lines(files)).select("repo", "rel_path", "name", F.array_sort("decorators").alias("decorators"))


@query(with_tables("supp nat", "s AS (SELECT split_part(id,'.',1) AS n, key FROM supp)") + "SELECT 'tpc' AS repo, 'ts/'||n||'/f'||key||'.ts' AS rel_path, short, target FROM s, LATERAL (VALUES ('D'||key, './d'), ('ns', '../ns'), ('A'||key, './named.A'||key), ('B', './named.Bee'), ('req', 'lib'||key), ('part', 'lib.part')) v(short, target)")
def script_imports(t: Tables) -> DataFrame:
    """Suppliers as scripts with default, namespace, named, renamed and required imports."""
    s = t.callees().withColumn("n", F.substring_index("id", ".", 1))
    k = number("key")
    content = F.concat(F.lit("import D"), k, F.lit(", { A"), k, F.lit(",\n  Bee as B } from './d'\n"))
    content = F.concat(F.lit("import D"), k, F.lit(" from './d'\nimport * as ns from '../ns';\nimport type { A"), k, F.lit(",\n  Bee as B } from \"./named\"\nconst req = require('lib"), k, F.lit("')\nconst { part } = require('lib')\n"))
    return facts.script_imports(text_files(s, "tpc", F.concat(F.lit("ts/"), F.col("n"), F.lit("/f"), k, F.lit(".ts")), content))


@query(with_tables("supp", "s AS (SELECT key FROM supp)") + "SELECT 'tpc' AS repo, 'f'||key||'.ts' AS rel_path, callee FROM s, LATERAL (VALUES ('./m.go'), ('./m.run.fast'), ('this.go'), ('alone')) v(callee)")
def script_callees(t: Tables) -> DataFrame:
    s = t.callees().select(F.lit("tpc").alias("repo"), F.concat(F.lit("f"), number("key"), F.lit(".ts")).alias("rel_path"))
    calls = s.select("*", F.explode(F.array(*[F.lit(c) for c in ("go", "run.fast", "this.go", "alone")])).alias("callee"))
    known = s.select("*", F.explode(F.array(F.lit("go"), F.lit("run"))).alias("short")).withColumn("target", F.concat(F.lit("./m."), F.col("short")))
    return facts.script_callees(calls, known)


@query(with_tables("hunks syms") + "SELECT commit, count(*) AS symbols, sum(lines_changed)::BIGINT AS lines FROM (SELECT commit, path, name, sum(least(e,line_end)-greatest(s,line_start)+1) AS lines_changed FROM hunks JOIN syms ON path=rel_path WHERE change_type='modified' AND s<=line_end AND line_start<=e GROUP BY 1,2,3) GROUP BY 1")
def change_sizes(t: Tables) -> DataFrame:
    """Symbols and lines that each commit modifies."""
    changed = impact.changed_symbols(t.hunks(), t.symbols().select(F.col("rel_path").alias("path"), "name", "line_start", "line_end"))
    return changed.filter("change_type = 'modified'").groupBy("commit").agg(F.count("*").alias("symbols"), F.sum("lines_changed").alias("lines"))
