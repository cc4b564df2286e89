"""Queries on what rules a repository by itself: its policy, its structure, its coverage report, and its tables after a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.catalogue.evidence import handler_files, number, schema_files
from treeline.catalogue.portfolio import NAMED, named_files
from treeline.operators import corpus, graph, quality
from treeline.plans import jobs
from treeline.plans.bindings import Tables, with_tables
from treeline.sources import readers

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


# --- policies ---------------------------------------------------------------------------------------------------------


def policy_texts(t: Tables) -> DataFrame:
    """Every third nation has patterns and an exemption of its own, the next one no policy, the third one that cannot be read."""
    own = F.concat(F.lit("envelope:\n  gate_patterns: [require_admin]\n  sink_patterns: [read]\nstate_columns: [kind]\nexempt:\n  states:\n    \"state:"), "n", F.lit(".kind='plain'\": known\n"))
    content = F.when(F.col("n_nationkey") % 3 == 0, own).when(F.col("n_nationkey") % 3 == 2, "{")
    return t.nations().select(F.col("n").alias("repo"), content.alias("content")).filter("content is not null")


POLICY_SQL = """,
c AS (SELECT n AS repo, key, balance, n_nationkey%3=0 AS own FROM cust JOIN nat ON n=split_part(id,'.',1)),
audited AS (SELECT repo FROM c GROUP BY repo HAVING NOT bool_or(own) OR count(*) FILTER (WHERE balance>4000) >= 0.5*count(*)),
s AS (SELECT n AS repo, r, n_nationkey%3=0 AS own, CASE WHEN n_nationkey%2=0 THEN ['only','sup'||max(key)] ELSE list('sup'||key) END AS v FROM supp JOIN nat ON n=split_part(id,'.',1) GROUP BY n, r, n_nationkey)
SELECT repo, 'envelope' AS "table", 'a'||key AS id, 'suspect' AS verdict, NULL AS exempt_reason FROM c JOIN audited USING (repo) WHERE CASE WHEN own THEN balance BETWEEN 0 AND 4000 ELSE balance<0 END
UNION ALL SELECT repo, 'states', 'state:'||repo||'.kind=''plain''', 'suspect', CASE WHEN own THEN 'known' END FROM s
UNION ALL SELECT repo, 'states', 'state:.phase='''||r||'''', 'dead', NULL FROM s WHERE NOT own
UNION ALL SELECT repo, 'states', 'state:'||repo||'.status='''||unnest(v)||'''', 'dead', NULL FROM s WHERE NOT own"""


@query(with_tables("nat cust supp").rstrip() + POLICY_SQL)
def policy_audit(t: Tables) -> DataFrame:
    """Two audits over a repository for each nation, by the policy of each: its gates, sinks, state columns and exemptions."""
    nation = F.regexp_extract("rel_path", r"^db/(.*)\.sql$", 1)
    handlers = handler_files(t).select(F.regexp_extract("rel_path", r"(c[0-9]+)\.py$", 1).alias("name"), "rel_path", "content").join(t.callers().select("name", F.substring_index("id", ".", 1).alias("repo")), "name")
    files = readers.as_files(handlers.select("repo", "rel_path", "content").unionByName(schema_files(t).select(nation.alias("repo"), "rel_path", "content")))
    texts = policy_texts(t)
    exempt = readers.policies(texts).filter("entry is not null").drop("error")
    judged, _, _ = jobs.audit_report(files, exempt, ("envelope", "states"), readers.policy_files(texts))
    return judged.select("repo", "table", "id", "verdict", "exempt_reason")


# --- structure and coverage -------------------------------------------------------------------------------------------

EXCLUDING = [("builtin", "**/build/**"), ("ignored", "src4/"), ("user", "src4/**"), ("builtin", "**/tests/**"), ("detected", "**/tests/**")]


@query(with_tables("files old_h", "a AS (SELECT source AS top, count(*) AS n FROM files GROUP BY 1), b AS (SELECT split_part(rel_path,'/',1) AS top, count(DISTINCT rel_path) AS n FROM old_h GROUP BY 1), f AS (SELECT DISTINCT lang AS top FROM files UNION SELECT 'build' UNION SELECT 'tests'), j AS (SELECT top, coalesce(a.n,0) AS scannable, coalesce(b.n,0) AS indexed FROM (SELECT top FROM a UNION SELECT top FROM b UNION SELECT top FROM f) LEFT JOIN a USING (top) LEFT JOIN b USING (top)), e AS (SELECT *, CASE top WHEN 'build' THEN 'builtin: **/build/**' WHEN 'tests' THEN 'detected: **/tests/**' WHEN 'src4' THEN 'user: src4/**' END AS reason FROM j)") + "SELECT 'docs' AS repo, top, scannable, indexed, CASE WHEN reason IS NULL THEN 100.0::DOUBLE*indexed/greatest(scannable,1) END AS percent, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN scannable=0 THEN 'skipped' WHEN indexed=0 THEN 'none' WHEN indexed<scannable THEN 'partial' ELSE 'full' END AS status, reason FROM e")
def index_reasons(t: Tables) -> DataFrame:
    """Sources as folders, languages as folders without a file, and three that patterns of several sources exclude."""
    named = t.documents.select("lang").distinct().select(F.lit("docs").alias("repo"), F.col("lang").alias("top")).filter("top is not null")
    more = t.spark.createDataFrame([("docs", "build"), ("docs", "tests")], "repo string, top string")
    return corpus.index_coverage(t.files(), t.earlier_hashes(), named.unionByName(more), EXCLUDING)


@query(with_tables("nat cust", NAMED + ", g AS (SELECT repo, '['||string_agg('\"'||top||'\"', ',' ORDER BY top)||']' AS signature FROM (SELECT DISTINCT repo, CASE WHEN deep THEN 'a' ELSE 's'||key%3 END AS top FROM f) GROUP BY 1)") + "SELECT repo, signature, NOT (signature='[\"a\",\"s0\",\"s1\",\"s2\"]' AND n_nationkey%4 NOT IN (0,1)) AS refresh FROM g JOIN nat ON n=repo")
def refresh_needed(t: Tables) -> DataFrame:
    """Nations as repositories: every fourth was never looked at, the next one not to the end, and the others had four folders then."""
    known = t.nations().filter("n_nationkey % 4 != 0").select(F.col("n").alias("repo"), F.lit('["a","s0","s1","s2"]').alias("signature"), (F.col("n_nationkey") % 4 != 1).alias("done"))
    return corpus.needs_refresh(named_files(t), known)


@query(with_tables("cust supp", """
r AS (SELECT repo, report, seen FROM (SELECT split_part(id,'.',1) AS repo, 'o'||o_orderkey AS report, o_orderdate AS seen, row_number() OVER (PARTITION BY split_part(id,'.',1) ORDER BY o_orderdate DESC, 'o'||o_orderkey) AS k FROM orders JOIN cust ON o_custkey=key) WHERE k=1),
s AS (SELECT split_part(id,'.',1) AS repo, name, CASE WHEN key%7=0 THEN max(l_shipdate) ELSE min(l_shipdate) END AS seen FROM lineitem JOIN supp ON l_suppkey=key GROUP BY id, name, key),
l AS (SELECT s.*, report, s.seen>r.seen AS late, row_number() OVER (PARTITION BY repo, s.seen>r.seen ORDER BY s.seen DESC, name) AS k FROM s JOIN r USING (repo)),
p AS (SELECT repo, count(*) AS on_disk, count(*) FILTER (WHERE late) AS newer, list(name ORDER BY k) FILTER (WHERE late AND k<=5) AS newest FROM l GROUP BY 1),
k AS (SELECT split_part(id,'.',1) AS repo, count(*) AS in_report FROM supp WHERE balance>0 GROUP BY 1),
j AS (SELECT repo, report, coalesce(on_disk,0) AS on_disk, coalesce(in_report,0) AS in_report, coalesce(newer,0) AS newer, coalesce(newest,[]) AS newest FROM r LEFT JOIN p USING (repo) LEFT JOIN k USING (repo))""") + "SELECT *, in_report/greatest(on_disk,1)::DOUBLE AS share, CASE WHEN on_disk=0 THEN 'no_sources' WHEN newer>0 THEN 'stale' WHEN in_report=0 THEN 'empty' WHEN in_report<0.9*on_disk THEN 'subset' ELSE 'proven' END AS state FROM j")
def coverage_proof(t: Tables) -> DataFrame:
    """Orders as reports of their nation; its suppliers as sources, as old as their first shipment or, every seventh, their last; those with money are covered."""
    repo = F.substring_index("id", ".", 1).alias("repo")
    reports = t.orders.join(t.callers().select(F.col("key").alias("o_custkey"), repo), "o_custkey").select("repo", F.concat(F.lit("o"), number("o_orderkey")).alias("report"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    suppliers = t.callees().select("key", repo, "name", "balance")
    shipped = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    sources = suppliers.join(shipped, "key").select("repo", F.col("name").alias("rel_path"), F.when(F.col("key") % 7 == 0, F.col("last")).otherwise(F.col("first")).cast("timestamp").alias("mtime"))
    return quality.coverage_proof(suppliers.filter("balance > 0").select("repo", F.col("name").alias("file")), sources, reports)


# --- tables after a run -----------------------------------------------------------------------------------------------


@query(with_tables("ent rel") + "SELECT 'entity' AS kind, id AS src_id, '' AS tgt_id, 1 AS n FROM ent WHERE file_path NOT LIKE '%/f3.py' UNION ALL SELECT kind, src_id, tgt_id, count(*) FROM rel WHERE file_path NOT LIKE '%/f3.py' GROUP BY ALL")
def removed_files(t: Tables) -> DataFrame:
    """What is left of entities and relations when one file of each nation goes."""
    entities, relations = t.entities(), t.relations()
    gone = entities.select("repo", "file_path").filter(F.endswith("file_path", F.lit("/f3.py"))).distinct()
    kept, edges = graph.remove_files(entities, relations, gone)
    left = kept.select(F.lit("entity").alias("kind"), F.col("id").alias("src_id"), F.lit("").alias("tgt_id"), F.lit(1).cast("long").alias("n"))
    return left.unionByName(edges.groupBy("kind", "src_id", "tgt_id").agg(F.count("*").alias("n")))


def function_files(t: Tables, which: str) -> DataFrame:
    """Customers as functions, in files of their nation by key, in the order of their keys."""
    rows = t.callers().filter(which).groupBy(F.concat(F.lit("src/"), F.substring_index("id", ".", 1), F.lit("/f"), (F.col("key") % 20).cast("string"), F.lit(".py")).alias("rel_path")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    each = F.transform("keys", lambda k: F.concat(F.lit("def c"), k.cast("string"), F.lit("():\n    return 1\n")))
    return readers.as_files(rows.select(F.lit("tpc").alias("repo"), "rel_path", F.array_join(each, "").alias("content")))


@query(with_tables("cust", "f AS (SELECT split_part(id,'.',1) AS n, key, 'src/'||split_part(id,'.',1)||'/f'||key%20 AS stem FROM cust WHERE key%20>0)") + """
SELECT replace(stem,'/','.') AS id, 'module' AS kind, stem||'.py' AS file_path, 1 AS line_start, 2*count(*)+1 AS line_end FROM f GROUP BY stem
UNION ALL SELECT replace(stem,'/','.')||'.c'||key, 'function', stem||'.py', 2*k-1, 2*k FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY key) AS k FROM f)""")
def synchronised(t: Tables) -> DataFrame:
    """Entities after a run that finds files gone, unchanged, changed and new: only the latter two are parsed."""
    before = jobs.build(function_files(t, "key % 20 < 6 or key % 3 = 0"))
    after = jobs.synchronise(function_files(t, "key % 20 > 0"), before)
    return after["entities"].select("id", "kind", "file_path", "line_start", "line_end")
