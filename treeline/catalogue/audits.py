"""Queries on declarations and what consumes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import GENERIC_SEGMENTS
from treeline.operators import audit
from treeline.plans.bindings import Tables, cte, with_tables

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


LITS = "list_filter(list_transform(string_split(path,'/'), lambda x: rtrim(x,'-_.')), lambda x: x<>'' AND NOT regexp_matches(x,'^(\\{.*\\}|<.*>|:.+|\\$.+|%[sd]|\\*|[0-9]+|\\[.*\\])$'))"
MATCHED = f"""
r AS (SELECT key, rel_path, {LITS} AS lits FROM routes), s AS (SELECT DISTINCT rel_path, kind, {LITS} AS lits FROM sites),
m AS (SELECT DISTINCT r.key, s.rel_path, s.kind FROM r JOIN s ON len(r.lits)>0 AND len(s.lits)>0 AND (
  len(list_filter(range(1, len(s.lits)-len(r.lits)+2), lambda i: s.lits[i:i+len(r.lits)-1]=r.lits))>0 OR (len(s.lits)<=len(r.lits) AND r.lits[len(r.lits)-len(s.lits)+1:len(r.lits)]=s.lits))),
inv AS (SELECT rel_path, count(DISTINCT key) AS hits, count(DISTINCT key)/(SELECT count(DISTINCT key) FROM r)::DOUBLE AS share FROM m GROUP BY 1),
inventory AS (SELECT * FROM inv WHERE regexp_matches(lower(rel_path),'(openapi|swagger|api-docs|apidocs|postman|insomnia)[^/]*$') OR ((SELECT count(DISTINCT key) FROM r)>=10 AND hits>=8 AND share>=0.75))"""


@query(with_tables("routes sites", MATCHED) + "SELECT 'web' AS repo, key, rel_path, kind FROM m")
def route_match(t: Tables) -> DataFrame:
    return audit.match_routes(t.routes(), t.sites())


@query(with_tables("routes", f"sites AS ({cte()['sites']} UNION ALL SELECT CASE WHEN length(path)%5=0 THEN 'few' ELSE 'most' END, 'doc', path FROM routes UNION ALL SELECT n, 'web', path FROM routes, (VALUES ('docs/API-Docs.html'),('x/insomnia_v4.json'),('a.Postman.json'),('openapi/calls.ts')) v(n) WHERE length(path)%7=0), {MATCHED}") + "SELECT 'web' AS repo, rel_path, hits, share FROM inventory")
def api_inventory(t: Tables) -> DataFrame:
    """More files list routes: `most` names enough of them to be an inventory, three are named as one, and one only lies in a folder so named."""
    lists = t.routes().select("repo", F.when(F.length("path") % 5 == 0, "few").otherwise("most").alias("rel_path"), F.lit("doc").alias("kind"), "path")
    named = F.explode(F.array(*[F.lit(n) for n in ("docs/API-Docs.html", "x/insomnia_v4.json", "a.Postman.json", "openapi/calls.ts")]))
    lists = lists.unionByName(t.routes().filter(F.length("path") % 7 == 0).select("repo", named.alias("rel_path"), F.lit("web").alias("kind"), "path"))
    return audit.inventories(audit.match_routes(t.routes(), t.sites().unionByName(lists)), t.routes())


GENERIC = "(" + ",".join(f"'{g}'" for g in GENERIC_SEGMENTS) + ")"
VERDICTS = f"""
per AS (SELECT key, bool_or(kind IN ('web','code','shell')) AS strong, count(*) AS hits FROM m WHERE rel_path NOT IN (SELECT rel_path FROM inventory) GROUP BY 1),
tok AS (SELECT key, rel_path, len(lits) AS n, coalesce(list_filter(lits, lambda x: lower(x) NOT IN {GENERIC})[-1], '') AS token FROM r),
tm AS (SELECT DISTINCT token, 'p'||page_id AS rel_path FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html,'[A-Za-z0-9_\\-]+'))) AS token FROM pages)),
men AS (SELECT DISTINCT key FROM tok JOIN tm USING (token) WHERE token<>'' AND tok.rel_path<>tm.rel_path),
verdicts AS (SELECT tok.key, CASE WHEN strong OR n=0 THEN 'ok' WHEN hits>0 OR tok.key IN (SELECT key FROM men) THEN 'suspect' ELSE 'dead' END AS verdict FROM tok LEFT JOIN per USING (key))"""


def verdicts(t: Tables) -> DataFrame:
    from treeline.functions.text import distinctive_segment, path_segments

    files = t.pages.select(F.lit("web").alias("repo"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("rel_path"), F.lit("web").alias("kind"), F.col("html").alias("content"))
    tokens = t.routes().select("repo", distinctive_segment(path_segments(F.col("path"))).alias("token")).filter("token != ''")
    return audit.audit_endpoints(t.routes(), t.sites(), audit.token_mentions(files, tokens))


@query(with_tables("routes sites", f"{MATCHED}, {VERDICTS}") + "SELECT 'web' AS repo, key, verdict FROM verdicts")
def endpoint_audit(t: Tables) -> DataFrame:
    return verdicts(t)


def domains(t: Tables) -> DataFrame:
    """Event types as states: the first check is redefined by the second, which a further declaration adds to."""
    rows = [("ev", "event_type", ["old_state", "click"], True, True, None, 1), ("ev", "event_type", ["click", "view", "signup", "expired"], True, True, "signup", 2), ("ev", "event_type", ["archived"], False, False, None, 3)]
    events = t.spark.createDataFrame(rows, "table string, column string, values array<string>, is_check boolean, is_replace boolean, default_value string, seq long").withColumn("repo", F.lit("ev"))
    return audit.fold_domains(events)


@query("WITH d(value, is_default) AS (VALUES ('click',false),('view',false),('signup',true),('expired',false),('archived',false)), u AS (SELECT event_type AS value, value>50 AS is_read, props AS context FROM events), p AS (SELECT d.value, count(u.value) AS n, bool_or(NOT is_read) AS non_read, bool_or(contains(context,'event_type') OR contains(context,'ev')) AS named FROM d LEFT JOIN u ON d.value=u.value GROUP BY 1) SELECT 'ev' AS repo, 'ev' AS \"table\", 'event_type' AS \"column\", d.value, CASE WHEN n=0 THEN CASE WHEN is_default THEN 'suspect' ELSE 'dead' END WHEN is_default OR non_read OR NOT named THEN 'ok' ELSE 'suspect' END AS verdict FROM d JOIN p USING (value)")
def state_audit(t: Tables) -> DataFrame:
    uses = t.events.select(F.lit("ev").alias("repo"), F.col("event_type").alias("value"), F.lit(False).alias("is_test"), (F.col("value") > 50).alias("is_read"), F.col("props").alias("context"))
    return audit.audit_states(domains(t), uses)


@query("SELECT 'ev' AS repo, 'ev' AS \"table\", 'event_type' AS \"column\", event_type AS value, min('e'||event_id) AS place, count(*) AS times FROM events WHERE event_type NOT IN ('click','view','signup','expired') GROUP BY 4")
def illegal_writes(t: Tables) -> DataFrame:
    writes = t.events.select(F.lit("ev").alias("repo"), F.lit("ev").alias("table"), F.lit("event_type").alias("column"), F.col("event_type").alias("value"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("place"))
    return audit.illegal_writes(domains(t), writes)


@query("""
WITH w AS (SELECT DISTINCT source, lang, doc_id, unnest(list_filter(list_distinct(regexp_extract_all(coalesce(text,''),'[\\p{L}\\p{N}_]+')), lambda x: regexp_full_match(x,'[A-Z][A-Z0-9_]{2,}'))) AS key FROM documents),
decl AS (SELECT DISTINCT key FROM w WHERE source='src1'), rd AS (SELECT w.key, lang FROM w JOIN decl USING (key) WHERE source<>'src1' AND lang<>'de'),
per AS (SELECT key, bool_or(lang IN ('en','fr')) AS read, count(*) AS n FROM rd GROUP BY 1)
SELECT 'docs' AS repo, key, CASE WHEN read THEN 'ok' WHEN coalesce(n,0)=0 THEN 'dead' ELSE 'suspect' END AS verdict FROM decl LEFT JOIN per USING (key)""")
def config_audit(t: Tables) -> DataFrame:
    """Upper-case words that src1 declares; German files are documents, Spanish ones deployment."""
    from treeline.operators.corpus import tokens_index

    files = t.files()
    found = tokens_index(files).join(files.select("repo", "rel_path", "source", "lang"), ["repo", "rel_path"]).withColumnRenamed("token", "key")
    declares = F.col("source") == "src1"
    readers = found.select("repo", "key", "rel_path", F.when(F.col("lang") == "de", "doc").otherwise("code").alias("kind"), (F.col("lang") == "es").alias("is_deploy"), declares.alias("declares"))
    return audit.audit_configs(found.filter(declares).select("repo", "key", "rel_path"), readers)


@query(with_tables("cust", "h AS (SELECT split_part(id,'.',1) AS repo, id, balance>4000 AS guarded FROM cust)") + "SELECT repo, count(*) AS handlers, count(*) FILTER (WHERE guarded) AS guarded, count(*) FILTER (WHERE guarded)/greatest(count(*),1)::DOUBLE AS share, count(*) FILTER (WHERE guarded)/greatest(count(*),1)::DOUBLE>=0.25 AS audited FROM h GROUP BY 1")
def guard_share(t: Tables) -> DataFrame:
    """Each nation is a repository; its richer customers are guarded handlers."""
    return audit.guard_share(t.callers().select(F.substring_index("id", ".", 1).alias("repo"), F.col("id").alias("handler"), (F.col("balance") > 4000).alias("guarded")))


#: (table, entry, reason, ord)
EXEMPTIONS = (("endpoints", "GET /th*", "first glob", 1), ("endpoints", "GET /the", "exact", 2), ("endpoints", "GET /*e", "second glob", 3), ("endpoints", "GET /never", "stale", 4), ("endpoints", "PUT *", "stale glob", 5))
EXEMPT_SQL = "f AS (SELECT 'endpoints' AS \"table\", key AS id, verdict FROM verdicts WHERE verdict<>'ok')"


def exemptions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(EXEMPTIONS), "table string, entry string, reason string, ord int")


def open_findings(t: Tables) -> DataFrame:
    return verdicts(t).filter("verdict != 'ok'").select(F.lit("endpoints").alias("table"), F.col("key").alias("id"), "verdict")


REASON = "CASE WHEN id='GET /the' THEN 'exact' WHEN id='GET /never' THEN 'stale' WHEN starts_with(id,'GET /th') THEN 'first glob' WHEN starts_with(id,'GET /') AND ends_with(id,'e') THEN 'second glob' WHEN starts_with(id,'PUT ') THEN 'stale glob' END"


@query(with_tables("routes sites", f"{MATCHED}, {VERDICTS}, {EXEMPT_SQL}") + f"SELECT \"table\", id, verdict, {REASON} AS exempt_reason FROM f")
def exemption_match(t: Tables) -> DataFrame:
    return audit.apply_exemptions(open_findings(t), exemptions(t))


@query("WITH f AS (SELECT 'n'||c_nationkey AS repo, 'states' AS \"table\", c_mktsegment||'/'||(c_custkey%10) AS id, c_custkey AS n FROM customer) SELECT f.*, CASE WHEN repo='n1' AND id='BUILDING/3' THEN 'exact' WHEN repo='n1' AND regexp_matches(id,'^[AB].*/[0-4]$') THEN 'low' WHEN repo='n2' AND NOT regexp_matches(id,'/[13579]$') THEN 'even' END AS exempt_reason FROM f")
def exemption_repos(t: Tables) -> DataFrame:
    """Nations are repositories with the same findings; policies of two of them, with character classes, hold there alone."""
    findings = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), F.lit("states").alias("table"), F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 10).cast("string")).alias("id"), F.col("c_custkey").alias("n"))
    rules = [("n1", "states", "[AB]*/[0-4]", "low", 1), ("n1", "states", "BUILDING/3", "exact", 2), ("n2", "states", "*/[!13579]", "even", 1)]
    return audit.apply_exemptions(findings, t.spark.createDataFrame(rules, "repo string, table string, entry string, reason string, ord int"))


USED = "SELECT 'GET /the' AS entry WHERE EXISTS (SELECT 1 FROM f WHERE id='GET /the') UNION ALL SELECT 'GET /never' WHERE EXISTS (SELECT 1 FROM f WHERE id='GET /never') UNION ALL SELECT 'GET /th*' WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(id,'GET /th')) UNION ALL SELECT 'GET /*e' WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(id,'GET /') AND ends_with(id,'e')) UNION ALL SELECT 'PUT *' WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(id,'PUT '))"
ENTRIES = ", ".join(f"('{a}','{b}','{c}',{d})" for a, b, c, d in EXEMPTIONS)


@query(with_tables("routes sites", f"{MATCHED}, {VERDICTS}, {EXEMPT_SQL}, x(\"table\", entry, reason, ord) AS (VALUES {ENTRIES})") + f"SELECT * FROM x WHERE entry NOT IN ({USED})")
def stale_exemptions(t: Tables) -> DataFrame:
    return audit.stale_exemptions(open_findings(t), exemptions(t))


@query(with_tables("routes sites", f"{MATCHED}, {VERDICTS}, {EXEMPT_SQL}, g AS (SELECT *, {REASON} AS reason FROM f)") + "SELECT \"table\", count(*) AS total, count(*) FILTER (WHERE reason IS NULL AND verdict='dead') AS dead, count(*) FILTER (WHERE reason IS NULL AND verdict='suspect') AS suspect, count(*) FILTER (WHERE reason IS NOT NULL) AS exempted FROM g GROUP BY ROLLUP(\"table\")")
def audit_rollup(t: Tables) -> DataFrame:
    return audit.audit_rollup(audit.apply_exemptions(open_findings(t), exemptions(t)))
