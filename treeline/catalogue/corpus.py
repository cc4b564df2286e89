"""Queries on files, diffs, coverage, checks and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import corpus, health, impact, quality, sync
from treeline.operators.common import cut
from treeline.plans.bindings import REPO, Tables, with_tables
from treeline.streaming import streams

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


CHANGES = "ch AS (SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'deleted' WHEN o.sha256=n.sha256 THEN 'unchanged' ELSE 'modified' END AS status FROM old_h o FULL JOIN now_h n ON o.rel_path=n.rel_path)"


def changes(t: Tables) -> DataFrame:
    return sync.file_changes(t.earlier_hashes(), t.hashes())


@query(with_tables("old_h now_h", CHANGES) + "SELECT 'docs' AS repo, rel_path, status FROM ch")
def file_changes(t: Tables) -> DataFrame:
    return changes(t)


@query(with_tables("old_h now_h", CHANGES) + "SELECT 'docs' AS repo, count(*) FILTER (WHERE status='added') AS added, count(*) FILTER (WHERE status='modified') AS modified, count(*) FILTER (WHERE status='unchanged') AS unchanged, count(*) FILTER (WHERE status='deleted') AS deleted FROM ch")
def sync_summary(t: Tables) -> DataFrame:
    return sync.summary(changes(t))


@query(with_tables("old_h now_h") + "SELECT 'docs' AS repo, rel_path, sha256 FROM old_h WHERE rel_path NOT IN (SELECT rel_path FROM now_h)")
def stale_files(t: Tables) -> DataFrame:
    return sync.untracked(t.earlier_hashes(), t.hashes(), "rel_path")


@query(with_tables("now_h") + "SELECT 'docs' AS repo, rel_path, sha256 FROM now_h")
def content_hash(t: Tables) -> DataFrame:
    return corpus.content_hash(t.files())


BODY = "array_to_string(lines[line_start:line_end], chr(10))"


@query(with_tables("syms", f"b AS (SELECT *, {BODY} AS body, replace(left(rel_path, length(rel_path)-3),'/','.') AS module FROM syms)") + "SELECT 'docs' AS repo, 'chunk:'||module||'.'||name AS id, CASE WHEN length(body)>8192 THEN left(body,8192)||chr(10)||'... (truncated)' ELSE body END AS content, rel_path AS file_path, line_start, line_end, name AS symbol_name FROM b WHERE length(regexp_replace(body,'\\s+','','g'))>0")
def chunk_symbols(t: Tables) -> DataFrame:
    return corpus.symbol_chunks(t.files(), t.symbols())


@query(with_tables("files", "b AS (SELECT rel_path, left(array_to_string(list_filter(list_transform(range(1,n_lines+1), lambda i: CASE WHEN (i-1)%5>2 THEN lines[i] END), lambda x: x IS NOT NULL), chr(10)), 2000) AS content FROM files)") + "SELECT 'docs' AS repo, 'chunk:'||replace(left(rel_path, length(rel_path)-3),'/','.')||'.__file__' AS id, content, rel_path AS file_path FROM b WHERE length(regexp_replace(content,'\\s+','','g'))>0")
def chunk_residual(t: Tables) -> DataFrame:
    return corpus.residual_chunks(t.files(), t.symbols())


@query(with_tables("files") + "SELECT 'docs' AS repo, rel_path, len(regexp_extract_all(content,'License|token'))::BIGINT AS todos, 0::BIGINT AS any_count, len(string_split(content,chr(10)))::BIGINT AS n_lines FROM files")
def debt_markers(t: Tables) -> DataFrame:
    return health.file_debt(t.files(), "License|token")


@query(with_tables("files", "l AS (SELECT rel_path, i AS line_no, lines[i] AS line, array_to_string(lines[greatest(i-2,1):i+2], chr(10)) AS context FROM files, unnest(range(1, n_lines+1)) AS u(i))") + "SELECT 'docs' AS repo, rel_path, line_no, line, context FROM l WHERE contains(line, 'token = ')")
def line_context(t: Tables) -> DataFrame:
    return corpus.line_context(corpus.lines(t.files()), F.contains(F.col("line"), F.lit("token = ")))


@query(with_tables("files", "f AS (SELECT split_part(rel_path,'/',1) AS top, rel_path FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY rel_path) AS k FROM f)") + "SELECT 'docs' AS repo, top, count(*) AS files, [{'ext':'py','n':count(*)}] AS exts, false AS has_build, list(rel_path ORDER BY rel_path) FILTER (WHERE k<=5) AS samples FROM r GROUP BY top")
def dir_signals(t: Tables) -> DataFrame:
    return corpus.folder_signals(t.files())


@query(with_tables("files old_h", "a AS (SELECT split_part(rel_path,'/',1) AS top, count(*) AS n FROM files GROUP BY 1), b AS (SELECT split_part(rel_path,'/',1) AS top, count(DISTINCT rel_path) AS n FROM old_h GROUP BY 1), j AS (SELECT coalesce(a.top,b.top) AS top, coalesce(a.n,0) AS scannable, coalesce(b.n,0) AS indexed FROM a FULL JOIN b ON a.top=b.top)") + "SELECT 'docs' AS repo, top, scannable, indexed, 100.0::DOUBLE*indexed/greatest(scannable,1) AS percent, CASE WHEN scannable=0 THEN 'skipped' WHEN indexed=0 THEN 'none' WHEN indexed<scannable THEN 'partial' ELSE 'full' END AS status FROM j")
def index_coverage(t: Tables) -> DataFrame:
    return corpus.index_coverage(t.files(), t.earlier_hashes())


@query(with_tables("files") + "SELECT 'docs' AS repo, source||'/'||lang AS folder, count(*) AS small_files, sum(n_lines)::BIGINT AS small_lines FROM files WHERE n_lines<80 GROUP BY 2 HAVING count(*)>=4")
def small_file_clusters(t: Tables) -> DataFrame:
    return corpus.small_file_clusters(t.files())


OVERLAP = with_tables("hunks syms", "o AS (SELECT commit, path, name, change_type, sum(least(e,line_end)-greatest(s,line_start)+1)::BIGINT AS lines_changed FROM hunks JOIN syms ON path=rel_path WHERE change_type='modified' AND s<=line_end AND line_start<=e GROUP BY 1,2,3,4 UNION ALL SELECT commit, path, name, change_type, line_end-line_start+1 FROM (SELECT DISTINCT commit, path, change_type FROM hunks) JOIN syms ON path=rel_path WHERE change_type='added' UNION ALL SELECT DISTINCT commit, path, '', change_type, 0 FROM hunks WHERE change_type='deleted')")


def overlapped(t: Tables) -> DataFrame:
    return impact.changed_symbols(t.hunks(), t.symbols().select(F.col("rel_path").alias("path"), "name", "line_start", "line_end"))


@query(OVERLAP + "SELECT * FROM o")
def diff_overlap(t: Tables) -> DataFrame:
    return overlapped(t)


JUDGED = "sym AS (SELECT 'n'||s_nationkey AS repo, 'm/f'||(s_suppkey%4)||'.py' AS path, 's'||s_suppkey AS id, 1+10*(s_suppkey//4) AS a, 8+10*(s_suppkey//4) AS b FROM supplier), hk AS (SELECT DISTINCT 'n'||s_nationkey AS repo, 'c'||(s_suppkey%3) AS commit, 'm/f'||(s_suppkey%4)||'.py' AS path, 2+10*(s_suppkey//4) AS s, 5+10*(s_suppkey//4) AS e FROM supplier WHERE s_acctbal<4000)"


@query(f"WITH {JUDGED} SELECT hk.repo, commit, hk.path, id AS name, 'modified' AS change_type, sum(least(e,b)-greatest(s,a)+1)::BIGINT AS lines_changed FROM hk JOIN sym ON hk.repo=sym.repo AND hk.path=sym.path AND s<=b AND a<=e GROUP BY 1,2,3,4")
def diff_overlap_repos(t: Tables) -> DataFrame:
    """Nations are repositories that have the same four files; hunks of one touch nothing of another."""
    key, block = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 4).cast("int") * 10
    text = lambda mark, number: F.concat(F.lit(mark), number.cast("string"))
    rows = t.supplier.select(text("n", F.col("s_nationkey")).alias("repo"), F.concat(text("m/f", key % 4), F.lit(".py")).alias("path"), text("s", key).alias("name"), (block + 1).alias("line_start"), (block + 8).alias("line_end"), text("c", key % 3).alias("commit"), "s_acctbal")
    hunks = rows.filter("s_acctbal < 4000").select("repo", "commit", "path", F.lit("modified").alias("change_type"), (F.col("line_start") + 1).alias("start"), (F.col("line_start") + 4).alias("end")).distinct()
    return impact.changed_symbols(hunks, rows.select("repo", "path", "name", "line_start", "line_end"))


@query(with_tables("calls", """
ch AS (SELECT r AS commit, file_path AS path, supp.name, line_end AS lines_changed, supp.id FROM supp JOIN nat ON starts_with(supp.id, n||'.') WHERE balance<0),
re AS (SELECT DISTINCT ch.commit, c.src_id AS id, c.file_path AS path FROM ch JOIN calls c ON c.tgt_id=ch.id),
m AS (SELECT commit, replace(left(path, length(path)-3),'/','.') AS module FROM ch UNION SELECT commit, replace(left(path, length(path)-3),'/','.') FROM re),
per AS (SELECT commit, count(DISTINCT id) AS callers FROM re GROUP BY 1), mods AS (SELECT commit, count(*) AS n FROM m GROUP BY 1), c AS (SELECT DISTINCT commit FROM ch)""") + "SELECT c.commit, CASE WHEN coalesce(callers,0)>=10 OR n>=5 THEN 'high' WHEN coalesce(callers,0)>=3 THEN 'medium' ELSE 'low' END AS level, coalesce(callers,0) AS callers, n AS n_modules, array_to_string(list_filter([CASE WHEN coalesce(callers,0)>=3 THEN callers||' callers' END, CASE WHEN n>=5 THEN n||' modules' END], lambda x: x IS NOT NULL), '; ') AS reasons, []::VARCHAR[] AS affected_tests FROM c JOIN mods USING (commit) LEFT JOIN per USING (commit)")
def impact_risk(t: Tables) -> DataFrame:
    """One commit for each region: its suppliers in debt change."""
    regions = t.nations().select("n", F.col("r").alias("commit"))
    changed = t.callees().filter("balance < 0").withColumn("n", F.substring_index("id", ".", 1)).join(F.broadcast(regions), "n").select("commit", F.col("file_path").alias("path"), "name", F.col("line_end").alias("lines_changed"), "id")
    reached = changed.select("commit", F.col("id").alias("tgt_id")).join(t.calls().select("src_id", "tgt_id", F.col("file_path").alias("path")).distinct(), "tgt_id").select("commit", F.col("src_id").alias("id"), "path").distinct()
    return impact.risk(changed.drop("id"), reached)


def coverage(t: Tables) -> DataFrame:
    """Parts' brands as files; returned lines are the hit ones."""
    rows = t.lineitem.select("l_partkey", "l_returnflag").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file")), "l_partkey")
    return rows.groupBy(F.lit(REPO).alias("repo"), "file").agg(F.count_if(F.col("l_returnflag") == "R").alias("lh"), F.count("*").alias("lf"))


COV = "cov AS (SELECT p_brand AS file, count(*) FILTER (WHERE l_returnflag='R') AS lh, count(*) AS lf FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1), fan AS (SELECT p_brand AS file, count(DISTINCT p_type) AS n FROM part WHERE p_size>20 GROUP BY 1)"


@query(f"WITH {COV}, w AS (SELECT file, 100.0::DOUBLE*lh/greatest(lf,1) AS pct, lf-lh AS uncovered FROM cov WHERE lf>0 AND 100.0::DOUBLE*lh/greatest(lf,1)<=80 QUALIFY row_number() OVER (ORDER BY 100.0::DOUBLE*lh/greatest(lf,1), file)<=60), x AS (SELECT w.*, n, CASE WHEN n>=5 THEN 3 WHEN n>=2 THEN 2 WHEN n>=1 THEN 1 END*CASE WHEN pct<=0 THEN 3 WHEN pct<=50 THEN 2 ELSE 1 END AS weight, coalesce(n,-1)=0 AS dead FROM w LEFT JOIN fan USING (file)) SELECT 'tpc' AS repo, file, pct, n, uncovered, weight, dead, row_number() OVER (PARTITION BY dead ORDER BY weight DESC NULLS LAST, uncovered DESC, file) AS rank FROM x")
def coverage_rank(t: Tables) -> DataFrame:
    fan = t.part.filter("p_size > 20").groupBy(F.col("p_brand").alias("file")).agg(F.countDistinct("p_type").alias("n"))
    return quality.coverage_rank(coverage(t), fan)


BY_SIZE = "cov AS (SELECT 'size'||p_size AS repo, p_brand AS file, count(*) FILTER (WHERE l_returnflag='R') AS lh, count(*) AS lf FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2), fan AS (SELECT 'size'||p_size AS repo, p_brand AS file, count(DISTINCT p_type) AS n FROM part WHERE p_size%3>0 GROUP BY 1,2)"


@query(f"WITH {BY_SIZE}, w AS (SELECT repo, file, 100.0::DOUBLE*lh/greatest(lf,1) AS pct, lf-lh AS uncovered FROM cov WHERE 100.0::DOUBLE*lh/greatest(lf,1)<=80 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY 100.0::DOUBLE*lh/greatest(lf,1), file)<=5), x AS (SELECT w.*, n, CASE WHEN n>=5 THEN 3 WHEN n>=2 THEN 2 WHEN n>=1 THEN 1 END*CASE WHEN pct<=0 THEN 3 WHEN pct<=50 THEN 2 ELSE 1 END AS weight, coalesce(n,-1)=0 AS dead FROM w LEFT JOIN fan USING (repo, file)) SELECT repo, file, pct, n, uncovered, weight, dead, row_number() OVER (PARTITION BY repo, dead ORDER BY weight DESC NULLS LAST, uncovered DESC, file) AS rank FROM x")
def coverage_rank_repos(t: Tables) -> DataFrame:
    """Sizes are repositories that have the same files: the five worst of each."""
    repo = F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("repo")
    rows = t.lineitem.select("l_partkey", "l_returnflag").join(t.part.select(F.col("p_partkey").alias("l_partkey"), repo, F.col("p_brand").alias("file")), "l_partkey")
    cov = rows.groupBy("repo", "file").agg(F.count_if(F.col("l_returnflag") == "R").alias("lh"), F.count("*").alias("lf"))
    fan = t.part.filter("p_size % 3 > 0").groupBy(repo, F.col("p_brand").alias("file")).agg(F.countDistinct("p_type").alias("n"))
    return quality.coverage_rank(cov, fan, considered=5)


@query(f"WITH {COV}, a AS (SELECT count(DISTINCT p_brand||p_type) AS on_disk FROM part), b AS (SELECT count(DISTINCT file) AS in_report FROM cov) SELECT 'tpc' AS repo, on_disk, in_report, in_report/greatest(on_disk,1)::DOUBLE AS share, in_report/greatest(on_disk,1)::DOUBLE>=0.9 AS complete FROM a, b")
def coverage_denominator(t: Tables) -> DataFrame:
    files = t.part.select(F.lit(REPO).alias("repo"), F.concat("p_brand", "p_type").alias("rel_path"))
    return quality.coverage_denominator(coverage(t), files)


@query("WITH c AS (SELECT DISTINCT event_type AS \"check\" FROM events WHERE value>50), e AS (SELECT DISTINCT event_type AS \"check\" FROM events WHERE event_type<>'error' UNION SELECT DISTINCT role FROM conversations) SELECT 'tpc' AS repo, coalesce(c.\"check\", e.\"check\") AS \"check\", CASE WHEN e.\"check\" IS NOT NULL THEN 'OK' ELSE 'CONFIGURED_NOT_RUN' END AS state FROM c FULL JOIN e ON c.\"check\"=e.\"check\"")
def tri_state_matrix(t: Tables) -> DataFrame:
    repo = F.lit(REPO).alias("repo")
    configured = t.events.filter("value > 50").select(repo, F.col("event_type").alias("check"))
    executed = t.events.filter("event_type != 'error'").select(repo, F.col("event_type").alias("check")).unionByName(t.conversations.select(repo, F.col("role").alias("check")))
    return quality.tri_state(configured, executed)


@query("WITH b AS (SELECT l_returnflag AS metric, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus='F' GROUP BY 1), a AS (SELECT l_returnflag AS metric, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus='O' GROUP BY 1) SELECT coalesce(b.metric,a.metric) AS metric, b.value AS before, a.value AS after, a.value-b.value AS delta, CASE WHEN b.value<>0 THEN (a.value-b.value)*100.0/b.value END AS percent FROM b FULL JOIN a ON a.metric=b.metric")
def metric_delta(t: Tables) -> DataFrame:
    sums = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("metric")).agg(F.sum("l_quantity").alias("value"))
    return sync.metric_delta(sums("F"), sums("O"))


KEYS = "o AS (SELECT source AS file, lang AS code FROM documents), n AS (SELECT d.source AS file, d.lang AS code FROM documents d JOIN labels USING (doc_id) WHERE toxic=1)"


def findings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All documents by source and language, and the toxic ones."""
    old = t.documents.select("doc_id", F.col("source").alias("file"), F.col("lang").alias("code"))
    return old.drop("doc_id"), old.join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id").drop("doc_id")


@query(f"WITH {KEYS}, ok AS (SELECT file||'|'||code||'|'||count(*) AS key FROM o GROUP BY file, code), nk AS (SELECT file||'|'||code||'|'||count(*) AS key FROM n GROUP BY file, code) SELECT key, 'added' AS change FROM nk WHERE key NOT IN (SELECT key FROM ok) UNION ALL SELECT key, 'gone' FROM ok WHERE key NOT IN (SELECT key FROM nk)")
def ratchet_diff(t: Tables) -> DataFrame:
    old, new = findings(t)
    return sync.ratchet_diff(sync.ratchet_keys(old), sync.ratchet_keys(new))


@query(f"WITH {KEYS} SELECT file, code, 'new' AS change FROM (SELECT file, code FROM n EXCEPT SELECT file, code FROM o) UNION ALL SELECT file, code, 'fixed' FROM (SELECT file, code FROM o EXCEPT SELECT file, code FROM n)")
def baseline_delta(t: Tables) -> DataFrame:
    return sync.baseline_delta(*findings(t), ["file", "code"])


TOP = "['src','scripts','misc','cmd','fixtures','docs','ui','examples'][p_partkey%8+1]"
STEM = "['run_','x-deploy','latest','update-','helper','seed-','build_','reset_'][p_size%8+1]"


@query(f"""
WITH s AS (SELECT p_partkey, p_size, {TOP} AS top, {STEM} AS stem, CASE WHEN p_size%3=0 THEN 'py' ELSE 'ts' END AS ext FROM part),
used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount>0.09), uses AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity>49.5)
SELECT 'tpc' AS repo, top||'/'||p_partkey||'/'||stem||'.'||ext AS rel_path, CASE WHEN p_partkey IN (SELECT l_partkey FROM used) OR p_partkey IN (SELECT l_partkey FROM uses) THEN 'source' WHEN top IN ('src','cmd','ui') THEN 'source' WHEN top IN ('scripts','fixtures','examples') THEN 'tool'
 WHEN stem IN ('run_','x-deploy','update-','seed-','reset_') AND ((p_size%2=0 AND p_size%5<=2) OR (p_size%5=0 AND ext='ts')) THEN 'tool' ELSE 'uncertain' END AS class FROM s""")
def script_class(t: Tables) -> DataFrame:
    """Parts as scripts; some line items import them, some are imported by them."""
    pick = lambda c, n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % n).cast("int"))
    stem = pick("p_size", 8, "run_", "x-deploy", "latest", "update-", "helper", "seed-", "build_", "reset_")
    path = F.concat(pick("p_partkey", 8, "src", "scripts", "misc", "cmd", "fixtures", "docs", "ui", "examples"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), stem, F.when(F.col("p_size") % 3 == 0, ".py").otherwise(".ts"))
    scripts = t.part.select("p_partkey", F.lit(REPO).alias("repo"), path.alias("rel_path"), (F.col("p_size") % 5).alias("n_symbols"), (F.col("p_size") % 2 == 0).alias("has_main"))
    by = lambda cond: scripts.join(t.lineitem.filter(cond).select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey").select("repo", "rel_path")
    return quality.classify_scripts(scripts.drop("p_partkey"), by("l_discount > 0.09"), by("l_quantity > 49.5"))


@query("WITH p AS (SELECT page_id, regexp_extract(url,'://[^/?#]*([^?#]*)',1) AS path FROM pages), d AS (SELECT 'docs/t'||doc_id||'.txt' AS rel_path, 'see '||p.path||', and d'||doc_id%97||'.md' AS content FROM documents JOIN p ON p.page_id=doc_id%500), w AS (SELECT DISTINCT path, regexp_extract(path,'([^/]*)$',1) AS base FROM p UNION SELECT DISTINCT 'docs/d'||doc_id%97||'.md', 'd'||doc_id%97||'.md' FROM documents), n AS (SELECT path, path AS name FROM w UNION SELECT path, base FROM w) SELECT DISTINCT n.path, d.rel_path FROM d JOIN n ON name<>'' AND contains(content, name)")
def blast_radius(t: Tables) -> DataFrame:
    """Documents as texts that name a page's path and a note; every page path and note is asked for."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    pages = t.pages.select("page_id", path.alias("path"))
    note = F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string"), F.lit(".md"))
    texts = t.documents.select("doc_id", (F.col("doc_id") % 500).alias("page_id")).join(pages, "page_id")
    files = texts.select(F.concat(F.lit("docs/t"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.concat(F.lit("see "), F.col("path"), F.lit(", and "), note).alias("content"))
    targets = pages.select("path").unionByName(t.documents.select(F.concat(F.lit("docs/"), note).alias("path"))).distinct()
    return quality.blast_radius(files, targets)


@query("SELECT 'u'||user_id AS src, event_type AS tgt, count(*) AS cnt FROM events WHERE event_type IS NOT NULL GROUP BY 1,2")
def trace_stream(t: Tables) -> DataFrame:
    """Counts of a stream over the events table, each batch's updates kept and the last of a pair taken."""
    at = f"{_scratch(t)}/counts-{uuid.uuid4().hex}"
    folder, name = t.events.inputFiles()[0].rsplit("/", 1)
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", name if name == "events.parquet" else "*.parquet").parquet(folder)
    counts = streams.call_counts(raw.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("tgt")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(at).groupBy("src", "tgt").agg(F.max_by("cnt", "batch").alias("cnt"))


@query("WITH e AS (SELECT event_type AS tgt, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL) SELECT src, tgt, count(*) AS cnt FROM e WHERE src<>tgt GROUP BY 1,2")
def trace_pairs_stream(t: Tables) -> DataFrame:
    """Call pairs of a stream over the events table, which comes in two batches out of order: each waits for the watermark, and a last event beyond the delay lets all go."""
    at, spark = f"{_scratch(t)}/pairs-{uuid.uuid4().hex}", t.spark
    rows = t.events.select(F.col("user_id").cast("long").alias("session"), "ts", F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("name"))
    span = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    days = (span["last"] - span["first"]).days + 2 if span["last"] else 2
    last = rows.agg(F.max("ts").alias("ts")).filter("ts is not null")
    closing = last.select(F.lit(-1).cast("long").alias("session"), (F.col("ts") + F.make_interval(days=F.lit(days + 1))).cast(rows.schema["ts"].dataType).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("name"))
    odd = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    pairs = None
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows.filter(odd), rows.filter(~odd), closing):  # each part is a batch: the stream goes on from where it was
            part.write.mode("append").parquet(f"{at}/in")
            raw = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
            pairs = streams.ordered_call_pairs(raw, f"{days} days")
            pairs.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(pairs.schema).parquet(f"{at}/out").groupBy("src", "tgt").agg(F.count("*").alias("cnt"))


def _scratch(t: Tables) -> str:
    cut(t.spark.range(1))
    return t.spark.sparkContext.getCheckpointDir()



@query("WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT user_id, min(ts) AS start, count(*) AS events, list_sort(list(DISTINCT event_type)) AS paths FROM s GROUP BY user_id, burst")
def burst_sessions(t: Tables) -> DataFrame:
    """Runs of one user's events that are less than six hours apart."""
    return streams.bursts(t.events.select("user_id", "ts", F.col("event_type").alias("path")), "user_id", "6 hours")
