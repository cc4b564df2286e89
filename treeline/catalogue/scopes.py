"""Queries on the scopes of files in languages with braces, which Spark writes from suppliers and their line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import facts
from treeline.plans.bindings import Tables
from treeline.sources import readers

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

ENDINGS = ("ts", "java", "go", "php")
#: Two lines before the methods, four lines a method and one after them; # is the supplier, ~ the nation, % the method.
OPENS = (
    "import { N~ } from './n~'\nexport class S# extends N~ implements I<Map<string, S#>> {",
    "import a.N~;\n@Entity(\"{\") public class S# extends N~ implements I<Map<String, S#>> {",
    "package a\ntype S# struct { *N~ }",
    "<p>{</p><?php use App\\N~;\nabstract class S# extends N~ implements I {",
)
METHODS = (
    "  async m%(a = '{', b: () => void) {\n    // gone(1) {\n    if (/[{\"]/.test(a)) { return work%(a, `}${b}`) }\n  }",
    "  @Override public <T> Map<String, T> m%(String a) throws E {\n    /* gone(1) { */\n    if (a != null) { return work%(a, '}'); }\n  }",
    "func (s *S#) m%(a string) int {\n    // gone(1) {\n    if a != `{` { return work%(a, \"}\") }\n}",
    "  public function m%($a = '{') {\n    // gone(1) {\n    if ($a) { return work%($a, \"}\"); }\n  }",
)
CLOSES = ("}", "}", "", "}")

SUPPLIED = (
    "WITH m AS (SELECT l_suppkey AS s, l_linenumber AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)),"
    " f AS (SELECT s_suppkey AS s, s_nationkey AS n, ['ts','java','go','php'][s_suppkey%4+1] AS ext, CASE s_suppkey%4 WHEN 3 THEN '::' ELSE '.' END AS joint FROM supplier),"
    " t AS (SELECT f.*, 'tpc' AS repo, 'src/s'||s||'.'||ext AS rel_path FROM f) "
)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def filled(lines: tuple[str, ...], method: Column | None = None) -> Column:
    text = F.get(F.array(*[F.lit(x) for x in lines]), (F.col("s_suppkey") % 4).cast("int"))
    text = F.replace(F.replace(text, F.lit("#"), F.col("s_suppkey").cast("string")), F.lit("~"), F.col("s_nationkey").cast("string"))
    return text if method is None else F.replace(text, F.lit("%"), method.cast("string"))


def supplied(t: Tables) -> DataFrame:
    """s_suppkey, s_nationkey and ks, the line numbers under which a supplier delivers."""
    ks = t.lineitem.select("l_suppkey", "l_linenumber").distinct().groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ks"))
    return t.supplier.select("s_suppkey", "s_nationkey").join(ks, "s_suppkey", "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<int>")))


def class_files(t: Tables) -> DataFrame:
    """Each supplier is a class in one of four languages, with a method for each of its line numbers."""
    body = F.transform("ks", lambda k: filled(METHODS, k))
    content = F.array_join(F.concat(F.array(filled(OPENS)), body, F.array(filled(CLOSES))), "\n")
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("s_suppkey") % 4).cast("int"))
    path = F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit("."), ending)
    return readers.as_files(supplied(t).select(F.lit("tpc").alias("repo"), path.alias("rel_path"), content.alias("content")))


@query(
    SUPPLIED + "SELECT repo, rel_path, 'S'||s AS name, CASE ext WHEN 'go' THEN 'struct' ELSE 'class' END AS kind, 2 AS line_start, CASE ext WHEN 'go' THEN 2 ELSE 3+4*(SELECT count(*) FROM m WHERE m.s=t.s) END AS line_end FROM t"
    " UNION ALL SELECT repo, rel_path, 'S'||s||joint||'m'||k, 'method', 4*r-1, 4*r+2 FROM t JOIN m USING (s)"
)
def scope_symbols(t: Tables) -> DataFrame:
    """Types and methods with their spans, in four languages."""
    return facts.fact_table(facts.extract(class_files(t)), "symbols").select("repo", "rel_path", "name", "kind", "line_start", "line_end")


@query(
    SUPPLIED + "SELECT repo, rel_path, 'S'||s||joint||'m'||k AS caller, 'work'||k AS callee, 'function' AS call_type, 4*r+1 AS line_number, 2 AS arguments_count FROM t JOIN m USING (s)"
    " UNION ALL SELECT repo, rel_path, 'S'||s||joint||'m'||k, '().test', 'method', 4*r+1, 1 FROM t JOIN m USING (s) WHERE ext='ts'"
)
def scope_calls(t: Tables) -> DataFrame:
    """Calls with the method that makes them; brackets in comments, strings, templates and patterns count for none."""
    return facts.fact_table(facts.extract(class_files(t)), "calls")


@query(SUPPLIED + "SELECT repo, rel_path, 'S'||s AS child, 'N'||n AS parent FROM t UNION ALL SELECT repo, rel_path, 'S'||s, 'I' FROM t WHERE ext<>'go'")
def scope_parents(t: Tables) -> DataFrame:
    """What classes extend and implement, and what structures embed."""
    return facts.fact_table(facts.extract(class_files(t)), "inheritances")


LINKED = "import { N~ as Base, run } from '../lib/n~'\nimport * as all from '../lib/n~'\nexport class S# extends Base {\n  make() { return new S#() }\n}\nconst own = (a) => run(a)\nexport function main() { own(1); all.stop(); missing(2) }\n"


@query(
    "WITH f AS (SELECT 'ts.s'||s_suppkey AS m, 'S'||s_suppkey AS c, 'lib.n'||s_nationkey AS n, 'N'||s_nationkey AS b FROM supplier) SELECT 'tpc' AS repo, src_id, tgt_id, kind FROM ("
    "SELECT m||'.'||c||'.make' AS src_id, m||'.'||c||'.<init>' AS tgt_id, 'calls' AS kind FROM f UNION ALL SELECT m||'.own', n||'.run', 'calls' FROM f UNION ALL SELECT m||'.main', m||'.own', 'calls' FROM f"
    " UNION ALL SELECT m||'.main', n||'.stop', 'calls' FROM f UNION ALL SELECT m||'.'||c, n||'.'||b, 'inherits' FROM f UNION ALL SELECT m, n, 'imports' FROM f, range(2))"
)
def scope_relations(t: Tables) -> DataFrame:
    """Suppliers as scripts: their calls and parents are led over imports to the files of nations; unknown names give no edge."""
    from treeline.plans.jobs import build

    rows = t.supplier.select("s_suppkey", "s_nationkey")
    path = F.concat(F.lit("ts/s"), F.col("s_suppkey").cast("string"), F.lit(".ts"))
    files = readers.as_files(rows.select(F.lit("tpc").alias("repo"), path.alias("rel_path"), filled((LINKED,) * 4).alias("content")))
    return build(files)["relations"].select("repo", "src_id", "tgt_id", "kind")
