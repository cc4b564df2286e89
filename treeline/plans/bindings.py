"""Base tables derived from the given ones, each with its SQL twin as a common table expression."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.common import cut

REPO = "tpc"


class Tables:
    """The given tables of one folder, and the base tables made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nations(self) -> DataFrame:
        n, r = self.nation, F.broadcast(self.region)
        return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("r"))

    def _functions(self, rows: DataFrame, key: str, nation: str, mark: str, balance: str) -> DataFrame:
        name = F.concat(F.lit(mark), F.col(key).cast("string"))
        path = F.concat_ws("/", "r", "n", F.concat(F.lit("f"), (F.col(key) % 20).cast("string"), F.lit(".py")))
        joined = rows.join(F.broadcast(self.nations()), F.col(nation) == F.col("n_nationkey"))
        return joined.select(
            F.col(key).alias("key"), F.concat_ws(".", "n", name).alias("id"), F.lit("function").alias("kind"), name.alias("name"), path.alias("file_path"),
            F.lit(1).alias("line_start"), (F.floor(F.abs(balance) / 100) + 1).cast("int").alias("line_end"), F.col(balance).alias("balance"),
        )

    def callers(self) -> DataFrame:
        return self._functions(self.customer, "c_custkey", "c_nationkey", "c", "c_acctbal")

    def callees(self) -> DataFrame:
        return self._functions(self.supplier, "s_suppkey", "s_nationkey", "_s", "s_acctbal")

    def entities(self) -> DataFrame:
        cols = ["id", "kind", "name", "file_path", "line_start", "line_end"]
        modules = self.nations().select(F.col("n").alias("id"), F.lit("module").alias("kind"), F.col("n").alias("name"), F.concat_ws("/", "r", "n", F.lit("__init__.py")).alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
        every = modules.select(*cols).unionByName(self.callers().select(*cols)).unionByName(self.callees().select(*cols))
        return every.select(F.lit(REPO).alias("repo"), "*", F.array().cast("array<string>").alias("decorators"))

    def calls(self) -> DataFrame:
        c = self.callers().select(F.col("key").alias("o_custkey"), F.col("id").alias("src_id"), "file_path")
        s = self.callees().select(F.col("key").alias("l_suppkey"), F.col("id").alias("tgt_id"))
        # each side finds its function first, so that the many calls are shuffled by order only
        callers = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
        rows = self.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber").join(s, "l_suppkey").join(callers, "l_orderkey")
        return rows.select(F.lit(REPO).alias("repo"), "src_id", "tgt_id", F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"), "file_path", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))

    def imports(self, calls: DataFrame | None = None) -> DataFrame:
        """Each module imports the other module that it calls most, ties by name. calls: calls(), where they are at hand."""
        src, tgt = F.substring_index("src_id", ".", 1), F.substring_index("tgt_id", ".", 1)
        n = (self.calls() if calls is None else calls).select(src.alias("src_id"), tgt.alias("tgt_id")).filter("src_id != tgt_id").groupBy("src_id", "tgt_id").agg(F.count("*").alias("n"))
        top = n.groupBy("src_id").agg(F.min_by("tgt_id", F.struct(-F.col("n"), F.col("tgt_id"))).alias("tgt_id"))
        paths = self.nations().select(F.col("n").alias("src_id"), F.concat_ws("/", "r", "n", F.lit("__init__.py")).alias("file_path"))
        return top.join(F.broadcast(paths), "src_id").select(F.lit(REPO).alias("repo"), "src_id", "tgt_id", F.lit("imports").alias("kind"), F.lit(0.5).alias("weight"), "file_path", F.lit(0).cast("long").alias("seq"))

    def handles(self) -> DataFrame:
        """Modules handle their customers of one market segment."""
        named = self.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
        rows = self.callers().join(named, "key")
        return rows.select(F.lit(REPO).alias("repo"), F.substring_index("id", ".", 1).alias("src_id"), F.col("id").alias("tgt_id"), F.lit("handles").alias("kind"), F.lit(1.0).alias("weight"), "file_path", F.lit(0).cast("long").alias("seq"))

    def relations(self) -> DataFrame:
        calls = cut(self.calls())
        return calls.unionByName(self.imports(calls)).unionByName(self.handles())

    def seeds(self) -> DataFrame:
        """The richest supplier of each region."""
        c = self.callees().join(F.broadcast(self.nations().select("n", "r")), F.substring_index("id", ".", 1) == F.col("n"))
        top = c.groupBy("r").agg(F.max_by("id", F.struct("balance", "id")).alias("id"))
        return top.select(F.lit(REPO).alias("repo"), F.col("id").alias("seed"), "id")

    def doc_path(self) -> Column:
        return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))

    def files(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return self.documents.select(F.lit("docs").alias("repo"), self.doc_path().alias("rel_path"), F.lit("py").alias("ext"), F.lit("python").alias("language"), F.lit("code").alias("kind"), F.lit(False).alias("is_test"), text.alias("content"), F.size(F.split(text, "\r?\n")).alias("n_lines"), "source", "lang")

    def hashes(self) -> DataFrame:
        return self.files().select("repo", "rel_path", F.sha2("content", 256).alias("sha256"))

    def earlier_hashes(self) -> DataFrame:
        """Before: no src3, other French texts, and files of benchmark items that are gone now."""
        old = self.files().filter("source != 'src3'").select("repo", "rel_path", F.sha2(F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
        gone = self.benchmark.select(F.lit("docs").alias("repo"), F.concat(F.lit("old/b"), F.col("item_id").cast("string"), F.lit(".py")).alias("rel_path"), F.sha2("text", 256).alias("sha256"))
        return old.unionByName(gone)

    def symbols(self) -> DataFrame:
        """One symbol for every five lines of a document."""
        rows = self.files().select("repo", "rel_path", "n_lines", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_lines") - 1) / 5).cast("int"))).alias("k"))
        return rows.select("repo", "rel_path", F.concat(F.lit("s"), F.col("k").cast("string")).alias("name"), (F.col("k") * 5 + 1).alias("line_start"), F.least(F.col("k") * 5 + 3, F.col("n_lines")).alias("line_end"))

    def hunks(self) -> DataFrame:
        """One range for each document; German files are added, Spanish ones deleted."""
        start = (F.col("n_chars") % 7 + 1).cast("int")
        kind = F.when(F.col("lang") == "de", "added").when(F.col("lang") == "es", "deleted").otherwise("modified")
        return self.documents.select(F.col("source").alias("commit"), self.doc_path().alias("path"), kind.alias("change_type"), start.alias("start"), (start + (F.col("n_chars") % 11).cast("int")).alias("end"))

    def routes(self) -> DataFrame:
        """Link targets of pages, declared by the page that comes first."""
        links = self.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)'), F.lit(1))).alias("path"), "page_id")
        return links.groupBy("path").agg(F.min("page_id").alias("page")).select(F.lit("web").alias("repo"), F.concat(F.lit("GET "), F.col("path")).alias("key"), "path", F.concat(F.lit("p"), F.col("page").cast("string")).alias("rel_path"))

    def sites(self) -> DataFrame:
        """Paths of page urls; org pages are documents, the others code."""
        path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
        kind = F.when(F.col("url").rlike(r"://[^/?#]*\.org[/?#]"), "doc").otherwise("code")
        return self.pages.select(F.lit("web").alias("repo"), F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("rel_path"), kind.alias("kind"), path.alias("path"))


@cache
def cte() -> dict[str, str]:
    """Common table expressions by name; each may use those before it."""
    f = "CAST(floor(abs({b})/100) AS INTEGER)+1"
    return {
        "nat": "SELECT n_nationkey, replace(n_name,' ','_') AS n, replace(r_name,' ','_') AS r FROM nation JOIN region ON n_regionkey=r_regionkey",
        "cust": f"SELECT c_custkey AS key, n||'.c'||c_custkey AS id, 'c'||c_custkey AS name, r||'/'||n||'/f'||(c_custkey%20)||'.py' AS file_path, {f.format(b='c_acctbal')} AS line_end, c_acctbal AS balance, c_mktsegment FROM customer JOIN nat ON c_nationkey=n_nationkey",
        "supp": f"SELECT s_suppkey AS key, n||'._s'||s_suppkey AS id, '_s'||s_suppkey AS name, r||'/'||n||'/f'||(s_suppkey%20)||'.py' AS file_path, {f.format(b='s_acctbal')} AS line_end, s_acctbal AS balance FROM supplier JOIN nat ON s_nationkey=n_nationkey",
        "ent": "SELECT n AS id, 'module' AS kind, n AS name, r||'/'||n||'/__init__.py' AS file_path, 1 AS line_start, 1 AS line_end FROM nat UNION ALL SELECT id,'function',name,file_path,1,line_end FROM cust UNION ALL SELECT id,'function',name,file_path,1,line_end FROM supp",
        "calls": "SELECT c.id AS src_id, s.id AS tgt_id, 'calls' AS kind, 1.0::DOUBLE AS weight, c.file_path, l_orderkey*10+l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN cust c ON o_custkey=c.key JOIN supp s ON l_suppkey=s.key",
        "imps": "SELECT src_id, tgt_id, 'imports' AS kind, 0.5::DOUBLE AS weight, r||'/'||n||'/__init__.py' AS file_path, 0 AS seq FROM (SELECT src_id, tgt_id, row_number() OVER (PARTITION BY src_id ORDER BY count(*) DESC, tgt_id) AS k FROM (SELECT split_part(src_id,'.',1) AS src_id, split_part(tgt_id,'.',1) AS tgt_id FROM calls) WHERE src_id<>tgt_id GROUP BY 1,2) JOIN nat ON n=src_id WHERE k=1",
        "hand": "SELECT split_part(id,'.',1) AS src_id, id AS tgt_id, 'handles' AS kind, 1.0::DOUBLE AS weight, file_path, 0 AS seq FROM cust WHERE c_mktsegment='BUILDING'",
        "rel": "SELECT * FROM calls UNION ALL SELECT * FROM imps UNION ALL SELECT * FROM hand",
        "edges": "SELECT src_id, tgt_id, arg_max(kind, seq) AS kind, arg_max(weight, seq) AS weight, arg_max(file_path, seq) AS file_path FROM rel GROUP BY 1,2",
        "seeds": "SELECT id FROM (SELECT supp.id, row_number() OVER (PARTITION BY r ORDER BY balance DESC, supp.id DESC) AS k FROM supp JOIN nat ON n=split_part(supp.id,'.',1)) WHERE k=1",
        "files": "SELECT source||'/'||lang||'/d'||doc_id||'.py' AS rel_path, coalesce(text,'') AS content, source, lang, doc_id, len(string_split(replace(coalesce(text,''),chr(13)||chr(10),chr(10)),chr(10))) AS n_lines, string_split(replace(coalesce(text,''),chr(13)||chr(10),chr(10)),chr(10)) AS lines FROM documents",
        "now_h": "SELECT rel_path, sha256(content) AS sha256 FROM files",
        "old_h": "SELECT rel_path, sha256(CASE WHEN lang='fr' THEN content||'!' ELSE content END) AS sha256 FROM files WHERE source<>'src3' UNION ALL SELECT 'old/b'||item_id||'.py', sha256(text) FROM benchmark",
        "syms": "SELECT rel_path, 's'||k AS name, k*5+1 AS line_start, least(k*5+3, n_lines) AS line_end, lines, n_lines FROM files, unnest(range(0, CAST(floor((n_lines-1)/5) AS BIGINT)+1)) AS t(k)",
        "hunks": "SELECT source AS commit, source||'/'||lang||'/d'||doc_id||'.py' AS path, CASE lang WHEN 'de' THEN 'added' WHEN 'es' THEN 'deleted' ELSE 'modified' END AS change_type, n_chars%7+1 AS s, n_chars%7+1+n_chars%11 AS e FROM documents",
        "routes": "SELECT 'GET '||path AS key, path, 'p'||min(page_id) AS rel_path FROM (SELECT page_id, unnest(regexp_extract_all(html,'href=\"(/[^\"?#]*)',1)) AS path FROM pages) GROUP BY path",
        "sites": "SELECT 'u'||page_id AS rel_path, CASE WHEN regexp_matches(url,'://[^/?#]*\\.org[/?#]') THEN 'doc' ELSE 'code' END AS kind, regexp_extract(url,'://[^/?#]*([^?#]*)',1) AS path FROM pages",
    }


#: What each expression reads of the others.
NEEDS = {
    "cust": ["nat"], "supp": ["nat"], "ent": ["cust", "supp"], "calls": ["cust", "supp"], "imps": ["calls"], "hand": ["cust"], "rel": ["calls", "imps", "hand"],
    "edges": ["rel"], "seeds": ["supp"], "now_h": ["files"], "old_h": ["files"], "syms": ["files"],
}


def with_tables(names: str, more: str = "", recursive: bool = False) -> str:
    """WITH of the named expressions and all that they need, and further ones."""
    wanted: set[str] = set()

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        wanted.add(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({sql})" for n, sql in cte().items() if n in wanted]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, *([more] if more else [])])} "
