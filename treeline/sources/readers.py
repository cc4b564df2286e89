"""Readers of trees, graph stores, traces, diffs, coverage reports, policies and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from treeline.functions.text import GATES, SINKS, STATE_COLUMNS, evidence_kind, excluded, extension, is_test_by_tokens, language

#: Folders that no corpus wants: version control, environments, packages, build outputs, editors, coverage, caches and tests. Fixed values.
EXCLUDED_FOLDERS = (
    ".git", ".svn", ".hg", ".worktrees", ".codex-worktrees",
    ".venv", "venv", "__pycache__", "*.egg-info", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "node_modules", ".yarn", ".pnpm-store", "bower_components",
    "dist", "build", "out", "target", "_build", ".next", ".nuxt", ".output", ".svelte-kit", ".turbo",
    ".gradle", ".m2", ".idea", ".vscode", ".vs", ".eclipse", "htmlcov", ".nyc_output", "coverage", ".cache", ".tmp", ".temp",
    "tests", "test", "__tests__", "spec", "e2e", "cypress",
)
EXCLUDES = [f"**/{f}/**" for f in EXCLUDED_FOLDERS]
#: Folders that audits never enter. Fixed values.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", ".pnpm-store", ".yarn", "bower_components",
    "__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".cache",
    "dist", "build", "out", "target", "_build", ".next", ".nuxt", ".output", ".svelte-kit", ".turbo",
    "coverage", "htmlcov", ".nyc_output", ".idea", ".vscode", ".worktrees", ".playwright-mcp", "vendor", "third_party",
)
#: Generated stores, and what names of suffixed environments begin with. Fixed values.
GENERATED_FOLDERS, ENVIRONMENTS = ("indexes", "saas_indexes", "saas_repos"), (".venv", ".virtualenv", "venv", "virtualenv")
MAX_AUDIT_BYTES = 2 * 1024 * 1024


def is_generated(folder: Column) -> Column:
    """A generated store, or an environment with a suffix such as .venv-a or venv_2."""
    name = F.lower(folder)
    found = name.isin(*GENERATED_FOLDERS)
    for e in ENVIRONMENTS:
        rest = F.substr(name, F.lit(len(e) + 1))
        found = found | (name.startswith(e) & F.substring(rest, 1, 1).isin(".", "_", "-") & (F.length(rest) > 1))
    return found


def generated_patterns(files: DataFrame) -> DataFrame:
    """repo, pattern: the generated top folders of each repository as exclude patterns."""
    top = F.substring_index("rel_path", "/", 1)
    rows = files.filter(F.contains(F.col("rel_path"), F.lit("/")) & is_generated(top))
    return rows.select("repo", F.concat(F.lit("**/"), top, F.lit("/**")).alias("pattern")).distinct()


def exclude_table(spark: SparkSession, user: list[str] = (), detected: list[str] = ()) -> DataFrame:
    """source, pattern: built-in, detected and the user's patterns, each once with its first source."""
    rows = [("builtin", p) for p in EXCLUDES] + [("detected", p) for p in detected] + [("user", p) for p in user]
    table = spark.createDataFrame(rows, "source string, pattern string")
    return table.groupBy("pattern").agg(F.min("source").alias("source"))


def tree(spark: SparkSession, root: str, keep: Column, limit: int | None = None) -> DataFrame:
    """rel_path, content, bytes of a tree's files that `keep` keeps by rel_path; paths and sizes are filtered before contents are read. Hidden folders are listed too; links are followed where the file system hides them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), f"^{re.escape(base)}/", "")
    rows = found.withColumn("rel_path", rel).filter(keep)
    if limit is not None:
        rows = rows.filter(F.col("length") <= limit)
    return rows.select("rel_path", F.decode("content", "utf-8").alias("content"), F.col("length").alias("bytes"))


def corpus(spark: SparkSession, root: str, repo: str, patterns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """All files of a tree with a known extension, without what the patterns and generated folders exclude."""
    path = F.col("rel_path")
    known = evidence_kind(path) != "other"
    keep = ~excluded(path, EXCLUDES if patterns is None else patterns) & ~is_generated(F.substring_index(path, "/", 1)) & (known | language(path).isNotNull())
    return as_files(tree(spark, root, keep, limit).select(F.lit(repo).alias("repo"), "rel_path", "content", "bytes"))


def audit_corpus(spark: SparkSession, root: str, repo: str, patterns: tuple[str, ...] = (), links: DataFrame | None = None) -> DataFrame:
    """What audits read: files of a known kind and at most 2 MiB, outside skipped and generated folders. links(rel_path) names symbolic links, which Spark's listing does not tell from files."""
    folders = F.split("rel_path", "/")
    inside = F.slice(folders, 1, F.size(folders) - 1)
    skip = F.arrays_overlap(inside, F.array(*[F.lit(f) for f in SKIPPED_FOLDERS])) | F.exists(inside, is_generated)
    keep = ~skip & (evidence_kind(F.col("rel_path")) != "other")
    if patterns:
        keep = keep & ~excluded(F.col("rel_path"), list(patterns))
    rows = tree(spark, root, keep, MAX_AUDIT_BYTES)
    if links is not None:
        rows = rows.join(links.select("rel_path").distinct(), "rel_path", "left_anti")
    return as_files(rows.select(F.lit(repo).alias("repo"), "rel_path", "content", "bytes"))


def as_files(texts: DataFrame) -> DataFrame:
    """repo, rel_path, content(, bytes) -> the files table: any text table can stand in for a tree."""
    path = F.col("rel_path")
    size = F.col("bytes") if "bytes" in texts.columns else F.octet_length("content").cast("long")
    return texts.select(
        "repo", "rel_path", extension(path).alias("ext"), language(path).alias("language"), evidence_kind(path).alias("kind"), is_test_by_tokens(path).alias("is_test"),
        "content", F.sha2("content", 256).alias("sha256"), F.size(F.split("content", "\r?\n")).alias("n_lines"), size.alias("bytes"),
    )


def graph_store(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """A node-link JSON graph as entities and relations; edges may be called links or edges. Other keys are dropped."""
    node = "struct<id:string,kind:string,name:string,description:string,file_path:string,line_start:int,line_end:int,decorators:array<string>>"
    edge = "struct<source:string,target:string,kind:string,description:string,file_path:string,weight:double>"
    raw = spark.read.schema(f"nodes array<{node}>, links array<{edge}>, edges array<{edge}>").option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("seq", "n")).filter("n.kind is not null").select(F.lit(repo).alias("repo"), "n.*", F.col("seq").cast("long").alias("seq"))
    links = raw.select(F.posexplode(F.coalesce("edges", "links")).alias("seq", "e"))
    edges = links.select(F.lit(repo).alias("repo"), F.col("e.source").alias("src_id"), F.col("e.target").alias("tgt_id"), "e.kind", "e.description", "e.file_path", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), F.lit("static").alias("origin"), F.col("seq").cast("long").alias("seq"))
    return nodes, edges


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by repo; only the repositories in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def trace_map(texts: DataFrame) -> DataFrame:
    """repo, content with a JSON map "a->b": n -> repo, edge, times."""
    return texts.select("repo", F.explode(F.from_json("content", "map<string,bigint>")).alias("edge", "times"))


def trace_list(texts: DataFrame) -> DataFrame:
    """repo, content with a JSON array of {from, to} -> repo, from, to."""
    return texts.select("repo", F.explode(F.from_json("content", "array<struct<from:string,to:string>>")).alias("e")).select("repo", "e.*")


def carried(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def diff_hunks(lines: DataFrame) -> DataFrame:
    """commit, line_no, line of unified diffs -> hunks: commit, path, change_type, side, start, end. The file is carried down to its hunks."""
    part = lambda p, g=1: F.regexp_extract("line", p, g)
    some = lambda c: F.when(c != "", c)
    path = some(part(r"^diff --git a/.* b/(.*)$"))
    down = carried(["commit"], "line_no")
    rows = lines.withColumn("path", F.last(path, True).over(down))
    inside = carried(["commit", "path"], "line_no")
    rows = rows.withColumn("change_type", F.coalesce(F.last(F.when(F.col("line").startswith("new file mode"), "added").when(F.col("line").startswith("deleted file mode"), "deleted"), True).over(inside), F.lit("modified")))
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    hunk = rows.filter(F.col("line").rlike(head))
    n = lambda g: F.when(part(head, g) == "", 1).otherwise(part(head, g).cast("int"))
    sides = F.explode(F.array(F.struct(F.lit("deleted").alias("side"), n(1).alias("start"), n(2).alias("length")), F.struct(F.lit("added").alias("side"), n(3).alias("start"), n(4).alias("length"))))
    found = hunk.select("commit", "path", "change_type", sides.alias("s")).filter("s.length > 0")
    return found.select("commit", "path", "change_type", "s.side", "s.start", (F.col("s.start") + F.col("s.length") - 1).alias("end"))


def lcov(lines: DataFrame) -> DataFrame:
    """repo, report, line_no, line -> coverage; a file's records add up, and end_of_record ends a file."""
    file = F.regexp_extract("line", "^SF:(.*)$", 1)
    marks = F.when(file != "", F.trim(file)).when(F.trim("line") == "end_of_record", "")
    rows = lines.withColumn("file", F.last(marks, True).over(carried(["repo", "report"], "line_no")))
    value = lambda tag: F.coalesce(F.sum(F.when(F.col("line").startswith(f"{tag}:"), F.try_to_number(F.regexp_extract("line", r":(\d+)", 1), F.lit("999999999999")).cast("long"))), F.lit(0)).alias(tag.lower())
    return rows.filter("file != ''").groupBy("repo", "file").agg(*[value(t) for t in ("LH", "LF", "FNH", "FNF")])


def go_profile(lines: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """repo, report, line_no, line of Go cover profiles -> coverage by statements.

    A report whose first line is no mode: is not read. modules(repo, module) names the module whose prefix paths lose.
    """
    own = [c for c in ("repo", "report") if c in lines.columns]
    rows = lines
    if "line_no" in lines.columns:
        told = lines.groupBy(*own).agg(F.min_by("line", "line_no").alias("first")).filter(F.col("first").startswith("mode:")).select(*own)
        rows = lines.join(told, own, "left_semi")
    part = F.split("line", " ")
    rows = rows.filter((F.size(part) == 3) & F.get(part, F.lit(0)).rlike(r":\d+\.\d+,\d+\.\d+$"))
    rows = rows.select("repo", F.regexp_replace(F.get(part, F.lit(0)), ":[^:]*$", "").alias("file"), F.get(part, F.lit(1)).try_cast("long").alias("n"), F.get(part, F.lit(2)).try_cast("long").alias("hits")).filter("n is not null and hits is not null")
    if modules is not None:
        rows = rows.join(modules.select("repo", "module"), "repo", "left")
        rows = rows.withColumn("file", F.when(F.col("file").startswith(F.concat("module", F.lit("/"))), F.substr("file", F.length("module") + 2)).otherwise(F.col("file"))).drop("module")
    zero = F.lit(0).cast("long")
    return rows.groupBy("repo", "file").agg(F.sum(F.when(F.col("hits") > 0, F.col("n")).otherwise(zero)).alias("lh"), F.sum("n").alias("lf")).select("*", zero.alias("fnh"), zero.alias("fnf"))


POLICY = "repo string, error string, exempt array<struct<table:string,entry:string,reason:string,ord:int>>, gates array<string>, sinks array<string>, state_columns array<string>"


def policy_files(texts: DataFrame) -> DataFrame:
    """repo, content of policy files -> a row of POLICY each: exemptions as lists, lists of {id, reason} or {name, reason}, or maps, and a repository's own gate, sink and state patterns.

    Patterns that a file does not give are the defaults. A file that cannot be read gives its error, no exemptions and
    the defaults: audits are never off.
    """
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(POLICY)]
    defaults = {"gates": list(GATES), "sinks": list(SINKS), "state_columns": list(STATE_COLUMNS)}

    def entries(raw) -> list[tuple[str, str]]:
        if isinstance(raw, dict):
            return [(str(k), "" if v is None else str(v)) for k, v in raw.items()]
        named = [(e.get("id") or e.get("name"), str(e.get("reason", ""))) if isinstance(e, dict) else (e, "") for e in raw or []]
        return [(str(k), v) for k, v in named if k]

    def of(repo: str, text: str | None) -> dict:
        import yaml

        row = {"repo": repo, "error": None, "exempt": [], **defaults}
        try:
            said = yaml.safe_load(text or "") or {}
            own = said.get("envelope") or {}
            row["exempt"] = [{"table": t, "entry": k, "reason": v, "ord": n} for t, raw in (said.get("exempt") or {}).items() for n, (k, v) in enumerate(entries(raw))]
            given = {"gates": own.get("gate_patterns"), "sinks": own.get("sink_patterns"), "state_columns": said.get("state_columns")}
            return row | {k: [str(x) for x in v] for k, v in given.items() if v}
        except (yaml.YAMLError, AttributeError, TypeError) as e:
            return {"repo": repo, "error": str(e)[:200], "exempt": [], **defaults}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(repo, text) for repo, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return texts.select("repo", "content").mapInArrow(read, POLICY)


def policies(texts: DataFrame) -> DataFrame:
    """repo, content of policy files -> repo, table, entry, reason, ord, error: their exemptions; an unreadable file gives a row with its error."""
    rows = policy_files(texts)
    listed = rows.select("repo", "error", F.explode_outer("exempt").alias("e")).filter("e is not null or error is not null")
    return listed.select("repo", "e.table", "e.entry", "e.reason", "e.ord", "error")


def baseline(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return lines.select(F.trim("line").alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#"))


def gate_manifest(lines: DataFrame) -> DataFrame:
    """path|note and exempt:path|note rows -> path, note, exempt."""
    rows = baseline(lines).withColumn("exempt", F.col("key").startswith("exempt:"))
    body = F.regexp_replace("key", "^exempt:", "")
    return rows.select(F.trim(F.split_part(body, F.lit("|"), F.lit(1))).alias("path"), F.trim(F.split_part(body, F.lit("|"), F.lit(2))).alias("note"), "exempt")
