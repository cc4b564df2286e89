"""What audits read from text: call sites, configuration keys, state declarations and uses, writes, and guarded handlers.

Lines are split once and judged by column functions; SQL statements are read by tokens inside tasks.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from treeline.functions.text import GATES, STATE_COLUMNS, has_any, has_gate, is_read_shaped
from treeline.operators import facts
from treeline.operators.common import by_policy, spread, stepped
from treeline.operators.corpus import hits_in_context, lines
from treeline.operators.facts import text_of
from treeline.operators.statements import lines_of, schema_events, written_literals


def all_of(pattern: str, group: int = 1, text: str = "content") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: An upper-case name of three characters or more.
NAME = "[A-Z][A-Z0-9_]{2,}"
#: What may stand in a path as a call writes it, and what may stand around it.
PATH_PIECE = r"([\w.$%*(){}-]?)(\s*['\"`]?)((?:/[\w.${}%*()-]*)+)([?#'\"`]?)"


def line_paths(line: Column) -> Column:
    """array<string> of what reads like a path that is called in a line.

    A run of slashes and segments is cut out once, with the mark before it and the one after it. It counts from
    two segments on, whole or, where a segment in brackets parts it, on either side; each segment that closes an interpolation or a sum before it counts alone; so does a single
    segment that is all of a quoted string, up to a query.
    """
    part = lambda g: F.regexp_extract_all(line, F.lit(PATH_PIECE), F.lit(g))
    found = F.arrays_zip(part(1).alias("lead"), part(2).alias("quote"), part(3).alias("body"), part(4).alias("end"))

    def of_piece(p: Column) -> Column:
        segments = F.filter(F.split(p["body"], "/"), lambda s: s != "")
        # A bracketed segment ends a run: what stands before and after it are two paths.
        runs = F.transform(F.split(p["body"], "/[()][^/]*"), lambda r: F.filter(F.split(r, "/"), lambda s: s != ""))
        bare = F.transform(segments, lambda s: F.regexp_extract(s, "^[^()]*", 0))
        before = F.concat(F.array(p["lead"]), F.transform(segments, lambda s: F.right(s, F.lit(1))))
        tails = F.filter(F.transform(bare, lambda s, i: F.when(F.get(before, i).isin("}", ")", "+"), s)), lambda s: s.isNotNull() & (s != ""))
        whole = F.transform(F.filter(runs, lambda r: F.size(r) > 1), lambda r: F.concat(F.lit("/"), F.array_join(r, "/")))
        alone = F.when((F.size(segments) == 1) & (F.trim(p["quote"]) != "") & (p["end"] != "") & ~p["body"].contains("("), F.array(F.concat(F.lit("/"), F.get(segments, F.lit(0)))))
        none = F.array().cast("array<string>")
        return F.concat(whole, F.transform(tails, lambda s: F.concat(F.lit("/"), s)), F.coalesce(alone, none))

    return F.array_distinct(F.flatten(F.transform(found, of_piece)))


def call_sites(files: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """repo, rel_path, kind, path of each path that is called; tests are of kind test. Lines of declarations, routes(repo, rel_path, line_start, line_end), call nothing."""
    rows = lines(files).filter(F.contains(F.col("line"), F.lit("/"))).select("repo", "rel_path", "line_no", line_paths(F.col("line")).alias("paths")).filter(F.size("paths") > 0)
    if routes is not None:
        spans = routes.select("repo", "rel_path", F.explode(F.sequence("line_start", "line_end")).alias("line_no")).distinct()
        rows = rows.join(spans, ["repo", "rel_path", "line_no"], "left_anti")
    found = rows.select("repo", "rel_path", F.explode("paths").alias("path")).distinct().join(files.select("repo", "rel_path", "kind", "is_test"), ["repo", "rel_path"])
    return found.select("repo", "rel_path", F.when(F.col("is_test"), "test").otherwise(F.col("kind")).alias("kind"), "path")


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^/]*)$", 1))


def line_head(line: Column) -> tuple[Column, Column]:
    """The name that a line begins with, after export, a dash, ENV or ARG, and the mark after it: = or : or none."""
    shape = rf"^\s*(?:(export|-|ENV|ARG|const|export const)\s+)?({NAME})\s*(=|:(?=\s|$)|:)?"
    return F.regexp_extract(line, shape, 2), F.concat(F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 3))


def env_declarations(files: DataFrame) -> DataFrame:
    """repo, key, rel_path of the first file, by path, that declares an environment key: KEY= of env and compose files, KEY: of compose files, ENV and ARG of Dockerfiles."""
    base = base_name(F.col("rel_path"))
    sort = F.when(base.startswith(".env") | base.contains(".env.") | base.endswith(".env"), "env").when(base.contains("compose") & (F.col("kind") == "config"), "compose").when(base.startswith("dockerfile"), "docker")
    known = files.withColumn("sort", sort).filter("sort is not null")
    name, around = line_head(F.col("line"))
    rows = lines(known).join(known.select("repo", "rel_path", "sort"), ["repo", "rel_path"]).select("repo", "rel_path", "sort", "line", name.alias("key"), around.alias("around")).filter("key != ''")
    assigns = F.col("around").isin("=", "export=", "-=")
    maps = (F.col("around") == ":") & F.col("line").rlike(rf"^\s+{NAME}\s*:(\s|$)")
    declares = F.when(F.col("sort") == "env", assigns).when(F.col("sort") == "compose", assigns | maps).otherwise(F.col("around").rlike("^(ENV|ARG)"))
    return rows.filter(declares).groupBy("repo", "key").agg(F.min("rel_path").alias("rel_path"))


def config_constants(files: DataFrame) -> DataFrame:
    """repo, name, rel_path, self_used: upper-case constants of configuration modules, in the first that has them, and whether its own file uses them again."""
    base = F.regexp_extract("rel_path", "([^/]*)$", 1)
    stem, ending = F.substring_index(F.substring_index(base, ".", 1), "_", 1), F.regexp_extract(base, r"^\w+\.(py|ts|js|mjs)$", 1)
    module = files.filter(~F.col("is_test") & (ending != "") & stem.isin("config", "settings", "constants", "env", "conf"))
    name, around = line_head(F.col("line"))
    python = F.col("rel_path").endswith(".py")
    is_constant = F.when(python, F.col("line").rlike("^[A-Z]") & (F.col("around").isin("=") | (F.col("around").startswith(":") & F.contains(F.col("line"), F.lit("="))))).otherwise(F.col("around").rlike("const[=:]$"))
    found = lines(module).select("repo", "rel_path", "line", name.alias("name"), around.alias("around")).filter((F.col("name") != "") & is_constant).groupBy("repo", "name").agg(F.min("rel_path").alias("rel_path"))
    uses = module.select("repo", "rel_path", F.explode(all_of(rf"\b({NAME})\b")).alias("name")).groupBy("repo", "rel_path", "name").agg(F.count("*").alias("times"))
    return found.join(uses, ["repo", "rel_path", "name"], "left").select("repo", "name", "rel_path", (F.coalesce("times", F.lit(0)) > 1).alias("self_used"))


def bound_keys(content: str) -> set[str]:
    """Upper-cased keys that the settings classes of a Python module read: each env_prefix, as an argument, a variable or a key of a literal, with each annotated field of a class."""
    prefixes, fields = [], set()
    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.ClassDef):
            fields |= {s.target.id for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.target.id[0].isalpha() and s.target.id == s.target.id.lower()}
        elif isinstance(node, ast.keyword) and node.arg == "env_prefix":
            prefixes.append(node.value)
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "env_prefix" for t in node.targets):
            prefixes.append(node.value)
        elif isinstance(node, ast.Dict):
            prefixes += [v for k, v in zip(node.keys, node.values, strict=True) if text_of(k) == "env_prefix"]
    names = {p for p in map(text_of, prefixes) if p and p.isidentifier() and p[0] != "_"}
    return {(p + f).upper() for p in names for f in fields}


def settings_keys(files: DataFrame) -> DataFrame:
    """repo, key: what settings classes of Python files that are no tests read from the environment. A prefix is a name: empty ones bind nothing; a file that does not parse binds nothing."""

    def rows(repo: str, content: str) -> list[dict]:
        try:
            return [{"repo": repo, "key": k} for k in bound_keys(content)]
        except (SyntaxError, ValueError, RecursionError):
            return []

    some = files.filter(F.col("rel_path").endswith(".py") & ~F.col("is_test") & F.contains(F.col("content"), F.lit("env_prefix")))
    return in_tasks(some.select("repo", "content"), "repo string, key string", rows).distinct()


def interpolations(files: DataFrame) -> DataFrame:
    """repo, key, rel_path of $KEY, ${KEY} and ${KEY:-default}: what follows a dollar sign, with or without a brace."""
    after = F.transform(F.slice(F.split("content", r"\$\{?"), 2, F.size(F.split("content", r"\$"))), lambda s: F.regexp_extract(s, f"^{NAME}", 0))
    return files.select("repo", F.explode(F.array_distinct(after)).alias("key"), "rel_path").filter("key != ''").select("repo", "key", "rel_path")


EVENTS = "repo string, rel_path string, event string, table string, column string, values array<string>, is_replace boolean, owner_at long, position long, line_start int, line_end int"


def in_tasks(rows: DataFrame, schema: str, of_row: Callable[..., list[dict]]) -> DataFrame:
    """of_row(*values) -> rows of schema, for each row, in Arrow batches. Rows are dealt over tasks first: reading them in Python takes far longer than bringing them."""
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, 64):
            found = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in of_row(*row)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(fields))

    return spread(rows, *rows.columns).mapInArrow(run, schema)


def declarations(files: DataFrame) -> DataFrame:
    """What SQL files declare and drop, as rows of EVENTS."""
    return in_tasks(files.filter("kind = 'sql'").select("repo", "rel_path", "content"), EVENTS, lambda repo, path, text: [e | {"repo": repo, "rel_path": path} for e in schema_events(text or "")])


def state_events(files: DataFrame, columns: tuple[str, ...] = STATE_COLUMNS, events: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """repo, table, column, values, is_check, is_replace, default_value, seq from migrations in file order: of a file checks first, then defaults, then enum types.

    policies(repo, state_columns) say for their repositories which columns hold states, in place of `columns`. Checks of one statement on one column are taken together. seq compares by file, sort and place, so nothing is numbered over a whole repository.
    """
    rows = events if events is not None else declarations(files)
    phase = F.when(F.col("event") == "check", 1).when(F.col("event") == "default", 2).when(F.col("event") == "enum", 3)
    known = by_policy(rows.withColumn("phase", phase).filter(phase.isNotNull()), policies, "state_columns", columns).filter(has_any(F.col("column"), F.col("state_columns")))
    together = F.when(F.col("phase") == 1, F.col("owner_at")).otherwise(-2 - F.col("position"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "values", "is_replace")))
    grouped = known.groupBy("repo", "rel_path", "table", "column", "phase", together.alias("statement")).agg(ordered.alias("parts"))
    values = F.flatten(F.transform("parts", lambda p: p["values"]))
    return grouped.select(
        "repo", "table", "column", values.alias("values"), (F.col("phase") == 1).alias("is_check"), F.element_at("parts", -1)["is_replace"].alias("is_replace"),
        F.when(F.col("phase") == 2, F.element_at(values, 1)).alias("default_value"), F.struct("rel_path", "phase", F.element_at("parts", 1)["position"].alias("position")).alias("seq"),
    )


def drop_events(files: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """repo, table, column (null: the table itself), rel_path, position, line_no of the last drop in migration order; tests drop nothing."""
    rows = (events if events is not None else declarations(files)).filter(F.col("event").startswith("drop")).join(files.filter(~F.col("is_test")).select("repo", "rel_path"), ["repo", "rel_path"], "left_semi")
    last = F.max(F.struct("rel_path", "position", F.col("line_start").alias("line_no"))).alias("at")
    return rows.groupBy("repo", "table", F.when(F.col("event") == "drop_column", F.col("column")).alias("column")).agg(last).select("repo", "table", "column", "at.*")


def literal_uses(files: DataFrame, wanted: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """wanted(repo, value) -> uses: repo, value, rel_path, line_no, is_test, is_read, context of two lines to either side. Lines that declare a value do not use it; other lines of SQL do."""
    rows = hits_in_context(files, lambda line: line.rlike("['\"]"), "is_test")
    values = F.array_distinct(F.concat(*[F.regexp_extract_all("line", F.lit(f"{q}([^{q}]+){q}"), F.lit(1)) for q in ("'", '"')]))
    kept = rows.withColumn("value", F.explode(values)).join(wanted.select("repo", "value").distinct(), ["repo", "value"], "left_semi")
    declared = (events if events is not None else declarations(files)).filter(F.col("event").isin("check", "default", "enum"))
    kept = kept.join(declared.select("repo", "rel_path", F.explode(F.sequence("line_start", "line_end")).alias("line_no")).distinct(), ["repo", "rel_path", "line_no"], "left_anti")
    return kept.select("repo", "value", "rel_path", "line_no", "is_test", is_read_shaped(F.col("line")).alias("is_read"), "context")


def literal_writes(files: DataFrame) -> DataFrame:
    """repo, table, column, value, place of literals that statements write, wherever they stand. Only files with INSERT or UPDATE are read, and no tests."""

    def rows(repo: str, path: str, text: str) -> list[dict]:
        line = lines_of(text)
        return [{"repo": repo, "table": t, "column": c, "value": v, "place": f"{path}:{line(at)}"} for t, c, v, at in written_literals(text)]

    some = files.filter(~F.col("is_test") & F.col("content").rlike(r"(?i)\b(insert|update)\b")).select("repo", "rel_path", "content")
    return in_tasks(some, "repo string, table string, column string, value string, place string", rows)


def routed_handlers(files: DataFrame, gates: tuple[str, ...] = GATES, found: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """repo, rel_path, handler, line_no, guarded: functions with a decorator that registers a route on a variable, and whether their decorators or their signature name a gate. found: facts of the files; policies(repo, gates) name the gates of their repositories, in place of `gates`.

    Without facts at hand, files are parsed for their symbols alone, and only those that hold an @, without which nothing is decorated.
    """
    facts_ = found if found is not None else facts.extract(files.filter(F.col("rel_path").endswith(".py") & F.contains("content", F.lit("@"))), facts.SYMBOLS_ALONE)

    def registers(decorator: Column) -> Column:
        called = F.split(F.substring_index(decorator, "(", 1), r"\.")
        return F.contains(decorator, F.lit("(")) & (F.size(called) == 2) & F.lower(F.element_at(called, -1)).isin(*facts.METHODS, "route")

    rows = facts.fact_table(facts_, "symbols").filter((F.col("kind") != "class") & F.exists("annotations", registers))
    told = F.array_join(F.concat("annotations", F.array("signature")), "\n")
    return by_policy(rows, policies, "gates", gates).select("repo", "rel_path", F.substring_index("name", ".", -1).alias("handler"), F.col("line_start").alias("line_no"), has_gate(told, F.col("gates")).alias("guarded"))


def gate_signals(files: DataFrame) -> DataFrame:
    """repo, rel_path, role, asserts, exits, skips: runners, checkers and manifests by name, with how often they assert, exit and skip."""
    name = F.lower(F.regexp_extract("rel_path", "([^/]*)$", 1))
    role = F.when(name.rlike(r"^(run|gate|ci)[-_].*\.(sh|py|mjs)$"), "runner").when(name.rlike(r"^(check|verify|lint)[-_].*\.(sh|py|mjs|js)$"), "checker").when(name.rlike(r"manifest\.(txt|md|json)$"), "manifest")
    count = lambda p: F.regexp_count("content", F.lit(p))
    return files.select("repo", "rel_path", role.alias("role"), count(r"\bassert\b").alias("asserts"), count(r"\bexit\b").alias("exits"), count(r"\bskip").alias("skips")).filter("role is not null")
