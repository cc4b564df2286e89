"""Files, lines, chunks and what can be read from them without a parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.ids import chunk_id, entity_id, module_id, residual_chunk_id
from treeline.functions.text import excluded

SYMBOL_CHARS, RESIDUAL_CHARS = 8192, 2000
CUT_MARK = "\n... (truncated)"


def lines(files: DataFrame) -> DataFrame:
    """repo, rel_path, line_no from 1, line."""
    return files.select("repo", "rel_path", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).select("repo", "rel_path", (F.col("at") + 1).alias("line_no"), "line")


def content_hash(files: DataFrame) -> DataFrame:
    return files.select("repo", "rel_path", F.sha2("content", 256).alias("sha256"))


def symbol_chunks(files: DataFrame, symbols: DataFrame, limit: int = SYMBOL_CHARS) -> DataFrame:
    """One chunk a symbol: its lines, cut at `limit` characters with a mark; blank ones are left out.

    A file's spans are gathered first, so that its text moves and is split once, however many symbols it has.
    """
    spans = symbols.groupBy("repo", "rel_path").agg(F.collect_list(F.struct("name", "line_start", "line_end")).alias("spans"))
    split = files.select("repo", "rel_path", "content").join(spans, ["repo", "rel_path"]).select("repo", "rel_path", F.split("content", "\r?\n").alias("lines"), "spans")
    body = lambda s: F.array_join(F.slice("lines", s["line_start"], s["line_end"] - s["line_start"] + 1), "\n")
    each = F.transform("spans", lambda s: F.struct(s["name"].alias("name"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), body(s).alias("body")))
    module = module_id(F.col("rel_path"))
    cut = F.when(F.length("body") > limit, F.concat(F.substring("body", 1, limit), F.lit(CUT_MARK))).otherwise(F.col("body"))
    rows = split.select("repo", "rel_path", F.explode(each).alias("s")).select("repo", "rel_path", "s.*").filter(F.col("body").rlike(r"\S"))
    return rows.select("repo", chunk_id(entity_id(module, F.col("name"))).alias("id"), cut.alias("content"), F.col("rel_path").alias("file_path"), "line_start", "line_end", F.col("name").alias("symbol_name"))


def gaps(spans: DataFrame) -> DataFrame:
    """spans(repo, rel_path, line_start, line_end) -> repo, rel_path, gaps, last: the ranges of lines before and between spans, in order, and the last line that one covers.

    A sweep: in the order of their starts, a span leaves a gap before it if it begins beyond all that the ones before it cover.
    """
    before = Window.partitionBy("repo", "rel_path").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.filter("line_start <= line_end and line_end >= 1").select("repo", "rel_path", "line_start", "line_end")
    swept = rows.withColumn("open", F.greatest(F.coalesce(F.max("line_end").over(before), F.lit(0)), F.lit(0)) + 1)
    gap = F.when(F.col("line_start") > F.col("open"), F.struct(F.col("open").cast("int").alias("from"), (F.col("line_start") - 1).cast("int").alias("to")))
    return swept.groupBy("repo", "rel_path").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("line_end").cast("int").alias("last"))


def residual_chunks(files: DataFrame, symbols: DataFrame, limit: int = RESIDUAL_CHARS) -> DataFrame:
    """One chunk a file of the lines that no symbol spans, in order, cut at `limit` characters.

    A file's text stays whole and is split once: each gap is a slice of its lines, so the work grows with lines and
    symbols, not with their product. An empty file has no chunk; spans that end before they begin cover nothing.
    """
    joined = files.select("repo", "rel_path", F.split("content", "\r?\n").alias("lines")).join(gaps(symbols), ["repo", "rel_path"], "left")
    tail = F.coalesce("last", F.lit(0)) + 1
    rest = F.slice("lines", tail, F.greatest(F.size("lines") - tail + 1, F.lit(0)))
    free = F.concat(F.flatten(F.transform(F.coalesce("gaps", F.array()), lambda g: F.slice("lines", g["from"], g["to"] - g["from"] + 1))), rest)
    rows = joined.select("repo", "rel_path", F.substring(F.array_join(free, "\n"), 1, limit).alias("content"))
    return rows.filter(F.regexp_replace("content", r"\s+", "") != "").select("repo", residual_chunk_id(module_id(F.col("rel_path"))).alias("id"), "content", F.col("rel_path").alias("file_path"))


def line_context(rows: DataFrame, hit: Column, before: int = 2, after: int = 2) -> DataFrame:
    """lines with `context`: the lines around each hit, joined."""
    window = Window.partitionBy("repo", "rel_path").orderBy("line_no").rowsBetween(-before, after)
    return rows.withColumn("context", F.array_join(F.collect_list("line").over(window), "\n")).filter(hit)


def hits_in_context(files: DataFrame, hit: Callable[[Column], Column], *carry: str, before: int = 2, after: int = 2) -> DataFrame:
    """repo, rel_path, the columns of `carry`, line_no, line, context of the lines for which hit(line) holds: line_context of lines(files), read inside each file, so that no line is shuffled."""
    def found(line: Column, at: Column) -> Column:
        first = F.greatest(at + 1 - before, F.lit(1))
        near = F.array_join(F.slice("lines", first, at + 2 + after - first), "\n")
        return F.when(hit(line), F.struct((at + 1).alias("line_no"), line.alias("line"), near.alias("context")))

    split = files.select("repo", "rel_path", *carry, F.split("content", "\r?\n").alias("lines"))
    each = F.explode(F.filter(F.transform("lines", found), lambda h: h.isNotNull())).alias("h")
    return split.select("repo", "rel_path", *carry, each).select("repo", "rel_path", *carry, "h.*")


def decorators_above(symbols: DataFrame, all_lines: DataFrame, reach: int = 8) -> DataFrame:
    """repo, rel_path, name, decorators: those that stand above a symbol, up to `reach` lines, until a line that is neither comment, blank nor decorator.

    Files in which any symbol has annotations are left alone. A symbol asks for its own few lines by number, so a file's
    symbols do not meet all of its lines.
    """
    most = F.max(F.size("annotations")).over(Window.partitionBy("repo", "rel_path"))
    asked = symbols.select("repo", "rel_path", "name", "line_start", most.alias("most")).filter("most <= 0 and line_start > 1")
    above = F.explode(F.sequence(F.greatest(F.col("line_start") - reach, F.lit(1)), F.col("line_start") - 1)).alias("line_no")
    near = asked.select("repo", "rel_path", "name", "line_start", above).join(all_lines, ["repo", "rel_path", "line_no"])
    decorator = F.regexp_extract(F.trim("line"), r"^@([\w.]+)", 1)
    stops = ~F.trim("line").rlike(r"^$|^@|^#|^//|^/?\*")
    up = Window.partitionBy("repo", "rel_path", "name", "line_start").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = near.withColumn("blocked", F.max(stops.cast("int")).over(up)).filter("blocked = 0").withColumn("decorator", decorator).filter("decorator != ''")
    return rows.groupBy("repo", "rel_path", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "decorator"))), lambda x: x["decorator"]).alias("decorators"))


def tokens_index(files: DataFrame, pattern: str = r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9_]{2,})(?![\p{L}\p{N}_])") -> DataFrame:
    """repo, token, rel_path: upper-case tokens and the files that hold them, in long form."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    return files.select("repo", F.explode(found).alias("token"), "rel_path")


#: Sources of exclude patterns, in the order in which one is named as the reason.
SOURCES = ("user", "detected", "builtin", "ignored")


def index_coverage(files: DataFrame, indexed: DataFrame, folders: DataFrame | None = None, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """Per top folder: files, indexed ones, percent, status and, with patterns, the reason.

    folders(repo, top) are those on disk, which may hold nothing to read; patterns are (source, pattern) pairs. A folder
    that a pattern excludes is `excluded`, whatever was indexed of it, and its reason is `source: pattern` of the first
    one that does, by SOURCES and then as listed; unknown sources come last. Files at the root are in no folder.
    """
    top = F.substring_index("rel_path", "/", 1).alias("top")
    inside = F.contains("rel_path", F.lit("/"))
    there = files.filter(inside).groupBy("repo", top).agg(F.count("*").alias("scannable"))
    done = indexed.filter(inside).select("repo", "rel_path").distinct().groupBy("repo", top).agg(F.count("*").alias("indexed"))
    rows = there.join(done, ["repo", "top"], "full")
    if folders is not None:
        rows = rows.join(folders.select("repo", "top").distinct(), ["repo", "top"], "full")
    rows = rows.select("repo", "top", F.coalesce("scannable", F.lit(0)).alias("scannable"), F.coalesce("indexed", F.lit(0)).alias("indexed"))
    percent = F.lit(100.0) * F.col("indexed") / F.greatest("scannable", F.lit(1))
    status = F.when(F.col("scannable") == 0, "skipped").when(F.col("indexed") == 0, "none").when(F.col("indexed") < F.col("scannable"), "partial").otherwise("full")
    if not patterns:
        return rows.select("*", percent.alias("percent"), status.alias("status"))
    place = {s: n for n, s in enumerate(SOURCES)}
    ordered = sorted(patterns, key=lambda p: place.get(p[0], len(SOURCES)))
    reason = F.coalesce(*[F.when(excluded(F.col("top"), [p]) | excluded(F.concat("top", F.lit("/")), [p]), F.lit(f"{source}: {p}")) for source, p in ordered])
    out = reason.isNotNull()
    return rows.select("*", F.when(~out, percent).alias("percent"), F.when(out, "excluded").otherwise(status).alias("status"), reason.alias("reason"))


def folder_signals(files: DataFrame, samples: int = 5) -> DataFrame:
    """Per top folder: number of files, extensions with counts, first sample paths, and whether a build file is there."""
    top = F.substring_index("rel_path", "/", 1)
    build = F.col("rel_path").rlike(r"(^|/)(package\.json|pyproject\.toml|go\.mod|pom\.xml|Cargo\.toml)$")
    rows = files.select("repo", top.alias("top"), "ext", "rel_path", build.alias("build"))
    first = Window.partitionBy("repo", "top").orderBy("rel_path")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= samples).groupBy("repo", "top").agg(F.array_sort(F.collect_list("rel_path")).alias("samples"))
    exts = rows.groupBy("repo", "top", "ext").agg(F.count("*").alias("n"), F.bool_or("build").alias("build"))
    per = exts.groupBy("repo", "top").agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(F.struct("ext", "n"))).alias("exts"), F.bool_or("build").alias("has_build"))
    return per.join(few, ["repo", "top"])


def structure_signature(files: DataFrame) -> DataFrame:
    """The sorted top folders as JSON; a change of it asks for a refresh."""
    return files.groupBy("repo").agg(F.to_json(F.array_sort(F.collect_set(F.substring_index("rel_path", "/", 1)))).alias("signature"))


def needs_refresh(files: DataFrame, known: DataFrame) -> DataFrame:
    """repo, signature, refresh: whether a repository's structure must be looked at again. known(repo, signature, done) is what the last look left; one that it lacks, that was not done or whose signature is another must."""
    last = known.groupBy("repo").agg(F.max_by("signature", "done").alias("was"), F.bool_or("done").alias("done"))
    rows = structure_signature(files).join(last, "repo", "left")
    same = F.coalesce("done", F.lit(False)) & F.col("was").eqNullSafe(F.col("signature"))
    return rows.select("repo", "signature", (~same).alias("refresh"))


def small_file_clusters(files: DataFrame, least: int = 4, below: int = 80) -> DataFrame:
    """Folders with at least `least` files of under `below` lines."""
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("folder")
    return files.filter(F.col("n_lines") < below).groupBy("repo", folder).agg(F.count("*").alias("small_files"), F.sum("n_lines").alias("small_lines")).filter(F.col("small_files") >= least)


#: Extensions of source files, and folders that, besides hidden ones, are no part of a project's structure. Fixed values.
STRUCTURE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "go", "java", "rs", "rb", "php")
STRUCTURE_SKIPS = (
    "venv", "node_modules", "__pycache__", "dist", "build", "htmlcov",
    "tests", "test", "__tests__", "fixtures", "examples", "docs",
)
#: Parts of names that speak of configuration, events and patterns, and of what only tests. Fixed values.
CONFIG_NAMES = (
    "config", "settings", "options", "env", "constants", "defaults",
    "schema", "flags", "preferences", "params",
)
EVENT_NAMES = (
    "event", "emitter", "listener", "subscriber", "publisher",
    "dispatch", "handler", "bus", "signal", "observable", "hook",
)
PATTERN_NAMES = (
    "factory", "strategy", "observer", "adapter", "decorator",
    "builder", "singleton", "mediator", "proxy", "facade",
    "visitor", "command", "state", "template",
)
TRIAL_NAMES = ("test", "spec", "mock", "fixture")
#: Folders named for a technical layer. Fixed values.
TECH_LAYERS = (
    "models", "views", "controllers", "services", "repositories",
    "handlers", "middleware", "routes", "resolvers", "schemas",
    "entities", "dtos", "mappers", "adapters", "validators",
)
#: Files, layers and folders from which on a signal is one; depth of a deep folder. Fixed values.
MANY = {"config": 5, "event": 4, "pattern": 3, "layers": 3, "deep": 1}
DEEP = 5


def naming_signals(files: DataFrame) -> DataFrame:
    """Per repo: files named for configuration, events or patterns, technical layers among folder names, deep folders, and whether each is many."""
    folders = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    skipped = F.exists(folders, lambda f: f.isin(*STRUCTURE_SKIPS) | f.startswith("."))
    rows = files.filter(~skipped).select("repo", folders.alias("folders"), "ext", F.replace(F.lower(F.regexp_replace(F.substring_index("rel_path", "/", -1), r"(?<=.)\.[^.]*$", "")), F.lit("-"), F.lit("_")).alias("stem"))

    def named(parts: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(F.col("stem"), x))

    source = (F.size("folders") > 0) & F.col("ext").isin(*STRUCTURE_EXTENSIONS) & ~named(TRIAL_NAMES)
    kinds = {"config": CONFIG_NAMES, "event": EVENT_NAMES, "pattern": PATTERN_NAMES}
    counted = rows.groupBy("repo").agg(*[F.count_if(source & named(v)).alias(k) for k, v in kinds.items()])
    # A folder is each head of a file's path.
    heads = F.transform(F.sequence(F.lit(1), F.size("folders")), lambda n: F.struct(n.alias("depth"), F.lower(F.element_at("folders", n)).alias("name"), F.array_join(F.slice("folders", 1, n), "/").alias("at")))
    every = rows.select("repo", F.explode(F.when(F.size("folders") > 0, heads)).alias("f")).select("repo", "f.*").distinct()
    placed = every.groupBy("repo").agg(F.countDistinct(F.when(F.col("name").isin(*TECH_LAYERS), F.col("name"))).alias("layers"), F.countDistinct(F.when(F.col("depth") >= DEEP, F.col("at"))).alias("deep"))
    counted = counted.join(placed, "repo", "left").fillna(0, ["layers", "deep"])
    return counted.select("repo", *MANY, *[(F.col(k) >= n).alias(f"many_{k}") for k, n in MANY.items()])


def language_set(files: DataFrame, depth: int = 5) -> DataFrame:
    shallow = files.filter((F.size(F.split("rel_path", "/")) <= depth) & F.col("language").isNotNull())
    return shallow.groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("languages"))


#: Test frameworks. Files of these names, in the root or a folder of it, show one; so do texts in files of the root, and folders
#: of it. Then these patterns are tests. Fixed values.
SCRIPT_TESTS = (
    "**/__tests__/**", "**/*.test.ts", "**/*.test.tsx", "**/*.test.js",
    "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx",
)
FRAMEWORK_FILES = {
    "pytest": ("conftest.py", "pytest.ini"),
    "jest": ("jest.config.js", "jest.config.ts", "jest.config.mjs", "jest.config.cjs", "jest.config.json"),
    "vitest": ("vitest.config.js", "vitest.config.ts", "vitest.config.mjs", "vitest.config.cjs"),
    "cypress": ("cypress.config.js", "cypress.config.ts", "cypress.config.mjs", "cypress.config.cjs"),
    "playwright": ("playwright.config.js", "playwright.config.ts", "playwright.config.mjs", "playwright.config.cjs"),
}
FRAMEWORK_TEXTS = {
    "pytest": (("pyproject.toml", "[tool.pytest"), ("setup.cfg", "[tool:pytest")),
    "jest": (("package.json", '"jest"'),),
    "vitest": (("package.json", '"vitest"'),),
}
FRAMEWORK_PATTERNS = {
    "pytest": ("**/test_*.py", "**/*_test.py", "**/conftest.py", "**/tests/**"),
    "jest": SCRIPT_TESTS,
    "vitest": SCRIPT_TESTS,
    "cypress": ("**/cypress/**", "**/*.cy.ts", "**/*.cy.js"),
    "playwright": ("**/*.spec.ts", "**/*.spec.js", "**/e2e/**"),
    "go test": ("**/*_test.go",),
    "java/maven": ("**/src/test/**",),
    "rust": ("**/tests/**",),
}
#: Folders of the root that hold tests by convention. Fixed values.
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "e2e", "cypress")


def test_frameworks(files: DataFrame) -> DataFrame:
    """repo, frameworks, patterns: the test frameworks that a repository's files show, and what to exclude for them and for folders that hold tests by convention, which count as `folders` where they add a pattern."""
    path, text = F.col("rel_path"), F.col("content")
    name, depth = F.substring_index(path, "/", -1), F.size(F.split(path, "/")) - 1
    near = depth <= 1
    within = lambda folder: path.startswith(f"{folder}/")
    shown = {k: near & name.isin(*v) for k, v in FRAMEWORK_FILES.items()}
    for k, pairs in FRAMEWORK_TEXTS.items():
        for file, needle in pairs:
            shown[k] = shown[k] | ((path == file) & F.contains(text, F.lit(needle)))
    shown["cypress"] = shown["cypress"] | within("cypress")
    shown["java/maven"] = within("src/test")
    marks = {"go module": near & (name == "go.mod"), "go file": name.endswith("_test.go"), "cargo": near & (name == "Cargo.toml"), **{f"in {f}": within(f) for f in TEST_FOLDERS}}
    per = files.groupBy("repo").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in (shown | marks).items()])
    known = {k: F.col(f"`{k}`") for k in shown} | {"go test": F.col("`go module`") & F.col("`go file`"), "rust": F.col("cargo") & F.col("`in tests`")}
    several = lambda items: F.array_compact(F.array(*items))
    patterns = F.array_distinct(several([F.when(c, F.lit(p)) for k, c in known.items() for p in FRAMEWORK_PATTERNS[k]]))
    rows = per.withColumn("patterns", patterns)
    folders = several([F.when(F.col(f"`in {f}`") & ~F.array_contains("patterns", f"**/{f}/**"), F.lit(f"**/{f}/**")) for f in TEST_FOLDERS])
    rows = rows.withColumn("folders", folders)
    frameworks = several([*[F.when(c, F.lit(k)) for k, c in known.items()], F.when(F.size("folders") > 0, F.lit("folders"))])
    return rows.select("repo", F.array_sort(frameworks).alias("frameworks"), F.array_sort(F.concat("patterns", "folders")).alias("patterns"))
