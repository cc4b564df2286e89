"""Coverage ranking, check inventories, tri-state matrices, script classes and simplification candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.ids import module_id
from treeline.functions.scores import coverage_band
from treeline.operators.common import by_repo, cut, listed
from treeline.operators.patterns import contained


def coverage_totals(coverage: DataFrame) -> DataFrame:
    rate = lambda a, b: F.lit(100.0) * F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    return coverage.groupBy("repo").agg(F.sum("lh").alias("lh"), F.sum("lf").alias("lf"), rate("lh", "lf").alias("line_rate"), F.count("*").alias("files"))


def coverage_denominator(coverage: DataFrame, files: DataFrame, least: float = 0.9) -> DataFrame:
    """Whether the report covers nearly all files on disk."""
    there = files.groupBy("repo").agg(F.countDistinct("rel_path").alias("on_disk"))
    told = coverage.groupBy("repo").agg(F.countDistinct("file").alias("in_report"))
    rows = there.join(told, "repo", "left").withColumn("in_report", F.coalesce("in_report", F.lit(0)))
    share = F.col("in_report") / F.greatest("on_disk", F.lit(1))
    return rows.select("repo", "on_disk", "in_report", share.alias("share"), (share >= least).alias("complete"))


def coverage_proof(coverage: DataFrame, sources: DataFrame, reports: DataFrame, least: float = 0.9, named: int = 5) -> DataFrame:
    """Whether a repository's figures may be read: reports(repo, report, mtime), sources(repo, rel_path, mtime) -> repo, report, on_disk, in_report, share, newer, newest, state.

    The latest report of a repository counts, of equally late ones that of the least name. `no_sources` without a file
    on disk, `stale` if any source is newer than the report (`newest` names the latest of them), `empty` without a
    covered file, `subset` if under `least` of the sources are covered, else `proven`. Times that are unknown are not newer.
    """
    chosen = reports.groupBy("repo").agg(F.min(F.struct((-F.coalesce(F.unix_micros("mtime"), F.lit(-(2**62)))).alias("late"), "report", "mtime")).alias("r")).select("repo", "r.report", F.col("r.mtime").alias("read_at"))
    each = sources.groupBy("repo", "rel_path").agg(F.max("mtime").alias("mtime")).join(chosen.select("repo", "read_at"), "repo", "left_outer")
    late = each.withColumn("late", F.coalesce(F.col("mtime") > F.col("read_at"), F.lit(False)))
    there = late.groupBy("repo").agg(F.count("*").alias("on_disk"), F.count_if("late").alias("newer"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("mtime").desc(), "rel_path"))
    few = late.filter("late").withColumn("place", place).filter(F.col("place") <= named).groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rel_path"))), lambda x: x["rel_path"]).alias("newest"))
    told = coverage.groupBy("repo").agg(F.countDistinct("file").alias("in_report"))
    rows = chosen.join(there, "repo", "left").join(told, "repo", "left").join(few, "repo", "left").fillna(0, ["on_disk", "newer", "in_report"])
    share = F.col("in_report") / F.greatest("on_disk", F.lit(1))
    state = F.when(F.col("on_disk") == 0, "no_sources").when(F.col("newer") > 0, "stale").when(F.col("in_report") == 0, "empty").when(share < least, "subset").otherwise("proven")
    return rows.select("repo", "report", "on_disk", "in_report", share.alias("share"), "newer", F.coalesce("newest", F.array().cast("array<string>")).alias("newest"), state.alias("state"))


def coverage_rank(coverage: DataFrame, fan_in: DataFrame, weak: float = 80.0, considered: int = 60) -> DataFrame:
    """The `considered` worst files of each repository at or below `weak` percent, by fan-in and coverage bands; an unknown fan-in ranks last, none at all is dead."""
    by = by_repo(coverage, fan_in)
    own = by_repo(coverage)
    pct = F.lit(100.0) * F.col("lh") / F.greatest("lf", F.lit(1))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("pct", "file"))
    worst = coverage.filter("lf > 0").withColumn("pct", pct).filter(F.col("pct") <= weak).withColumn("place", place).filter(F.col("place") <= considered)
    rows = worst.join(fan_in.select(*by, "file", "n"), [*by, "file"], "left")
    band = F.when(F.col("n") >= 5, 3).when(F.col("n") >= 2, 2).when(F.col("n") >= 1, 1)
    rows = rows.select(*own, "file", "pct", "n", (F.col("lf") - F.col("lh")).alias("uncovered"), (band * coverage_band(F.col("pct"))).alias("weight"), (F.coalesce("n", F.lit(-1)) == 0).alias("dead"))
    rank = F.row_number().over(Window.partitionBy(*own, "dead").orderBy(F.col("weight").desc_nulls_last(), F.col("uncovered").desc(), "file"))
    return rows.withColumn("rank", rank)


def tri_state(configured: DataFrame, executed: DataFrame) -> DataFrame:
    """configured(repo, check), executed(repo, check) -> OK, CONFIGURED_NOT_RUN or MISSING. What runs without being configured is OK too."""
    c = configured.select("repo", "check").distinct().withColumn("c", F.lit(True))
    e = executed.select("repo", "check").distinct().withColumn("e", F.lit(True))
    state = F.when(F.col("e"), "OK").when(F.col("c"), "CONFIGURED_NOT_RUN").otherwise("MISSING")
    return c.join(e, ["repo", "check"], "full").select("repo", "check", state.alias("state"))


def manifest_closure(on_disk: DataFrame, registered: DataFrame) -> DataFrame:
    """path on disk but not registered: orphan; registered but not on disk: stale."""
    a, b = on_disk.select("path").distinct(), registered.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("state", F.lit("orphan")).unionByName(b.join(a, "path", "left_anti").withColumn("state", F.lit("stale")))


def test_corpus(files: DataFrame, milestone: str = "milestone") -> DataFrame:
    """Per folder and over all (folder null): test files, lines and the share named for a milestone."""
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    rows = files.withColumn("folder", folder)
    marked = F.count_if(F.col("rel_path").contains(milestone))
    return rows.rollup("folder").agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines"), (marked / F.count("*")).alias("milestone_share"))


#: Words after which a file is run, and steps whose second word is run. Fixed values.
RUN_BY = r"(?<!\S)(?:bash|sh|python3?|node|\$PY|\$\{PY\})\s+(?=(\S+))"
STEP = r"^(?:spawn|cov|step)\s+\S+\s+(\S+)"
#: The head of a phase of a runner; a set's size that is written down; a file below the root that is scanned; tests and their selection. Fixed values.
PHASE = r"^if selected ([a-z0-9-]+);"
WRITTEN_SIZE = r"len\([^)]*\)\s*!=\s*(\d+)"
SCANNED = r"(?:rg|grep)\b[^\n|]*?\$\{?ROOT\}?/((?U)[\w/.\-]+)"
TESTS = r"((?U)[\w/.$\-{}]*tests?/[\w/.\-]+\.py)"
SELECTED = r"-k\s+'([^']+)'"


def executions(runner_lines: DataFrame, checkers: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """checkers(name, and path where they are registered by it) -> these columns, runs, state: 0 never runs, over 1 is a duplicate.

    A line of a runner runs a checker if it is no comment and a word behind a program or a step ends with the name,
    quotes apart; being registered counts as one more. With repo in both tables, lines run the checkers of their own
    repository. Names are found in lines by one pass over all of them.
    """
    by, keys = by_repo(runner_lines, checkers), [c for c in ("repo", "path", "name") if c in checkers.columns]
    clean = F.regexp_replace(F.trim("line"), "[\"']", "")
    step = F.regexp_extract(clean, STEP, 1)
    # a step may name its program first, and then the word behind that counts already
    words = F.array_append(F.regexp_extract_all(clean, F.lit(RUN_BY), F.lit(1)), step)
    rows = runner_lines.filter(~F.trim("line").startswith("#")).select(*by, clean.alias("line"), words.alias("words"))
    met = contained(rows, "line", checkers.select(F.col("name").alias("pattern")))
    hits = met.filter(F.exists("words", lambda w: F.endswith(w, F.col("pattern")))).groupBy(*by, F.col("pattern").alias("name")).agg(F.count("*").alias("lines"))
    found = checkers.select(*keys).distinct().join(hits, [*by, "name"], "left")
    runs = F.coalesce("lines", F.lit(0).cast("long"))
    if registered is not None:
        on = [*by_repo(registered, checkers), "path"]
        found = found.join(registered.select(*on).distinct().withColumn("listed", F.lit(1)), on, "left")
        runs = runs + F.coalesce("listed", F.lit(0))
    state = F.when(runs == 0, "never").when(runs > 1, "duplicate").otherwise("once")
    return found.select(*keys, runs.alias("runs"), state.alias("state"))


def logical_lines(all_lines: DataFrame) -> DataFrame:
    """all_lines(repo, rel_path, line_no, line) of runners -> repo, rel_path, line_no, phase, line: lines within phases, with those that a backslash continues joined. A phase begins at its head and ends at `fi`; a line that is cut off by either is dropped."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    head = F.regexp_extract(text, PHASE, 1)
    rows = all_lines.select("repo", "rel_path", "line_no", text.alias("line"), F.when(head != "", head).when(text == "fi", "").alias("mark"))
    over = Window.partitionBy("repo", "rel_path").orderBy("line_no")
    rows = rows.withColumn("phase", F.last("mark", ignorenulls=True).over(over))
    goes_on = F.col("mark").isNull() & F.endswith("line", F.lit("\\"))
    rows = rows.withColumn("goes_on", goes_on).withColumn("n", F.sum(F.when(F.lag("goes_on", 1, False).over(over) & F.col("mark").isNull(), 0).otherwise(1)).over(over))
    some = rows.filter(F.col("mark").isNull() & (F.coalesce("phase", F.lit("")) != ""))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", r"\\$", "").alias("line"))))
    joined = some.groupBy("repo", "rel_path", "phase", "n").agg(F.min("line_no").alias("line_no"), F.max_by("goes_on", "line_no").alias("open"), F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("line"))
    return joined.filter("not open").select("repo", "rel_path", "line_no", "phase", "line")


def vacuous_checks(runner_lines: DataFrame, checker_lines: DataFrame, files: DataFrame) -> DataFrame:
    """repo, rel_path, line_no, kind, phase, targets, detail: candidates for checks that check nothing.

    pytest_selector: a phase of a runner that runs tests by a selection, which may be empty; detail is the selection.
    hardcoded_constant: a checker that compares a set's size with a number; detail is the line. vacuous_scan: a checker
    that searches a file below the root which is neither a file nor a folder of the repository; detail is the file.
    """
    none = F.lit(None).cast("string")
    no_targets = F.array().cast("array<string>")
    place = ("repo", "rel_path", "line_no")
    targets, selection = F.regexp_extract_all("line", F.lit(TESTS), F.lit(1)), F.regexp_extract("line", SELECTED, 1)
    ran = logical_lines(runner_lines).filter(F.contains("line", F.lit("pytest")) & (F.size(targets) > 0) & (selection != ""))
    ran = ran.select(*place, F.lit("pytest_selector").alias("kind"), "phase", F.transform(targets, lambda x: F.substring_index(x, "/", -1)).alias("targets"), selection.alias("detail"))
    sized = checker_lines.filter(F.col("line").rlike(WRITTEN_SIZE) & ~F.trim("line").startswith("#"))
    sized = sized.select(*place, F.lit("hardcoded_constant").alias("kind"), none.alias("phase"), no_targets.alias("targets"), F.substring(F.trim("line"), 1, 140).alias("detail"))
    parts = F.split("rel_path", "/")
    there = files.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("wanted")).distinct()
    scans = checker_lines.select(*place, F.explode(F.regexp_extract_all("line", F.lit(SCANNED), F.lit(1))).alias("detail")).withColumn("wanted", F.rtrim("detail", F.lit("/")))
    scans = scans.join(there, ["repo", "wanted"], "left_anti").select(*place, F.lit("vacuous_scan").alias("kind"), none.alias("phase"), no_targets.alias("targets"), "detail")
    return ran.unionByName(sized).unionByName(scans)


def blast_radius(files: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(repo, path) -> repo, path, rel_path: files whose text contains the path, or its base name where at most one file of the repository has that. Without repo in both there is one repository."""
    by = by_repo(files, targets)
    base = F.substring_index("path", "/", -1)
    counts = files.groupBy(*by, F.substring_index("rel_path", "/", -1).alias("base")).agg(F.count("*").alias("n"))
    wanted = targets.select(*by, "path").distinct().withColumn("base", base).join(counts, [*by, "base"], "left")
    keys = wanted.select(*by, "path", F.col("path").alias("pattern")).unionByName(wanted.filter("coalesce(n, 0) <= 1").select(*by, "path", F.col("base").alias("pattern")))
    keys = cut(keys.filter("pattern != ''").distinct())
    met = contained(files.select(*by, "rel_path", "content"), "content", keys.select("pattern"))
    return met.join(keys, [*by, "pattern"]).filter("rel_path != path").select(*by, "path", "rel_path").distinct()


def importer_map(imports: DataFrame, scripts: DataFrame) -> DataFrame:
    """repo, rel_path of scripts that another file imports: an import equals their module, or lies under it. Prefixes meet by equality."""
    parts = F.split("module", r"\.")
    heads = imports.select("repo", F.col("rel_path").alias("by"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("module"))
    own = scripts.select("repo", "rel_path", module_id(F.col("rel_path")).alias("module"))
    return heads.join(own, ["repo", "module"]).filter("by != rel_path").select("repo", "rel_path").distinct()


#: Words that a tool's name begins with, or ends with, before or after a - or _. Fixed values.
TOOL_BEGINS = ("deploy", "setup", "install", "migrate", "seed", "admin", "run", "start", "stop", "init", "bootstrap", "cleanup", "reset", "update", "helper")
TOOL_ENDS = ("deploy", "setup", "admin", "update", "helper")
#: Top folders of tools, and of sources. Fixed values.
TOOL_FOLDERS = ("scripts", "tools", "bin", "examples", "demo", "fixtures")
SOURCE_FOLDERS = (
    "src", "lib", "core", "app", "pkg", "internal", "extensions", "packages", "ui",
    "cmd", "api", "web", "server", "client", "service", "services", "modules", "skills",
)


def is_tool_name(path: Column) -> Column:
    """The file's name without its ending begins or ends with a tool's word."""
    stem = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1"))
    words = F.split(stem, "[-_]")
    begins = (F.size(words) > 1) & F.get(words, F.lit(0)).isin(*TOOL_BEGINS)
    ends = (F.size(words) > 1) & F.element_at(words, -1).isin(*TOOL_ENDS)
    return begins | ends


def classify_scripts(scripts: DataFrame, imported: DataFrame, importing: DataFrame) -> DataFrame:
    """scripts(repo, rel_path, n_symbols, has_main) -> repo, rel_path, class: source, tool or uncertain; the first rule that holds.

    Imported by others; imports the project; in a source folder; in a tool folder; a tool's name with a main and at
    most two public names; a tool's name without public names, Python apart. n_symbols counts public names but main.
    """
    rows = scripts.join(imported.select("repo", "rel_path").distinct().withColumn("used", F.lit(True)), ["repo", "rel_path"], "left").join(importing.select("repo", "rel_path").distinct().withColumn("uses", F.lit(True)), ["repo", "rel_path"], "left")
    top = F.when(F.contains(F.col("rel_path"), F.lit("/")), F.substring_index("rel_path", "/", 1)).otherwise("")
    tool = is_tool_name(F.col("rel_path"))
    found = (
        F.when(F.col("used"), "source").when(F.col("uses"), "source").when(top.isin(*SOURCE_FOLDERS), "source").when(top.isin(*TOOL_FOLDERS), "tool")
        .when(tool & F.col("has_main") & (F.col("n_symbols") <= 2), "tool").when(tool & (F.col("n_symbols") == 0) & ~F.col("rel_path").endswith(".py"), "tool").otherwise("uncertain")
    )
    return rows.select("repo", "rel_path", found.alias("class"))


def hub_modules(edges: DataFrame, importers: int = 4, imports: int = 5) -> DataFrame:
    """edges(repo, src, tgt, kind) of modules -> hubs with many importers from outside, and forwarders that import and never call."""
    links = edges.filter("kind = 'imports' and src != tgt")
    hubs = links.groupBy("repo", F.col("tgt").alias("module")).agg(F.countDistinct("src").alias("n")).filter(F.col("n") >= importers).withColumn("role", F.lit("hub"))
    out = edges.filter("src != tgt").groupBy("repo", F.col("src").alias("module")).agg(F.countDistinct(F.when(F.col("kind") == "imports", F.col("tgt"))).alias("n"), F.count_if(F.col("kind") == "calls").alias("calls"))
    forwarders = out.filter((F.col("n") >= imports) & (F.col("calls") == 0)).select("repo", "module", "n", F.lit("forwarder").alias("role"))
    return hubs.select("repo", "module", "n", "role").unionByName(forwarders)


def triage(candidates: DataFrame, confirm: tuple[str, ...], reject: tuple[str, ...]) -> DataFrame:
    """candidates(layer, code, source, text): more confirming than rejecting words keeps one, the first of each (layer, code, source)."""
    def hits(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w)))

    rows = candidates.withColumn("score", hits(confirm) - hits(reject)).filter("score > 0")
    first = F.row_number().over(Window.partitionBy("layer", "code", "source").orderBy(F.col("score").desc(), "text"))
    return rows.withColumn("nth", first).filter("nth = 1").drop("nth")


def assurance_matrix(rules: DataFrame, files: DataFrame) -> DataFrame:
    """rules(layer, cell, config_like, run_like), a list -> repo, layer, cell, state and the first file of evidence. Every repository has a row for each cell: as many as repositories times the list's cells."""
    r = listed(rules)
    configured = files.join(r, F.expr("rel_path rlike config_like")).groupBy("repo", "layer", "cell").agg(F.min("rel_path").alias("evidence"))
    executed = files.filter(F.col("kind").isin("config", "shell")).join(r, F.expr("content rlike run_like")).select("repo", "layer", "cell").distinct().withColumn("runs", F.lit(True))
    all_cells = files.select("repo").distinct().join(r.select("layer", "cell").distinct())
    rows = all_cells.join(configured, ["repo", "layer", "cell"], "left").join(executed, ["repo", "layer", "cell"], "left")
    state = F.when(F.col("runs"), "OK").when(F.col("evidence").isNotNull(), "CONFIGURED_NOT_RUN").otherwise("MISSING")
    return rows.select("repo", "layer", "cell", state.alias("state"), "evidence")
