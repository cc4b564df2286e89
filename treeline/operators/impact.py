"""What a diff reaches: overlapped symbols, callers by depth, and how risky that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.ids import module_id
from treeline.functions.text import is_test_by_shape
from treeline.operators.common import by_repo, cut
from treeline.operators.graph import khop

#: Fragments of paths whose change is core. Fixed values.
CORE = ("auth", "authentication", "security", "payment", "billing", "database", "db", "core", "config", "settings")

#: Lines of a span in one bucket of the overlap join.
BUCKET = 256


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """hunks(repo, commit, path, change_type, start, end), symbols(repo, path, name, line_start, line_end) -> repo, commit, path, name, change_type, lines_changed.

    Both have repo or neither does: files of one path in two repositories are two files.

    Modified files give the symbols whose span a range overlaps, with the summed overlaps; added files all their
    symbols; deleted ones a single row without a name. Ranges and spans meet on their file and on buckets of lines,
    so a file of very many symbols is not one group; a pair counts in the first bucket that it shares.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET)))
    by = by_repo(hunks, symbols)
    spans = symbols.select(*by, "path", "name", "line_start", "line_end", buckets("line_start", "line_end").alias("bucket"))
    ranges = hunks.filter((F.col("change_type") == "modified") & (F.col("start") <= F.col("end"))).select(*by, "commit", "path", "change_type", "start", "end", buckets("start", "end").alias("bucket"))
    met = ranges.join(spans, [*by, "path", "bucket"]).filter("line_start <= end and start <= line_end and bucket = floor(greatest(start, line_start) / 256)")
    overlap = F.least("end", "line_end") - F.greatest("start", "line_start") + 1
    modified = met.groupBy(*by, "commit", "path", "name", "change_type").agg(F.sum(overlap).alias("lines_changed"))
    whole = hunks.filter("change_type = 'added'").select(*by, "commit", "path", "change_type").distinct()
    added = whole.join(symbols, [*by, "path"]).select(*by, "commit", "path", "name", "change_type", (F.col("line_end") - F.col("line_start") + 1).alias("lines_changed"))
    deleted = hunks.filter("change_type = 'deleted'").select(*by, "commit", "path", F.lit("").alias("name"), "change_type", F.lit(0).alias("lines_changed")).distinct()
    cols = [*by, "commit", "path", "name", "change_type", F.col("lines_changed").cast("long").alias("lines_changed")]
    return modified.select(*cols).unionByName(added.select(*cols)).unionByName(deleted.select(*cols))


def callers(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """changed(repo, seed, id) -> repo, seed, id, depth of all that calls it: 1 direct, more indirect; `boundary` at the last depth."""
    calls = edges.filter("kind = 'calls'")
    reached = khop(calls, changed, depth, "callers").filter("depth > 0")
    return reached.withColumn("boundary", F.col("depth") == depth)


def lazy_importers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Direct importers of what changed."""
    return khop(edges.filter("kind = 'imports'"), changed, 1, "callers").filter("depth > 0")


def call_chains(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """repo, seed, id, depth, chain: for each caller the least of its shortest chains, written a -> b -> changed."""
    steps = edges.filter("kind = 'calls'").select("repo", F.col("tgt_id").alias("id"), F.col("src_id").alias("next")).distinct()
    steps = cut(steps)
    front = cut(changed.select("repo", "seed", "id", F.col("id").alias("chain")).distinct())
    known, found = front.select("repo", "seed", "id"), None
    for hop in range(1, depth + 1):
        new = front.join(steps, ["repo", "id"]).groupBy("repo", "seed", F.col("next").alias("to")).agg(F.min(F.concat_ws(" -> ", "next", "chain")).alias("chain"))
        front = cut(new.withColumnRenamed("to", "id").join(known, ["repo", "seed", "id"], "left_anti"))
        here = front.withColumn("depth", F.lit(hop))
        found = here if found is None else found.unionByName(here)
        known = known.unionByName(front.select("repo", "seed", "id"))
    return found


def is_core(path: Column) -> Column:
    return F.exists(F.array(*[F.lit(c) for c in CORE]), lambda c: F.contains(F.lower(path), c))


def risk(changed: DataFrame, reached: DataFrame, low: int = 3, high: int = 10, wide: int = 5, heavy: int = 20) -> DataFrame:
    """changed(repo, commit, path, name, lines_changed), reached(repo, commit, id, path) -> one row a commit of a repository: level, reasons, modules, all tests in order. Both have repo or neither does."""
    by = [*by_repo(changed, reached), "commit"]
    test = is_test_by_shape(F.col("path"))
    public = ~F.col("name").startswith("_") & ~test
    per = changed.groupBy(*by).agg(
        F.bool_and(test).alias("test_only"), F.bool_or(is_core(F.col("path"))).alias("core"),
        F.count_if(public).alias("public"), F.bool_or(public & (F.col("lines_changed") > heavy)).alias("heavy"), F.collect_set(module_id(F.col("path"))).alias("own"),
    )
    met = reached.groupBy(*by).agg(F.countDistinct("id").alias("callers"), F.collect_set(module_id(F.col("path"))).alias("theirs"), F.array_sort(F.collect_set(F.when(test, F.col("path")))).alias("tests"))
    rows = per.join(met, by, "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    rows = rows.withColumn("modules", F.array_sort(F.array_union("own", F.coalesce("theirs", F.array().cast("array<string>")))))
    n = F.size("modules")
    base = F.when(F.col("core") | (F.col("callers") >= high) | (n >= wide), "high").when(F.col("callers") >= low, "medium").otherwise("low")
    rows = rows.withColumn("base", base)
    lifted = F.when(F.col("test_only"), "low").when((F.col("base") == "low") & F.col("heavy"), "medium").otherwise(F.col("base"))
    reasons = F.array_compact(F.array(
        F.when(F.col("test_only"), "only tests change"), F.when(~F.col("test_only") & F.col("core"), "core module"),
        F.when(~F.col("test_only") & (F.col("callers") >= low), F.concat(F.col("callers").cast("string"), F.lit(" callers"))),
        F.when(~F.col("test_only") & (n >= wide), F.concat(n.cast("string"), F.lit(" modules"))), F.when(~F.col("test_only") & F.col("heavy"), "large public change"),
    ))
    return rows.select(*by, lifted.alias("level"), "callers", n.alias("n_modules"), F.array_join(reasons, "; ").alias("reasons"), F.coalesce("tests", F.array().cast("array<string>")).alias("affected_tests"))
