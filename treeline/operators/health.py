"""Code health: seven graph metrics, debt density, and their weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.ids import short_name, top_module
from treeline.functions.scores import LADDERS, WEIGHTS, grade, ratio, step_score
from treeline.functions.text import is_test_by_folder
from treeline.operators.common import cut
from treeline.operators.graph import strong_components

#: Names that are called everywhere and say nothing of coupling. Fixed values.
BUILTINS = (
    "len", "str", "int", "float", "bool", "bytes", "list", "dict", "set",
    "tuple", "range", "enumerate", "sorted", "reversed", "zip", "map",
    "filter", "max", "min", "sum", "any", "all", "abs", "round", "pow",
    "print", "repr", "format", "type", "isinstance", "issubclass",
    "hasattr", "getattr", "setattr", "delattr", "callable", "super",
    "open", "iter", "next", "id", "hash", "chr", "ord", "hex", "oct",
    "bin", "vars", "dir", "staticmethod", "classmethod", "property",
)
#: Kinds without logic of their own. Fixed values.
STRUCTURAL = ("type_alias", "interface", "property", "enum", "enum_member", "field", "namespace", "constructor")

#: The default of what counts as debt.
DEBT_MARKERS = r"\b(?:TODO|HACK|FIXME)\b"


def module_coupling(edges: DataFrame) -> DataFrame:
    """mc: share of calls that cross modules."""
    crosses = top_module(F.col("src_id")) != top_module(F.col("tgt_id"))
    found = edges.filter("kind = 'calls'").groupBy("repo").agg(F.count_if(crosses).alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", ratio(F.col("part"), F.col("whole")).alias("value"))


def import_cycles(edges: DataFrame) -> DataFrame:
    """repo, node, component: module cycles of the import graph."""
    modules = edges.filter("kind = 'imports'").select("repo", top_module(F.col("src_id")).alias("src"), top_module(F.col("tgt_id")).alias("tgt"))
    return strong_components(modules.filter("src != '' and tgt != ''"))


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """cd: number of cycles; whole counts the modules in them."""
    found = import_cycles(edges).groupBy("repo").agg(F.countDistinct("component").alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", F.col("part").cast("double").alias("value"))


def fan_in(edges: DataFrame) -> DataFrame:
    """repo, id, n: calls into each target, builtins left out."""
    return edges.filter("kind = 'calls'").filter(~short_name(F.col("tgt_id")).isin(*BUILTINS)).groupBy("repo", F.col("tgt_id").alias("id")).agg(F.count("*").alias("n"))


def fan_in_concentration(edges: DataFrame, over: int = 5) -> DataFrame:
    """fi: share of called targets with over five callers."""
    found = fan_in(edges).groupBy("repo").agg(F.count_if(F.col("n") > over).alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", ratio(F.col("part"), F.col("whole")).alias("value"))


def is_entry_point(path: Column, entity: Column, kind: Column, decorators: Column) -> Column:
    """What may be without callers: dunders, tests, classes, structure, decorated or public code, scripts, variables."""
    name = short_name(entity)
    public = ~name.startswith("_")
    return (
        (name.startswith("__") & name.endswith("__")) | is_test_by_folder(path) | (kind == "class") | kind.isin(*STRUCTURAL) | (F.size(decorators) > 0)
        | (kind.isin("method", "function") & public) | path.startswith("scripts/") | path.contains("/scripts/") | path.endswith("__main__.py")
        | ((kind == "function") & name.rlike("[fF]orTest")) | (kind == "variable")
    )


def dead_code(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """dc: share of entities that need a caller and have none."""
    need = entities.filter((F.col("kind") != "module") & ~is_entry_point(F.col("file_path"), F.col("id"), F.col("kind"), F.col("decorators"))).select("repo", "id")
    called = edges.select("repo", F.col("tgt_id").alias("id")).distinct().withColumn("called", F.lit(True))
    found = need.join(called, ["repo", "id"], "left").groupBy("repo").agg(F.count_if(F.col("called").isNull()).alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", ratio(F.col("part"), F.col("whole")).alias("value"))


def oversized_functions(entities: DataFrame, over: int = 50) -> DataFrame:
    """fs: share of functions and methods that span over fifty lines."""
    found = entities.filter(F.col("kind").isin("function", "method")).groupBy("repo").agg(F.count_if(F.col("line_end") - F.col("line_start") > over).alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", ratio(F.col("part"), F.col("whole")).alias("value"))


def file_debt(files: DataFrame, markers: str = DEBT_MARKERS) -> DataFrame:
    """repo, rel_path, todos, any_count, n_lines; test files count lines alone."""
    test = is_test_by_folder(F.col("rel_path"))
    todos = F.when(test, 0).otherwise(F.regexp_count("content", F.lit(markers)))
    anys = F.when(~test & F.col("rel_path").rlike(r"\.tsx?$"), F.regexp_count("content", F.lit(r":\s*any\b"))).otherwise(0)
    return files.select("repo", "rel_path", todos.cast("long").alias("todos"), anys.cast("long").alias("any_count"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


def debt_density(files: DataFrame, markers: str = DEBT_MARKERS) -> DataFrame:
    """td: markers for each thousand lines."""
    found = file_debt(files, markers).groupBy("repo").agg(F.sum(F.col("todos") + F.col("any_count")).alias("part"), F.sum("n_lines").alias("whole"))
    return found.select("repo", "part", "whole", (F.col("part") / (F.greatest(F.col("whole"), F.lit(1)) / F.lit(1000.0))).alias("value"))


def fragmentation(entities: DataFrame, tiny: int = 3, deep: int = 5) -> DataFrame:
    """mf: 0.7 of the share of files with few entities and 0.3 of that of deep paths."""
    logic = ~F.col("kind").isin("module", "variable", *STRUCTURAL)
    per_file = entities.filter((F.col("file_path") != "") & ((F.col("kind") == "module") | logic)).groupBy("repo", "file_path").agg(F.count_if(logic).alias("n"))
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/")))
    found = per_file.groupBy("repo").agg(F.count_if(F.col("n") < tiny).alias("part"), F.count_if(depth >= deep).alias("deep_files"), F.count("*").alias("whole"), F.max(depth).alias("max_depth"))
    value = ratio(F.col("part"), F.col("whole")) * 0.7 + ratio(F.col("deep_files"), F.col("whole")) * 0.3
    return found.select("repo", "part", "whole", value.alias("value"), "deep_files", "max_depth")


def barrel_modules(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """re: share of files that import and hold no function, method or class."""
    logic = F.bool_or(F.col("kind").isin("function", "method", "class"))
    kinds = entities.filter((F.col("file_path") != "") & F.col("kind").isin("function", "method", "class", "module")).groupBy("repo", "file_path").agg(logic.alias("logic"))
    sources = edges.filter("kind = 'imports'").select("repo", F.col("src_id").alias("id")).distinct()
    importing = entities.select("repo", "id", "file_path").join(sources, ["repo", "id"], "left_semi").select("repo", "file_path").distinct().withColumn("imports", F.lit(True))
    found = kinds.join(importing, ["repo", "file_path"], "left").groupBy("repo").agg(F.count_if(~F.col("logic") & F.col("imports")).alias("part"), F.count("*").alias("whole"))
    return found.select("repo", "part", "whole", ratio(F.col("part"), F.col("whole")).alias("value"))


def metric(dimension: str, entities: DataFrame, edges: DataFrame, files: DataFrame | None = None, markers: str = DEBT_MARKERS) -> DataFrame:
    """One dimension as repo, part, whole, value. edges are collapsed ones."""
    made = {
        "mc": lambda: module_coupling(edges), "cd": lambda: circular_dependencies(edges), "fi": lambda: fan_in_concentration(edges), "dc": lambda: dead_code(entities, edges),
        "fs": lambda: oversized_functions(entities), "mf": lambda: fragmentation(entities), "re": lambda: barrel_modules(entities, edges), "td": lambda: debt_density(files, markers),
    }
    return made[dimension]()


def metrics(entities: DataFrame, edges: DataFrame, files: DataFrame | None = None, markers: str = DEBT_MARKERS) -> dict[str, DataFrame]:
    """Each dimension as repo, part, whole, value. edges are collapsed ones; they are worked out once for all dimensions."""
    edges = cut(edges.select("repo", "src_id", "tgt_id", "kind"))
    return {d: metric(d, entities, edges, files, markers) for d in LADDERS if d != "td" or files is not None}


def dimensions(parts: dict[str, DataFrame], repos: DataFrame) -> DataFrame:
    """repo, dimension, value, score, weight: a dimension without a row has value 0."""
    def one(d: str) -> DataFrame:
        row = repos.join(parts[d].select("repo", "value"), "repo", "left") if d in parts else repos.withColumn("value", F.lit(0.0))
        value = F.coalesce("value", F.lit(0.0)).cast("double")
        return row.select("repo", F.lit(d).alias("dimension"), value.alias("value"), step_score(d, value).alias("score"), F.lit(WEIGHTS[d]).alias("weight"))

    return reduce(DataFrame.unionByName, [one(d) for d in LADDERS])


def health(entities: DataFrame, edges: DataFrame, files: DataFrame | None = None, markers: str = DEBT_MARKERS) -> DataFrame:
    """repo, score, grade, reliable."""
    repos = entities.select("repo").distinct()
    scored = dimensions(metrics(entities, edges, files, markers), repos).groupBy("repo").agg(F.sum(F.col("score") * F.col("weight")).alias("total"))
    return scored.select("repo", (F.col("total") / 10).alias("score"), grade(F.col("total")).alias("grade"), F.lit(True).alias("reliable"))


#: Design principles: layer, code, name. Fixed values.
PRINCIPLES = (
    ("A", "A1", "Unnecessary layers"),
    ("A", "A2", "Over-modularization"),
    ("A", "A3", "Premature generalization"),
    ("A", "A4", "Over-decoupling"),
    ("A", "A5", "Config complexity"),
    ("A", "A6", "Event system overkill"),
    ("A", "A7", "Over-patterning"),
    ("M", "M1", "Feature bloat"),
    ("M", "M2", "Unclear boundaries"),
    ("M", "M3", "Duplication"),
    ("M", "M4", "Excessive dependencies"),
    ("C", "C1", "Indirection / barrel exports"),
    ("C", "C2", "Over-fragmentation"),
    ("C", "C3", "Deep directory nesting"),
    ("C", "C4", "Dead code"),
    ("C", "C5", "Split by tech layer"),
    ("C", "C6", "Unnecessary abstraction"),
    ("C", "C7", "Circular dependencies"),
    ("C", "C8", "Low cohesion"),
)
#: Dimensions, in this order, with the score below which they call for principles. Fixed values.
SIGNALS = (
    ("dc", 10, ("C4",)),
    ("cd", 10, ("C7", "A1")),
    ("mc", 9, ("M4", "M2", "A4")),
    ("fi", 9, ("M1", "A1")),
    ("fs", 9, ("C8",)),
    ("td", 9, ("C6", "C1")),
    ("mf", 9, ("A2", "C2", "C3")),
    ("re", 9, ("C1", "C6", "A3")),
)


def principle_signals(scored: DataFrame) -> DataFrame:
    """scored(repo, dimension, score) -> repo, layer, code, name, priority, signal: every principle for every repository, of high priority with its reasons where a weak dimension calls for it, else normal."""
    spark = scored.sparkSession
    links = spark.createDataFrame([(d, below, code, n) for n, (d, below, codes) in enumerate(SIGNALS) for code in codes], "dimension string, below int, code string, n int")
    told = F.format_string("%s=%.1f < %d", F.upper("dimension"), F.col("score").cast("double"), F.col("below"))
    hits = scored.join(F.broadcast(links), "dimension").filter("score < below").groupBy("repo", "code").agg(F.array_sort(F.collect_list(F.struct("n", told.alias("told")))).alias("all"))
    hits = hits.select("repo", "code", F.array_join(F.transform("all", lambda x: x["told"]), "; ").alias("signal"))
    rows = scored.select("repo").distinct().select("repo", F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(c).alias("code"), F.lit(n).alias("name")) for x, c, n in PRINCIPLES])).alias("p")).select("repo", "p.*")
    return rows.join(hits, ["repo", "code"], "left").select("repo", "layer", "code", "name", F.when(F.col("signal").isNull(), "normal").otherwise("high").alias("priority"), "signal")
