"""From facts to relations: imported names, callers, callees and the four kinds of edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.ids import entity_id, import_target, module_id, top_module

#: What stands behind a class where it is made.
CONSTRUCTORS = (".__init__", ".<init>", "::__construct")


def local_packages(files: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """repo, top: top modules of the files and of the entities known before."""
    own = files.select("repo", top_module(module_id(F.col("rel_path"))).alias("top"))
    return (own if entities is None else own.unionByName(entities.select("repo", top_module(F.col("id")).alias("top")))).distinct()


def imported_names(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """repo, rel_path, name, target, external: what each imported short name means in its file.

    A name is external if its import is not relative and its top package is not local. aliases, where there are any,
    are the short names of names, in their order.
    """
    target = import_target(F.col("rel_path"), F.col("module"))
    short = F.col("aliases") if "aliases" in imports.columns else F.col("names")
    pairs = F.when(F.size("names") > 0, F.arrays_zip(short.alias("name"), F.col("names").alias("real"))).otherwise(F.array(F.struct(F.coalesce("alias", "module").alias("name"), F.coalesce("alias", "module").alias("real"))))
    rows = imports.select("repo", "rel_path", "module", "is_from", target.alias("base"), F.explode(pairs).alias("p")).select("repo", "rel_path", "module", "is_from", "base", "p.name", "p.real")
    rows = rows.withColumn("top", top_module(F.col("module"))).join(packages.withColumn("local", F.lit(True)), ["repo", "top"], "left")
    external = ~F.col("module").startswith(".") & F.col("local").isNull()
    return rows.select("repo", "rel_path", "name", F.when(F.col("is_from"), F.concat_ws(".", "base", "real")).otherwise(F.col("base")).alias("target"), external.alias("external"))


def resolve_callees(calls: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """calls with callee_id, null where the callee is external or unknown.

    In order: a name of the file itself, an external name, an imported name, a relative path, an imported prefix.
    Three equi-joins and one ordered choice. A class of the file stands for its constructor.
    """
    own = symbols.select("repo", "rel_path", F.col("name").alias("callee"))
    if "kind" in symbols.columns:
        made = F.explode(F.transform(F.array(*[F.lit(m) for m in CONSTRUCTORS]), lambda m: F.concat("name", m))).alias("callee")
        own = own.unionByName(symbols.filter(F.col("kind").isin("class", "record", "enum")).select("repo", "rel_path", made))
    locals_ = own.withColumn("is_local", F.lit(True)).distinct()
    known = names.groupBy("repo", "rel_path", "name").agg(F.bool_or("external").alias("external"), F.max("target").alias("target"))
    full = known.withColumnsRenamed({"name": "callee", "external": "full_external", "target": "full_target"})
    part = known.withColumnsRenamed({"name": "prefix", "external": "part_external", "target": "part_target"})
    rows = calls.withColumn("prefix", F.substring_index("callee", ".", 1)).join(locals_, ["repo", "rel_path", "callee"], "left").join(full, ["repo", "rel_path", "callee"], "left").join(part, ["repo", "rel_path", "prefix"], "left")
    module, callee = module_id(F.col("rel_path")), F.col("callee")
    none = F.lit(None).cast("string")
    found = (
        F.when(F.col("is_local"), entity_id(module, callee))
        .when(F.col("full_external"), none)
        .when(F.col("full_target").isNotNull(), F.col("full_target"))
        .when(callee.rlike(r"^\.\.?/"), import_target(F.col("rel_path"), callee))
        .when(callee.contains(".") & F.col("part_external"), none)
        .when(callee.contains(".") & F.col("part_target").isNotNull(), F.concat(F.col("part_target"), F.lit("."), F.substr(callee, F.length("prefix") + 2)))
    )
    return rows.withColumn("callee_id", found).drop("is_local", "full_external", "full_target", "part_external", "part_target", "prefix")


def resolve_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with caller_id: the module for none, the entity for a name of the file, else as it stands."""
    locals_ = symbols.select("repo", "rel_path", F.col("name").alias("caller"), F.lit(True).alias("own")).distinct()
    module = module_id(F.col("rel_path"))
    rows = calls.join(locals_, ["repo", "rel_path", "caller"], "left")
    caller = F.when(F.coalesce("caller", F.lit("")) == "", module).when(F.col("own"), entity_id(module, F.col("caller"))).otherwise(F.col("caller"))
    return rows.withColumn("caller_id", caller).drop("own")


def relations(calls: DataFrame, inheritances: DataFrame, imports: DataFrame, routes: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """repo, src_id, tgt_id, kind, weight, file_path, origin, seq from all facts; imports weigh 0.5, all else 1."""
    names = imported_names(imports, packages)
    module = module_id(F.col("rel_path"))
    found = resolve_callers(resolve_callees(calls, symbols, names), symbols).filter(F.col("callee_id").isNotNull())
    called = found.select("repo", F.col("caller_id").alias("src_id"), F.col("callee_id").alias("tgt_id"), F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"), "rel_path")
    parents = resolve_callees(inheritances.withColumnRenamed("parent", "callee"), symbols, names).filter(F.col("callee_id").isNotNull())
    inherits = parents.select("repo", entity_id(module, F.col("child")).alias("src_id"), F.col("callee_id").alias("tgt_id"), F.lit("inherits").alias("kind"), F.lit(1.0).alias("weight"), "rel_path")
    imported = imports.join(packages.withColumn("local", F.lit(True)), [imports["repo"] == packages["repo"], top_module(imports["module"]) == packages["top"]], "left").filter(F.col("local").isNotNull() | F.col("module").startswith("."))
    imported = imported.select(imports["repo"], module.alias("src_id"), import_target(F.col("rel_path"), F.col("module")).alias("tgt_id"), F.lit("imports").alias("kind"), F.lit(0.5).alias("weight"), "rel_path")
    handled = routes.select("repo", F.concat_ws(" ", "method", "path").alias("src_id"), entity_id(module, F.col("handler")).alias("tgt_id"), F.lit("handles").alias("kind"), F.lit(1.0).alias("weight"), "rel_path")
    every = called.unionByName(inherits).unionByName(imported).unionByName(handled)
    order = F.when(F.col("kind") == "calls", 1).when(F.col("kind") == "inherits", 2).when(F.col("kind") == "imports", 3).otherwise(4)
    return every.withColumnRenamed("rel_path", "file_path").withColumns({"origin": F.lit("static"), "seq": order.cast("long")})
