"""Identities as column expressions: modules, entities, chunks, repositories and import targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_id(path: Column) -> Column:
    """a/b/__init__.py -> a.b: the path without suffix, with dots, without a last __init__."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.regexp_replace(F.replace(stem, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def entity_id(module: Column, symbol: Column) -> Column:
    return F.when(module == "", symbol).otherwise(F.concat_ws(".", module, symbol))


def chunk_id(entity: Column) -> Column:
    return F.concat(F.lit("chunk:"), entity)


def residual_chunk_id(module: Column) -> Column:
    return F.concat(F.lit("chunk:"), module, F.lit(".__file__"))


def top_module(entity: Column) -> Column:
    return F.substring_index(entity, ".", 1)


def parent_module(entity: Column) -> Column:
    """All but the last part; an id of one part has none."""
    return F.regexp_extract(entity, r"^(.*)\.[^.]*$", 1)


def short_name(entity: Column) -> Column:
    return F.substring_index(entity, ".", -1)


def repo_key(path: Column) -> Column:
    """Name and the first ten hex digits of the path's hash."""
    return F.concat(F.regexp_extract(path, "([^/]*)/*$", 1), F.lit("-"), F.substring(F.sha2(path, 256), 1, 10))


def description(kind: Column, name: Column, signature: Column, docstring: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.concat_ws(" | ", F.concat(kind, F.lit(": "), name), filled(signature), F.substring(filled(docstring), 1, 200))


def normalised(path: Column) -> Column:
    """A relative path's segments with . dropped and .. taken back, as an array. .. above the root stays."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.split(path, "/"), empty, step)


def import_target(file_path: Column, import_path: Column) -> Column:
    """Module that a relative import means: ./ and ../ paths, or leading dots. Others are themselves."""
    folder = F.regexp_replace(file_path, "[^/]*$", "")
    by_path = F.array_join(normalised(F.concat(folder, import_path)), ".")
    dots = F.regexp_extract(import_path, r"^(\.+)", 1)
    suffix = F.replace(F.substr(import_path, F.length(dots) + 1), F.lit("."), F.lit("/"))
    folders = F.filter(F.split(folder, "/"), lambda x: x != "")
    kept = F.slice(folders, 1, F.greatest(F.size(folders) - F.length(dots) + 1, F.lit(0)))
    by_dots = F.array_join(F.concat(kept, F.filter(F.split(suffix, "/"), lambda x: x != "")), ".")
    found = F.when(import_path.contains("/"), by_path).otherwise(by_dots)
    return F.when(~import_path.startswith("."), import_path).otherwise(F.when(found == "", ".").otherwise(found))


def runtime_module(path: Column, root: Column, skipped: tuple[str, ...] = ("node_modules", ".git", "dist", "build", "__pycache__")) -> Column:
    """Module of an absolute path under root: no suffix (.d.ts as one), no last index or __init__; null outside or in skipped folders."""
    inner = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))
    skip = F.arrays_overlap(F.split(inner, "/"), F.array(*[F.lit(s) for s in skipped]))
    known = inner.rlike(r"\.(d\.ts|ts|tsx|js|jsx|mjs|cjs|py)$")
    stem = F.regexp_replace(inner, r"(\.d\.ts|\.[^./]+)$", "")
    return F.when(~skip & known, F.replace(F.regexp_replace(stem, r"/(index|__init__)$", ""), F.lit("/"), F.lit(".")))
