"""Schemas of the base tables. Every read states one; none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMAS = {
    "files": "repo string, rel_path string, ext string, language string, kind string, is_test boolean, content string, sha256 string, n_lines int, bytes long",
    "lines": "repo string, rel_path string, line_no int, line string",
    "symbols": "repo string, rel_path string, name string, kind string, signature string, docstring string, line_start int, line_end int, annotations array<struct<name:string,arguments:map<string,string>>>",
    "calls": "repo string, rel_path string, caller string, callee string, line_number int, call_type string, arguments_count int",
    "imports": "repo string, rel_path string, module string, names array<string>, is_from boolean, alias string",
    "inheritances": "repo string, rel_path string, child string, parent string",
    "routes": "repo string, rel_path string, path string, method string, handler string",
    "entities": "repo string, id string, kind string, name string, description string, file_path string, line_start int, line_end int, decorators array<string>, seq long",
    "relations": "repo string, src_id string, tgt_id string, kind string, description string, file_path string, weight double, origin string, seq long",
    "chunks": "repo string, id string, content string, file_path string, line_start int, line_end int, symbol_name string",
    "vectors": "repo string, id string, owner string, vec array<float>, dim int",
    "file_hashes": "repo string, rel_path string, sha256 string",
    "reexports": "repo string, phantom_id string, real_id string",
    "hunks": "commit string, path string, change_type string, side string, start int, end int",
    "findings": "repo string, table string, id string, verdict string, summary string, where string, evidence map<string,array<string>>, exempt_reason string",
    "exemptions": "table string, entry string, reason string, ord int",
    "coverage": "repo string, file string, lh long, lf long, fnh long, fnf long",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def assert_schema(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns in their order and types; a missing column raises, others go."""
    wanted = struct(name)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in wanted])
