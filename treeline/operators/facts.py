"""Facts of source files: symbols, calls, imports, inheritance, routes, router prefixes and HTTP clients.

One nested row a file, read in Arrow batches: Python with the standard parser, scripts, Java, Go and PHP by their scopes
(`braces`), and routes of scripts and Go by their calls with a string as first argument. What such a call means is
decided by the lists below. A file that does not parse gives a row with its error. Names are joined up afterwards, by equi-joins over all files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from treeline.operators.braces import GO, JAVA, PHP, SCRIPT, brace_facts
from treeline.operators.common import spread, stepped

FACTS = (
    "repo string, rel_path string, error string, "
    "symbols array<struct<name:string,kind:string,signature:string,docstring:string,line_start:int,line_end:int,annotations:array<string>>>, "
    "calls array<struct<caller:string,callee:string,call_type:string,line_number:int,arguments_count:int>>, "
    "imports array<struct<module:string,names:array<string>,aliases:array<string>,is_from:boolean,alias:string>>, "
    "inheritances array<struct<child:string,parent:string>>, "
    "routes array<struct<var:string,method:string,path:string,handler:string,line_start:int,line_end:int>>, "
    "prefixes array<struct<var:string,base:string,prefix:string,ord:int>>, "
    "clients array<struct<name:string>>"
)

#: Methods that register a route; `route`, `all` and `any` stand for several. Fixed values.
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
#: What scripts call the object that registers routes, in lower case. Fixed values.
ROUTERS = ("app", "router", "server", "fastify", "api", "r")
#: HTTP clients: a variable made by one of these calls routes and registers none. Fixed values.
CLIENTS = ("axios", "ky", "got", "superagent", "wretch", "ofetch", "$fetch", "request", "apisauce")
#: Python calls whose target is known at run time only. Fixed values.
DYNAMIC = ("getattr", "setattr", "eval", "exec", "__import__")


def call_type(func: ast.expr) -> str:
    """By the case of names: constructor, dynamic, function, static_method or method."""
    if isinstance(func, ast.Name):
        return "constructor" if func.id[:1].isupper() else "dynamic" if func.id in DYNAMIC else "function"
    if isinstance(func, ast.Attribute) and func.attr[:1].isupper():
        return "constructor"
    return "static_method" if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) and func.value.id[:1].isupper() else "method"


def plain_source(node: ast.expr) -> str | None:
    """What ast.unparse says of names, dotted names, texts, whole numbers and calls of these; None for all else."""
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Constant:
        return repr(node.value) if node.kind is None and (node.value is None or type(node.value) in (str, int, bool)) else None
    if type(node) is ast.Attribute:
        under = plain_source(node.value) if type(node.value) in (ast.Name, ast.Attribute) else None
        return None if under is None else f"{under}.{node.attr}"
    if type(node) is not ast.Call or type(node.func) not in (ast.Name, ast.Attribute):
        return None
    parts = [plain_source(a) for a in node.args]
    named = [(k.arg, plain_source(k.value)) for k in node.keywords]
    func = plain_source(node.func)
    if func is None or None in parts or any(a is None or v is None for a, v in named):
        return None
    return f"{func}({', '.join([*parts, *(f'{a}={v}' for a, v in named)])})"


def source_of(node: ast.expr) -> str:
    """ast.unparse, without its cost for what is written plainly."""
    plain = plain_source(node)
    return ast.unparse(node) if plain is None else plain


def arguments_of(args: ast.arguments) -> str:
    """ast.unparse of arguments, without its cost for those with plain annotations and defaults."""
    if args.posonlyargs or args.vararg or args.kwonlyargs or args.kwarg:
        return ast.unparse(args)
    parts, without = [], len(args.args) - len(args.defaults)
    for i, a in enumerate(args.args):
        kind = "" if a.annotation is None else plain_source(a.annotation)
        default = "" if i < without else plain_source(args.defaults[i - without])
        if kind is None or default is None:
            return ast.unparse(args)
        parts.append(a.arg + (f": {kind}" if a.annotation is not None else "") + (f"={default}" if i >= without else ""))
    return ", ".join(parts)


def docstring_of(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    first = node.body[0] if node.body else None
    return ast.get_docstring(node) or "" if type(first) is ast.Expr and type(first.value) is ast.Constant else ""


#: Nodes under which nothing stands, and fields that hold only such nodes or none: not worth a visit. Fixed values.
LEAVES, BARE_FIELDS = (ast.Name, ast.Constant), ("ctx", "op", "ops", "names")
#: Nodes that are symbols. Fixed values.
SYMBOLS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


@cache
def inner_fields(kind: type) -> tuple[str, ...]:
    return tuple(f for f in kind._fields if f not in BARE_FIELDS)


def inner_nodes(node: ast.AST) -> list[ast.AST]:
    """ast.iter_child_nodes without leaves."""
    found = []
    for name in inner_fields(type(node)):
        value = getattr(node, name, None)
        if type(value) is list:
            found += [v for v in value if isinstance(v, ast.AST) and type(v) not in LEAVES]
        elif isinstance(value, ast.AST) and type(value) not in LEAVES:
            found.append(value)
    return found


def text_of(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def decorated_routes(node: ast.FunctionDef | ast.AsyncFunctionDef, name: str) -> Iterator[tuple]:
    """Routes of decorators like @router.get("/x") and @app.route(path="/x", methods=["POST"])."""
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name)):
            continue
        method, given = d.func.attr.lower(), {k.arg: k.value for k in d.keywords}
        path = text_of(d.args[0] if d.args else given.get("path"))
        if path is None or method not in (*METHODS, "route"):
            continue
        listed = [text_of(x) for x in getattr(given.get("methods"), "elts", [])]
        for m in [x.upper() for x in listed if x] or ["GET" if method == "route" else method.upper()]:
            yield d.func.value.id, m, path, name, d.lineno, d.end_lineno


def symbol_of(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, name: str, owner: str) -> tuple:
    is_class = isinstance(node, ast.ClassDef)
    kind = "class" if is_class else "method" if owner else "function"
    signature = "" if is_class else f"{node.name}({arguments_of(node.args)})"
    return name, kind, signature, docstring_of(node), node.lineno, node.end_lineno, [source_of(d) for d in node.decorator_list]


#: Fields of statements in which statements stand, or clauses that hold statements. Fixed values.
BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


@cache
def inner_blocks(kind: type) -> tuple[str, ...]:
    return tuple(f for f in kind._fields if f in BLOCKS)


def python_symbols(content: str) -> dict:
    """The symbols of python_facts and nothing else, in the same order: no expression is visited, so none is too deep, and blocks may nest as deep as the parser takes them."""
    found, waiting = [], [(ast.parse(content), (), "")]
    while waiting:
        node, scope, owner = waiting.pop()
        if isinstance(node, SYMBOLS):
            scope = (*scope, node.name)
            name = ".".join(scope)
            found.append(symbol_of(node, name, owner))
            owner = name if isinstance(node, ast.ClassDef) else owner
        inner = [child for block in inner_blocks(type(node)) for child in getattr(node, block)]
        waiting += [(child, scope, owner) for child in reversed(inner) if inner_blocks(type(child))]
    return {"symbols": found}


def typed(node: ast.stmt) -> tuple[str, str] | None:
    """The variable of `x = Class(...)` or `x: Class = ...`, and its class."""
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
        name, kind = node.targets[0].id, node.value.func.id
    elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and isinstance(node.annotation, ast.Name):
        name, kind = node.target.id, node.annotation.id
    else:
        return None
    return (name, kind) if kind[:1].isupper() else None


def python_facts(content: str) -> dict:
    """Symbols with Class.method names; calls with self. led to the class, super(). to its first base, variables to the class that they are made of, constructors to __init__."""
    found: dict[str, list] = {n: [] for n in ("symbols", "calls", "imports", "inheritances", "routes", "prefixes")}

    def called(node: ast.Call, scope: tuple[str, ...], owner: str, base: str, types: dict[str, str]) -> None:
        kind, callee = call_type(node.func), source_of(node.func)
        head, _, rest = callee.partition(".")
        lead = {"self": owner, "super()": base or "super"}.get(head) or types.get(head)
        callee = f"{lead}.{rest}" if rest and lead else callee
        found["calls"].append((".".join(scope), f"{callee}.__init__" if kind == "constructor" else callee, kind, node.lineno, len(node.args) + len(node.keywords)))

    def walk(node: ast.AST, scope: tuple[str, ...], owner: str, base: str, types: dict[str, str]) -> None:
        for child in inner_nodes(node):
            if isinstance(child, SYMBOLS):
                name, is_class = ".".join((*scope, child.name)), isinstance(child, ast.ClassDef)
                found["symbols"].append(symbol_of(child, name, owner))
                if is_class:
                    bases = [source_of(b) for b in child.bases]
                    found["inheritances"] += [(name, b) for b in bases]
                    walk(child, (*scope, child.name), name, bases[0] if bases else "", types)
                else:
                    found["routes"] += decorated_routes(child, name)
                    walk(child, (*scope, child.name), owner, base, dict(filter(None, map(typed, child.body))))
                continue
            if isinstance(child, ast.Call):
                if type(child.func) in (ast.Name, ast.Attribute):
                    called(child, scope, owner, base, types)
            elif isinstance(child, ast.Import):
                found["imports"] += [(a.name, [], [], False, a.asname) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                found["imports"].append(("." * child.level + (child.module or ""), [a.name for a in child.names], [a.asname or a.name for a in child.names], True, None))
            elif isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and source_of(child.value.func).split(".")[-1] == "APIRouter":
                prefix = next((text_of(k.value) for k in child.value.keywords if k.arg == "prefix"), None)
                found["prefixes"] += [(t.id, "", prefix or "", child.lineno) for t in child.targets if isinstance(t, ast.Name)]
            walk(child, scope, owner, base, types)

    tree = ast.parse(content)
    walk(tree, (), "", "", dict(filter(None, map(typed, tree.body))))
    return found


#: A call with a string as first argument, bare or on an object, decorator or not; and what a variable is bound to.
TEXT_CALL = re.compile(r"(?P<at>@?)\b(?:(?P<var>[\w$]+)\s*\.\s*)?(?P<name>[\w$]+)\s*\(\s*(?:(?P<quote>[\"'`])(?P<text>[^\"'`\n]*)(?P=quote)?)?")
BOUND = re.compile(r"\b(?P<var>[\w$]+)\s*:?=\s*(?:await\s+)?(?P<head>[\w$]+)(?P<rest>(?:\s*\.\s*[\w$]+)*)\s*(?P<open>[(<])(?:\s*\"(?P<text>[^\"\n]*)\")?")


def line_numbers(content: str) -> Callable[[int], int]:
    ends = [m.start() for m in re.finditer("\n", content)]
    return lambda at: bisect_right(ends, at - 1) + 1 if ends else 1


def joined_path(*parts: str) -> str:
    return "/" + "/".join(s for p in parts for s in p.split("/") if s)


def script_facts(content: str) -> dict:
    """Routes and clients of TypeScript and JavaScript: router.get("/x"), and @Get("x") under @Controller("base")."""
    line, routes, base = line_numbers(content), [], ""
    calls = [m for m in TEXT_CALL.finditer(content)]
    for m in calls:
        if m["at"] and m["name"] == "Controller" and m["text"] is not None:
            base = m["text"]
            break
    for m in calls:
        name, text, span = m["name"].lower(), m["text"], (line(m.start()), line(m.end()))
        method = "*" if name == "all" else name.upper()
        if name not in (*METHODS, "all") or text is None:
            continue
        if m["at"] and not m["var"] and m["name"] == name.capitalize():
            routes.append(("", "ALL" if method == "*" else method, joined_path(base, text), "", *span))
        elif not m["at"] and (m["var"] or "").lower() in ROUTERS and text.startswith("/"):
            routes.append((m["var"], method, text, "", *span))
    clients = [(m["var"].lower(),) for m in BOUND.finditer(content) if m["head"].lower() in CLIENTS]
    return {"routes": routes, "clients": clients}


def go_facts(content: str) -> dict:
    """Routes of Go routers, which register in upper case, and their groups."""
    line, upper = line_numbers(content), {m.upper() for m in METHODS}
    calls = [m for m in TEXT_CALL.finditer(content) if m["var"] and m["quote"] == '"' and m["text"].startswith("/") and (m["name"] in upper or m["name"] == "Any")]
    routes = [(m["var"], "*" if m["name"] == "Any" else m["name"], m["text"], "", line(m.start()), line(m.end())) for m in calls]
    groups = [m for m in BOUND.finditer(content) if m["rest"].replace(" ", "") == ".Group" and m["text"] is not None]
    return {"routes": routes, "prefixes": [(m["var"], m["head"], m["text"], n) for n, m in enumerate(groups)]}


def whole_script(content: str) -> dict:
    return script_facts(content) | brace_facts(content, SCRIPT)


def whole_go(content: str) -> dict:
    return go_facts(content) | brace_facts(content, GO)


def java_facts(content: str) -> dict:
    return brace_facts(content, JAVA)


def php_facts(content: str) -> dict:
    return brace_facts(content, PHP)


#: Extractors by language; more can be registered.
EXTRACTORS: dict[str, Callable[[str], dict]] = {
    "python": python_facts, "typescript": whole_script, "tsx": whole_script, "javascript": whole_script,
    "go": whole_go, "java": java_facts, "php": php_facts,
}
#: For those who read the symbols of Python files and no other facts, at about half the cost.
SYMBOLS_ALONE: dict[str, Callable[[str], dict]] = {"python": python_symbols}


def extract(files: DataFrame, extractors: dict[str, Callable[[str], dict]] | None = None) -> DataFrame:
    """files(repo, rel_path, language, content) -> one row of FACTS a file that an extractor knows. Files are dealt over tasks first: parsing takes far longer than reading."""
    own = extractors or EXTRACTORS
    schema = StructType.fromDDL(FACTS)
    types = [to_arrow_type(f.dataType) for f in schema]

    def nested(kind: pa.DataType, lists: list[list[tuple]]) -> pa.Array:
        """Lists of tuples as lists of structures, field by field: no dictionary a fact."""
        parts = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
        columns = list(zip(*chain.from_iterable(lists), strict=True)) or [()] * len(parts)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, parts, strict=True)], fields=parts)
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, lists), initial=0), pa.int32()), values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches):
            rows = []
            for repo, path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    facts, error = own[language](content or ""), None
                except (SyntaxError, ValueError, RecursionError) as e:
                    facts, error = {}, str(e)[:200]
                rows.append((repo, path, error, facts))
            *told, found = zip(*rows, strict=True)
            lists = [nested(t, [own_facts.get(f.name, []) for own_facts in found]) for f, t in zip(schema[3:], types[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(told, types[:3], strict=True)), *lists], names=schema.names)

    return spread(files.filter(F.col("language").isin(*own)).select("repo", "rel_path", "language", "content"), "repo", "rel_path").mapInArrow(run, FACTS)


def fact_table(facts: DataFrame, name: str) -> DataFrame:
    """One of the nested columns as its own table."""
    return facts.select("repo", "rel_path", F.explode(name).alias("f")).select("repo", "rel_path", "f.*")


def script_imports(files: DataFrame) -> DataFrame:
    """repo, rel_path, short, target: what a short name of a script means: a module for default, namespace and whole-module names, else module.name.

    Statements are cut at `from` and `require`, and what stands before is read as a list of names in columns.
    """
    rows = files.filter(F.col("ext").isin("ts", "tsx", "js", "jsx", "mjs", "cjs"))
    quoted = r"\s*['\"]([^'\"]+)['\"]"
    shapes = (r"\bimport\s+([^;'\"]*?)\s*\bfrom" + quoted, r"\b(?:const|let|var)\s+([^;='\"]*?)\s*=\s*require\s*\(" + quoted)
    found = F.concat(*[F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("what"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("module")) for p in shapes])
    each = rows.select("repo", "rel_path", F.explode(found).alias("p")).select("repo", "rel_path", "p.module", F.regexp_replace("p.what", r"^type\s+", "").alias("what"))
    inner = F.regexp_extract("what", r"\{([^}]*)\}", 1)
    whole = F.regexp_replace("what", r"\{[^}]*\}", "")
    pair = lambda inside: lambda s: F.struct(F.lit(inside).alias("named"), F.regexp_replace(s, r"^\s+|\s+$", "").alias("as"))
    parts = F.concat(F.transform(F.split(inner, ","), pair(True)), F.transform(F.split(whole, ","), pair(False)))
    names = each.select("repo", "rel_path", "module", F.explode(parts).alias("n")).select("repo", "rel_path", "module", "n.named", F.col("n.as").alias("text")).filter("text != ''")
    short, name = F.regexp_extract("text", r"([\w$]+)\s*$", 1), F.regexp_extract("text", r"^(?:type\s+)?([\w$*]+)", 1)
    return names.select("repo", "rel_path", short.alias("short"), F.when(F.col("named"), F.concat_ws(".", "module", name)).otherwise(F.col("module")).alias("target")).distinct()


def script_callees(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls(repo, rel_path, callee) of scripts with callees led to what they import; this. and super. stay. names: script_imports."""
    known = names.groupBy("repo", "rel_path", "short").agg(F.max("target").alias("target"))
    inner = F.col("callee").rlike(r"^(this|super)\.")
    rows = calls.withColumn("short", F.when(~inner, F.substring_index("callee", ".", 1))).join(known, ["repo", "rel_path", "short"], "left")
    led = F.concat("target", F.substr("callee", F.length("short") + 1))
    return rows.withColumn("callee", F.coalesce(led, "callee")).drop("short", "target")


def script_symbols(files: DataFrame) -> DataFrame:
    """repo, rel_path, name, kind, line_start of declarations in languages without the standard parser."""
    from treeline.operators.corpus import lines

    rows = files.filter(F.col("language") != "python")
    shape = r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|async\s+)*(class|interface|enum|function|func|fn|namespace)\s+(?:\([^)]*\)\s*)?(\w+)"
    found = lines(rows).withColumn("name", F.regexp_extract("line", shape, 2)).filter("name != ''")
    return found.select("repo", "rel_path", "name", F.regexp_replace(F.regexp_extract("line", shape, 1), "^(func|fn)$", "function").alias("kind"), F.col("line_no").alias("line_start"))


def router_prefixes(facts: DataFrame) -> DataFrame:
    """repo, rel_path, var, prefix: of routers and groups; a group of a group has both prefixes, in the order of declaration."""
    listed = facts.filter(F.size("prefixes") > 0).select("repo", "rel_path", F.array_sort(F.transform("prefixes", lambda p: F.struct(p["ord"].alias("ord"), p["var"].alias("var"), p["base"].alias("base"), p["prefix"].alias("prefix")))).alias("prefixes"))

    def grown(known: Column, p: Column) -> Column:
        above = F.coalesce(F.try_element_at(known, p["base"]), F.lit(""))
        own = F.when(p["base"] == "", p["prefix"]).otherwise(slashed(F.concat(above, F.lit("/"), p["prefix"])))
        return F.map_concat(F.map_filter(known, lambda k, _: k != p["var"]), F.create_map(p["var"], own))

    chained = F.aggregate("prefixes", F.create_map().cast("map<string,string>"), grown)
    return listed.select("repo", "rel_path", F.explode(chained).alias("var", "prefix"))


def slashed(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/"))


def all_routes(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """repo, rel_path, var, method, path, handler, line_start, line_end: decorated, script, controller and Go routes of code that is no test, prefixes before them; variables bound to HTTP clients anywhere in the repository register none."""
    found = facts if facts is not None else extract(files)
    known = found.join(files.filter(F.col("kind").isin("code", "web") & ~F.col("is_test")).select("repo", "rel_path", "ext"), ["repo", "rel_path"])
    clients = fact_table(found, "clients").select("repo", "name").distinct()
    rows = known.select("repo", "rel_path", "ext", F.explode("routes").alias("r")).select("repo", "rel_path", "ext", "r.*")
    scripted = ~F.col("ext").isin("py", "go")
    rows = rows.withColumn("name", F.when(scripted & (F.col("var") != ""), F.lower("var"))).join(clients, ["repo", "name"], "left_anti").drop("name")
    rows = rows.join(router_prefixes(found), ["repo", "rel_path", "var"], "left")
    prefix = F.coalesce("prefix", F.lit(""))
    full = F.when(F.col("ext") == "go", slashed(F.concat(prefix, F.lit("/"), F.col("path")))).otherwise(F.concat(prefix, F.col("path")))
    return rows.select("repo", "rel_path", "var", "method", F.when(full == "", "/").otherwise(full).alias("path"), "handler", "line_start", "line_end")


def route_declarations(files: DataFrame) -> DataFrame:
    """repo, rel_path, var, method, path of all_routes."""
    return all_routes(files).select("repo", "rel_path", "var", "method", "path")
