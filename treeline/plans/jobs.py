"""Whole jobs made of the operators: maintaining a graph, judging a change, auditing a set of files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.ids import description, entity_id, module_id
from treeline.functions.text import STATE_COLUMNS, distinctive_segment, is_test_by_tokens, path_segments
from treeline.operators import audit, corpus, evidence, facts, graph, impact, resolve, sync, vectors
from treeline.operators.common import cut


def build(files: DataFrame, known: DataFrame | None = None, routes: DataFrame | None = None) -> dict[str, DataFrame]:
    """entities, relations, chunks and file_hashes of files; known are entities that other files gave."""
    found = cut(facts.extract(files))
    symbols, calls, imports, inheritances = (facts.fact_table(found, n) for n in ("symbols", "calls", "imports", "inheritances"))
    module = module_id(F.col("rel_path"))
    none = F.array().cast("array<string>")
    modules = files.select("repo", module.alias("id"), F.lit("module").alias("kind"), module.alias("name"), F.concat(F.lit("module: "), module).alias("description"), F.col("rel_path").alias("file_path"), F.lit(1).alias("line_start"), F.col("n_lines").alias("line_end"), none.alias("decorators"))
    named = symbols.select("repo", entity_id(module, F.col("name")).alias("id"), "kind", "name", description(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring")).alias("description"), F.col("rel_path").alias("file_path"), "line_start", "line_end", F.col("annotations").alias("decorators"))
    entities = modules.unionByName(named).dropDuplicates(["repo", "id"])
    routes = routes if routes is not None else facts.all_routes(files, found).filter("handler != ''")
    relations = resolve.relations(calls, inheritances, imports, routes, symbols, resolve.local_packages(files, known))
    chunks = corpus.symbol_chunks(files, symbols).unionByName(corpus.residual_chunks(files, symbols), allowMissingColumns=True)
    return {"entities": entities, "relations": relations, "chunks": chunks, "file_hashes": corpus.content_hash(files)}


def synchronise(files: DataFrame, previous: dict[str, DataFrame], reexports: DataFrame | None = None, embed_texts: Callable | None = None) -> dict[str, DataFrame]:
    """The tables after files, from the tables before: only added and modified files are parsed and embedded. An edge belongs to its own file, so this equals a rebuild."""
    changes = sync.file_changes(previous["file_hashes"], corpus.content_hash(files))
    fresh = changes.filter("status in ('added', 'modified')").select("repo", "rel_path")
    new = build(files.join(fresh, ["repo", "rel_path"], "left_semi"), previous["entities"])
    out = {t: sync.replace_files(previous[t], new[t], changes) for t in ("entities", "relations", "chunks")}
    out["relations"] = graph.anchored(out["relations"], out["entities"])
    if reexports is not None:
        out["edges"] = graph.redirect_reexports(out["relations"], reexports)
    if "vectors" in previous:
        texts = new["entities"].select("repo", "id", F.lit("entity").alias("owner"), F.col("description").alias("text")).unionByName(new["chunks"].select("repo", "id", F.lit("chunk").alias("owner"), F.col("content").alias("text")))
        alive = out["entities"].select("repo", "id").unionByName(out["chunks"].select("repo", "id")).distinct()
        out["vectors"] = vectors.add_vectors(previous["vectors"].join(alive, ["repo", "id"], "left_semi"), vectors.embed(texts, embed_texts))
    return out | {"file_hashes": corpus.content_hash(files), "summary": sync.summary(changes)}


def judge_change(hunks: DataFrame, entities: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """One row a commit of a repository: risk level with reasons, from the symbols that its hunks overlap and all that calls them.

    hunks have repo; those without it are judged in each repository that has their path, apart.
    """
    if "repo" not in hunks.columns:
        hunks = hunks.join(entities.select("repo", F.col("file_path").alias("path")).distinct(), "path")
    spans = entities.filter("kind != 'module'").select("repo", "id", F.col("file_path").alias("path"), "name", "line_start", "line_end")
    changed = cut(impact.changed_symbols(hunks, spans.select("repo", "path", F.col("id").alias("name"), "line_start", "line_end")))
    seeds = changed.filter("name != ''").select("repo", F.col("commit").alias("seed"), F.col("name").alias("id")).distinct()
    reached = impact.callers(edges, seeds, depth).join(entities.select("repo", "id", F.col("file_path").alias("path")), ["repo", "id"])
    short = changed.withColumn("name", F.substring_index("name", ".", -1))
    return impact.risk(short, reached.select("repo", F.col("seed").alias("commit"), "id", "path"))


def finding(rows: DataFrame, table: str, key, where: str) -> DataFrame:
    return rows.filter("verdict != 'ok'").select("repo", F.lit(table).alias("table"), key.alias("id"), "verdict", F.concat_ws(" ", "verdict", key).alias("summary"), F.lit(where).alias("where"))


def audit_endpoints(files: DataFrame) -> DataFrame:
    """Routes without callers. Only the lines that declare routes are no call sites; the rest of their files is."""
    found = cut(facts.all_routes(files))
    routes = found.select("repo", F.concat_ws(" ", "method", "path").alias("key"), "path", "rel_path").dropDuplicates(["repo", "key"])
    segments = routes.select("repo", distinctive_segment(path_segments(F.col("path"))).alias("token")).filter("token != ''")
    return finding(audit.audit_endpoints(routes, evidence.call_sites(files, found), audit.token_mentions(files, segments)), "endpoints", F.col("key"), "routes")


#: Folders of what only passes a key on. Fixed values.
DEPLOY_FOLDERS = ("deploy/", "infra/", "ops/", "charts/", "helm/", "k8s/", "terraform/")
#: Parts of the names of files that declare and do not read. Fixed values.
DECLARING_NAMES = (".env", "docker-compose", "compose.y", "dockerfile")


def any_in(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def audit_configs(files: DataFrame) -> DataFrame:
    """Environment keys and configuration constants without a reader. A key that a settings class binds, or that its own file interpolates, is read."""
    path = F.col("rel_path")
    declared = cut(evidence.env_declarations(files).join(evidence.settings_keys(files), ["repo", "key"], "left_anti"))
    used = cut(evidence.interpolations(files))
    own = used.join(declared.select("repo", "key", path.alias("at")), ["repo", "key"]).filter("rel_path = at").select("repo", "key").distinct()
    kinds = files.select("repo", "rel_path", F.when(F.col("is_test"), "test").otherwise(F.col("kind")).alias("kind"))
    index = cut(corpus.tokens_index(files))
    named = index.select("repo", F.col("token").alias("key"), "rel_path", any_in(F.lower(F.substring_index(path, "/", -1)), DECLARING_NAMES).alias("declares"))
    readers = named.unionByName(used.select("repo", "key", "rel_path", F.lit(False).alias("declares"))).join(kinds, ["repo", "rel_path"]).withColumn("is_deploy", any_in(path, DEPLOY_FOLDERS))
    keys = finding(audit.audit_configs(declared.join(own, ["repo", "key"], "left_anti"), readers), "configs", F.concat(F.lit("env:"), F.col("key")), "environment")
    constants = evidence.config_constants(files)
    elsewhere = index.select("repo", F.col("token").alias("name"), path.alias("by")).join(constants.select("repo", "name", "rel_path"), ["repo", "name"]).filter("by != rel_path").select("repo", "name").distinct()
    unread = constants.filter(~F.col("self_used")).join(elsewhere, ["repo", "name"], "left_anti").withColumn("verdict", F.lit("dead"))
    return keys.unionByName(finding(unread, "configs", F.concat_ws(":", F.lit("const"), "rel_path", "name"), "constants"))


def audit_states(files: DataFrame, columns: tuple[str, ...] = STATE_COLUMNS, policies: DataFrame | None = None) -> DataFrame:
    """Declared values that nothing writes or reads, and writes that no check allows; what a later migration drops is neither. A policy's own state columns hold in its repository."""
    events = cut(evidence.declarations(files))
    states = evidence.state_events(files, columns, events, policies)
    domains = cut(audit.retired(audit.fold_domains(states), states, evidence.drop_events(files, events)))
    uses = evidence.literal_uses(files, domains.select("repo", F.explode("values").alias("value")), events)
    name = F.concat(F.lit("state:"), F.concat_ws(".", "table", "column"), F.lit("='"), F.col("value"), F.lit("'"))
    bad = audit.illegal_writes(domains, evidence.literal_writes(files)).withColumn("verdict", F.lit("dead"))
    return finding(audit.audit_states(domains, uses), "states", name, "schema").unionByName(finding(bad, "states", F.regexp_replace(name, "^state", "write"), "statements"))


def audit_envelope(files: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Unguarded handlers that reach a sink. A policy's own gates and sinks hold in its repository. Each file is parsed once."""
    found, path = cut(facts.extract(files)), F.col("rel_path")
    handlers = cut(evidence.routed_handlers(files, found=found.filter(path.endswith(".py")), policies=policies))
    calls = facts.fact_table(found.filter(~is_test_by_tokens(path)), "calls")
    links = calls.select("repo", F.col("caller").alias("src_id"), F.col("callee").alias("tgt_id"))
    guarded = audit.audit_envelope(handlers, links, policies=policies)
    return finding(guarded, "envelope", F.col("start"), "handlers")


#: Audit tables by name; callers choose among them.
AUDITS: dict[str, Callable[..., DataFrame]] = {"endpoints": audit_endpoints, "configs": audit_configs, "states": audit_states, "envelope": audit_envelope}
#: Those that take a repository's own patterns.
PATTERNED = ("states", "envelope")


def audit_report(files: DataFrame, exemptions: DataFrame, tables: tuple[str, ...] = tuple(AUDITS), policies: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """findings with exemptions, their rollup, and stale exemptions. policies are rows of readers.policy_files: the patterns of their repositories."""
    own = None if policies is None else cut(policies.select("repo", "gates", "sinks", "state_columns"))
    # audits read the files many times, and most want few of their columns
    files = cut(files.drop("sha256", "n_lines", "bytes"))
    found = cut(reduce(DataFrame.unionByName, [AUDITS[t](files, policies=own) if t in PATTERNED else AUDITS[t](files) for t in tables]))
    judged = audit.apply_exemptions(found, exemptions)
    return judged, audit.audit_rollup(judged), audit.stale_exemptions(found, exemptions)


__all__ = ["AUDITS", "audit_report", "build", "judge_change", "synchronise"]
