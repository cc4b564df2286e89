"""Declared against consumed: endpoints, states, configuration and guarded handlers.

Findings are rows of table, id, verdict (dead or suspect), summary, where, evidence and exempt_reason. Ids never hold
line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.text import SINKS, distinctive_segment, glob_column, is_sink, is_state_like, literal_segments, path_segments
from treeline.operators.common import by_policy, by_repo
from treeline.operators.graph import reach_sinks

STRONG = ("web", "code", "shell")
INVENTORY_SHARE, INVENTORY_ROUTES, INVENTORY_HITS = 0.75, 10, 8
#: What stands in the names of files that list an API. Fixed values.
INVENTORY_NAMES = ("openapi", "swagger", "api-docs", "apidocs", "postman", "insomnia")
GUARD_FLOOR = 0.25


def slices(items: Column, longest: int) -> Column:
    """All contiguous runs of up to `longest` items."""
    starts = F.sequence(F.lit(1), F.size(items))
    runs = F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(items) - a + 1)), lambda n: F.slice(items, a, n)))
    return F.when(F.size(items) > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<array<string>>"))


def suffixes(items: Column) -> Column:
    """All proper and improper tails, longest first."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items)), lambda a: F.slice(items, a, F.size(items)))).otherwise(F.array().cast("array<array<string>>"))


def match_routes(routes: DataFrame, sites: DataFrame) -> DataFrame:
    """routes(repo, key, path), sites(repo, rel_path, kind, path) -> repo, key, rel_path, kind.

    A site calls a route if the route's literals stand in a row among its own, or its own are the end of the route's.
    Both are equi-joins: on exploded runs of the site, none longer than the longest route, and on exploded route ends.
    """
    lits = lambda t: t.withColumn("lits", literal_segments(path_segments(F.col("path")))).filter(F.size("lits") > 0)
    r, s = lits(routes).select("repo", "key", "lits"), lits(sites).select("repo", "rel_path", "kind", "lits").distinct()
    longest = r.agg(F.coalesce(F.max(F.size("lits")), F.lit(1))).first()[0]
    inside = s.select("repo", "rel_path", "kind", F.explode(slices(F.col("lits"), longest)).alias("lits")).join(r, ["repo", "lits"])
    tails = r.select("repo", "key", F.explode(suffixes(F.col("lits"))).alias("lits")).join(s, ["repo", "lits"])
    cols = ["repo", "key", "rel_path", "kind"]
    return inside.select(*cols).unionByName(tails.select(*cols)).distinct()


def inventories(matches: DataFrame, routes: DataFrame) -> DataFrame:
    """Files that mention so many routes that they only list them: repo, rel_path, hits, share."""
    total = routes.groupBy("repo").agg(F.countDistinct("key").alias("routes"))
    hits = matches.groupBy("repo", "rel_path").agg(F.countDistinct("key").alias("hits")).join(total, "repo")
    share = F.col("hits") / F.col("routes")
    name = F.lower(F.substring_index("rel_path", "/", -1))
    listed = F.exists(F.array(*[F.lit(m) for m in INVENTORY_NAMES]), lambda m: F.contains(name, m))
    many = (F.col("routes") >= INVENTORY_ROUTES) & (F.col("hits") >= INVENTORY_HITS) & (share >= INVENTORY_SHARE)
    return hits.filter(listed | many).select("repo", "rel_path", "hits", share.alias("share"))


def audit_endpoints(routes: DataFrame, sites: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """routes(repo, key, path, rel_path) -> repo, key, verdict: ok, suspect or dead.

    ok with a strong site, or with no literal to match; suspect with weak ones, or with the distinctive segment in
    mentions(repo, token, rel_path, kind) of another file; else dead. Inventory files are left out.
    """
    matches = match_routes(routes, sites)
    matches = matches.join(inventories(matches, routes), ["repo", "rel_path"], "left_anti")
    per = matches.groupBy("repo", "key").agg(F.bool_or(F.col("kind").isin(*STRONG)).alias("strong"), F.count("*").alias("hits"))
    segments = path_segments(F.col("path"))
    rows = routes.select("repo", "key", "rel_path", distinctive_segment(segments).alias("token"), F.size(literal_segments(segments)).alias("n_literals")).join(per, ["repo", "key"], "left")
    if mentions is None:
        rows = rows.withColumn("mentioned", F.lit(False))
    else:
        told = mentions.filter("kind != 'sql'").select("repo", "token", F.col("rel_path").alias("in_file"))
        found = rows.filter("token != ''").join(told, ["repo", "token"]).filter("in_file != rel_path").select("repo", "key").distinct().withColumn("mentioned", F.lit(True))
        rows = rows.join(found, ["repo", "key"], "left")
    verdict = F.when(F.col("strong") | (F.col("n_literals") == 0), "ok").when((F.col("hits") > 0) | F.col("mentioned"), "suspect").otherwise("dead")
    return rows.select("repo", "key", verdict.alias("verdict"))


def token_mentions(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files whose text holds a token, by exploding word-like tokens of the text and joining on them: repo, token, rel_path, kind."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0)))).alias("token")
    return files.select("repo", words, "rel_path", "kind").join(tokens.distinct(), ["repo", "token"], "left_semi")


def fold_domains(events: DataFrame) -> DataFrame:
    """state_events(repo, table, column, values, is_check, is_replace, default_value, seq) -> repo, table, column, values, checked, defaults.

    A check that redefines starts its column anew; other declarations add to it. Defaults always gather.
    """
    by = Window.partitionBy("repo", "table", "column")
    since = F.max(F.when(F.col("is_replace"), F.col("seq"))).over(by)
    rows = events.withColumn("live", since.isNull() | (F.col("seq") >= since))
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("live"), F.col("values"))))))
    return rows.groupBy("repo", "table", "column").agg(
        F.filter(values, lambda v: is_state_like(v)).alias("values"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("live") & F.col("is_check"), F.col("values")))))).alias("checked"),
        F.array_sort(F.collect_set("default_value")).alias("defaults"),
    )


def retired(domains: DataFrame, events: DataFrame, drops: DataFrame) -> DataFrame:
    """domains without columns that were dropped, alone or with their table, after their last declaration. events: state_events; drops: drop_events."""
    last = events.groupBy("repo", "table", "column").agg(F.max(F.struct("seq.rel_path", "seq.position")).alias("told"))
    at = F.struct("rel_path", "position").alias("dropped")
    whole = drops.filter("column is null").select("repo", "table", at)
    single = drops.filter("column is not null").select("repo", "table", "column", at)
    gone = last.join(whole, ["repo", "table"]).filter("dropped > told").select("repo", "table", "column")
    gone = gone.unionByName(last.join(single, ["repo", "table", "column"]).filter("dropped > told").select("repo", "table", "column"))
    return domains.join(gone.distinct(), ["repo", "table", "column"], "left_anti")


def audit_states(domains: DataFrame, uses: DataFrame) -> DataFrame:
    """domains(repo, table, column, values, defaults), uses(repo, value, is_test, is_read, context) -> repo, table, column, value, verdict.

    No use: dead, or suspect for a default, which the database writes. Tests alone: suspect. A default, or any use
    that is no comparison: ok. Comparisons that name neither column nor table: ok. What is left is only ever compared: suspect.
    """
    each = domains.select("repo", "table", "column", "defaults", F.explode("values").alias("value"))
    per = uses.join(each.select("repo", "table", "column", "value"), ["repo", "value"])
    named = F.contains(F.col("context"), F.col("column")) | F.contains(F.col("context"), F.col("table"))
    live = ~F.col("is_test")
    per = per.groupBy("repo", "table", "column", "value").agg(F.count_if(live).alias("production"), F.bool_or(live & ~F.col("is_read")).alias("non_read"), F.bool_or(live & named).alias("named"))
    rows = each.join(per, ["repo", "table", "column", "value"], "left")
    is_default = F.array_contains("defaults", F.col("value"))
    verdict = (
        F.when(F.col("production").isNull(), F.when(is_default, "suspect").otherwise("dead")).when(F.col("production") == 0, "suspect")
        .when(is_default | F.col("non_read") | ~F.col("named"), "ok").otherwise("suspect")
    )
    return rows.select("repo", "table", "column", "value", verdict.alias("verdict"))


def illegal_writes(domains: DataFrame, writes: DataFrame) -> DataFrame:
    """writes(repo, table, column, value, place) of values that their column's check does not allow; the first place of each."""
    checked = domains.filter(F.size("checked") > 0).select("repo", "table", "column", "checked")
    bad = writes.join(checked, ["repo", "table", "column"]).filter(~F.array_contains("checked", F.col("value")))
    return bad.groupBy("repo", "table", "column", "value").agg(F.min("place").alias("place"), F.count("*").alias("times"))


def audit_configs(declared: DataFrame, readers: DataFrame) -> DataFrame:
    """declared(repo, key, rel_path), readers(repo, key, rel_path, kind, is_deploy, declares) -> repo, key, verdict.

    ok where code outside deployment reads it; dead where nothing else names it; else suspect. Documents are no readers.
    """
    real = readers.filter(~F.col("declares") & (F.col("kind") != "doc")).join(declared.select("repo", "key").distinct(), ["repo", "key"], "left_semi")
    code = F.col("kind").isin("code", "web") & ~F.col("is_deploy")
    per = real.groupBy("repo", "key").agg(F.bool_or(code).alias("read"), F.count("*").alias("n"))
    verdict = F.when(F.col("read"), "ok").when(F.coalesce("n", F.lit(0)) == 0, "dead").otherwise("suspect")
    return declared.select("repo", "key").distinct().join(per, ["repo", "key"], "left").select("repo", "key", verdict.alias("verdict"))


def guard_share(handlers: DataFrame) -> DataFrame:
    """handlers(repo, handler, guarded) -> repo, handlers, guarded, share, audited: below the floor a repo has no convention to break."""
    per = handlers.groupBy("repo").agg(F.count("*").alias("handlers"), F.count_if("guarded").alias("guarded"))
    share = F.col("guarded") / F.greatest("handlers", F.lit(1))
    return per.select("*", share.alias("share"), (share >= GUARD_FLOOR).alias("audited"))


def audit_envelope(handlers: DataFrame, calls: DataFrame, sinks: tuple[str, ...] = SINKS, policies: DataFrame | None = None) -> DataFrame:
    """Unguarded handlers that reach a sink within four calls, in repos that guard at all. policies(repo, sinks) name the sinks of their repositories, in place of `sinks`."""
    audited = guard_share(handlers).filter("audited").select("repo")
    starts = handlers.filter(~F.col("guarded")).join(audited, "repo", "left_semi").select("repo", F.col("handler").alias("start"))
    return reach_sinks(by_policy(calls, policies, "sinks", sinks), starts, is_sink(F.col("tgt_id"), F.col("sinks"))).withColumn("verdict", F.lit("suspect"))


GLOB = r"[*?\[]"


def globs_met(keys: DataFrame, exemptions: DataFrame, by: list[str]) -> DataFrame:
    """keys(*by, id) with the entry, reason and ord of each glob that fits."""
    globs = exemptions.filter(F.col("entry").rlike(GLOB)).select(*[F.col(c).alias(f"g_{c}") for c in by], glob_column(F.col("entry")).alias("like"), "entry", "reason", "ord")
    same = F.expr(" and ".join([*(f"{c} = g_{c}" for c in by), "id rlike like"]))
    return keys.join(globs, same).drop("like", *[f"g_{c}" for c in by])


def apply_exemptions(findings: DataFrame, exemptions: DataFrame) -> DataFrame:
    """findings(repo, table, id, ...) with exempt_reason: of the exact entry, else of the first glob by ord.

    Entries hold for their own repository; entries without that column hold for all. Exact entries meet by equality;
    globs are compared with the findings of their repository and table, which they meet by equality.
    """
    by = [*by_repo(findings, exemptions), "table"]
    exact = exemptions.filter(~F.col("entry").rlike(GLOB)).groupBy(*by, F.col("entry").alias("id")).agg(F.min_by("reason", "ord").alias("exact_reason"))
    met = globs_met(findings.select(*by, "id").distinct(), exemptions, by).groupBy(*by, "id").agg(F.min_by("reason", "ord").alias("glob_reason"))
    rows = findings.join(exact, [*by, "id"], "left").join(met, [*by, "id"], "left")
    return rows.withColumn("exempt_reason", F.coalesce("exact_reason", "glob_reason")).drop("exact_reason", "glob_reason")


def stale_exemptions(findings: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Entries that match no finding, of their own repository where they have one."""
    by = [*by_repo(findings, exemptions), "table"]
    keys = findings.select(*by, "id").distinct()
    exact = exemptions.filter(~F.col("entry").rlike(GLOB)).join(keys.withColumnRenamed("id", "entry"), [*by, "entry"], "left_anti")
    used = globs_met(keys, exemptions, by).select(*by, "entry").distinct()
    return exact.unionByName(exemptions.filter(F.col("entry").rlike(GLOB)).join(used, [*by, "entry"], "left_anti"))


def audit_rollup(findings: DataFrame) -> DataFrame:
    """Per table and over all (table null): total, dead, suspect, exempted."""
    open_ = F.col("exempt_reason").isNull()
    return findings.rollup("table").agg(
        F.count("*").alias("total"), F.count_if(open_ & (F.col("verdict") == "dead")).alias("dead"),
        F.count_if(open_ & (F.col("verdict") == "suspect")).alias("suspect"), F.count_if(~open_).alias("exempted"),
    )


def fail_on(rollup: DataFrame, new_findings: int, mode: str) -> DataFrame:
    """Whether a run fails: on dead, any, new or never."""
    total = rollup.filter(F.col("table").isNull())
    rule = {"dead": F.col("dead") > 0, "any": F.col("dead") + F.col("suspect") > 0, "new": F.lit(new_findings > 0), "never": F.lit(False)}[mode]
    return total.select(rule.alias("fails"))
