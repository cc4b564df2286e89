"""Incremental maintenance: what changed, what goes, what comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new file_hashes(repo, rel_path, sha256) -> repo, rel_path, status: added, modified, unchanged or deleted."""
    joined = old.select("repo", "rel_path", F.col("sha256").alias("was")).join(new.select("repo", "rel_path", F.col("sha256").alias("is")), ["repo", "rel_path"], "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") == F.col("is"), "unchanged").otherwise("modified")
    return joined.select("repo", "rel_path", status.alias("status"))


def reuse_hashes(listing: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """listing(repo, rel_path, mtime, length) split by known(..., sha256): rows with their old hash, and rows whose content must be read."""
    joined = listing.join(known.select("repo", "rel_path", "mtime", "length", "sha256"), ["repo", "rel_path", "mtime", "length"], "left")
    return joined.filter(F.col("sha256").isNotNull()), joined.filter(F.col("sha256").isNull()).drop("sha256")


def replace_files(old: DataFrame, new: DataFrame, changes: DataFrame, file_column: str = "file_path") -> DataFrame:
    """old without rows of files that are not unchanged, and new's rows of added and modified files."""
    touched = changes.filter("status != 'unchanged'").select("repo", F.col("rel_path").alias(file_column))
    fresh = changes.filter("status in ('added', 'modified')").select("repo", F.col("rel_path").alias(file_column))
    return old.join(touched, ["repo", file_column], "left_anti").unionByName(new.join(fresh, ["repo", file_column], "left_semi"), allowMissingColumns=True)


def untracked(rows: DataFrame, tracked: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Rows whose file is no longer tracked."""
    return rows.join(tracked.select("repo", F.col("rel_path").alias(file_column)).distinct(), ["repo", file_column], "left_anti")


def summary(changes: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.groupBy("repo").agg(*[count(s) for s in ("added", "modified", "unchanged", "deleted")])


def baseline_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of new findings and of fixed ones, with `change`."""
    gone, come = old.select(*keys).distinct(), new.select(*keys).distinct()
    return come.join(gone, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(gone.join(come, keys, "left_anti").withColumn("change", F.lit("fixed")))


def ratchet_keys(findings: DataFrame) -> DataFrame:
    """findings(file, code) -> key: file|code|count."""
    return findings.groupBy("file", "code").agg(F.count("*").alias("n")).select(F.concat_ws("|", "file", "code", F.col("n").cast("string")).alias("key"))


def ratchet_diff(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """Keys added or gone; either fails the ratchet."""
    return baseline_delta(baseline, now, ["key"]).withColumn("change", F.when(F.col("change") == "new", "added").otherwise("gone"))


def vulnerability_keys(findings: DataFrame, manifests: DataFrame) -> DataFrame:
    """findings(package, advisory), manifests(rel_path, package) -> key, by the manifest that names the package."""
    named = manifests.select("rel_path", F.lower("package").alias("p")).distinct()
    rows = findings.withColumn("p", F.lower("package")).join(named, "p", "left")
    return rows.groupBy(F.coalesce("rel_path", F.lit("?")).alias("file"), F.col("advisory").alias("code")).agg(F.count("*").alias("n")).select(F.concat_ws("|", "file", "code", F.col("n").cast("string")).alias("key"))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta and percent; the percent is null where before is 0."""
    rows = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    delta = F.col("after") - F.col("before")
    return rows.select("metric", "before", "after", delta.alias("delta"), F.when(F.col("before") != 0, delta * 100.0 / F.col("before")).alias("percent"))


def changed_since(commits: DataFrame, since: str) -> DataFrame:
    """Files in commits(file, ts) after a time."""
    return commits.filter(F.col("ts") > F.lit(since).cast("timestamp")).select("file").distinct()
