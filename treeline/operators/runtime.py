"""Runtime traces as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.ids import parent_module, runtime_module


def module_edges(raw: DataFrame, root: Column) -> DataFrame:
    """raw(repo, from, to), absolute paths -> repo, src, tgt, cnt: both in the project, not itself."""
    ends = raw.select("repo", runtime_module(F.col("from"), root).alias("src"), runtime_module(F.col("to"), root).alias("tgt"))
    return ends.filter("src is not null and tgt is not null and src != tgt").groupBy("repo", "src", "tgt").agg(F.count("*").alias("cnt"))


def trace_edges(events: DataFrame, session: str, order: list[str], name: str) -> DataFrame:
    """src, tgt, cnt: the event before, in its session, calls this one; runs of one name do not count."""
    before = F.lag(name).over(Window.partitionBy(session).orderBy(*order))
    pairs = events.select(before.alias("src"), F.col(name).alias("tgt"))
    return pairs.filter("src is not null and src != tgt").groupBy("src", "tgt").agg(F.count("*").alias("cnt"))


def expand_to_symbols(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Module edges led on to the target module's symbols, or kept where it has none; counts summed again."""
    symbols = entities.select("repo", F.col("id").alias("symbol"), parent_module(F.col("id")).alias("tgt")).filter("tgt != ''")
    return edges.join(symbols, ["repo", "tgt"], "left").groupBy("repo", "src", F.coalesce("symbol", "tgt").alias("tgt")).agg(F.sum("cnt").alias("cnt"))
