"""Graph metrics kept by signed deltas: a batch adds and removes edges and entities, and only what it touches is worked on.

A batch is rows with a sign. Edges: repo, src_id, tgt_id, kind, n; entities: repo, id, need (it should have a caller),
large (it is an oversized function), sized (it is a function or method), n, where n copies come (positive) or go. The
state of a repository is three tables in a snapshot store:

    edge_state    repo, src_id, tgt_id, n, calls              how many relations there are between two ids, and how many calls
    node_state    repo, id, real, need, large, sized, ends, ins, callers   copies of the entity and its marks, edges at it, into it, calls into it
    metric_state  repo and METRICS                            sums over edges and nodes

An edge that comes or goes changes its two nodes by one, a node that changes changes the sums by what it counts for now
less what it counted for before. So a batch reads and writes the repositories that it touches, and no metric is counted
anew. All three tables and the batch's number are committed as one version: a batch that is repeated, or whose
writer dies halfway, counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.ids import short_name, top_module
from treeline.functions.scores import ratio
from treeline.operators.common import cut
from treeline.operators.health import BUILTINS
from treeline.sources.snapshots import Store

EDGES = "repo string, src_id string, tgt_id string, n long, calls long"
MARKS = ("real", "need", "large", "sized", "ends", "ins", "callers")
NODES = "repo string, id string, " + ", ".join(f"{c} long" for c in MARKS)
METRICS = ("entity_count", "phantom_count", "relation_count", "calls", "crossing", "called", "crowded", "needing", "dead", "functions", "oversized")
SUMS = "repo string, " + ", ".join(f"{c} long" for c in METRICS)

#: Calls into a target from which on it is crowded.
OVER = 5


def state(store: Store, table: str, schema: str, repos: list[str]) -> DataFrame:
    try:
        return store.read(table, repos=repos)
    except KeyError:
        return store.spark.createDataFrame([], schema)


def folded(old: DataFrame, changes: DataFrame, keys: list[str], counts: tuple[str, ...]) -> DataFrame:
    """keys, and for each count c what it was (was_c) and is now (c): old holds a row a key, changes hold differences, any number of rows a key. Both are summed in one shuffle."""
    zero = F.lit(0).cast("long")
    was = old.select(*keys, *[F.col(c).alias(f"was_{c}") for c in counts], *[zero.alias(f"by_{c}") for c in counts])
    more = changes.select(*keys, *[zero.alias(f"was_{c}") for c in counts], *[F.col(c).cast("long").alias(f"by_{c}") for c in counts])
    each = was.unionByName(more).groupBy(*keys).agg(*[F.coalesce(F.sum(f"{w}_{c}"), zero).alias(f"{w}_{c}") for w in ("was", "by") for c in counts])
    return each.select(*keys, *[F.col(f"was_{c}") for c in counts], *[(F.col(f"was_{c}") + F.col(f"by_{c}")).alias(c) for c in counts])


def turned(now: Column, before: Column) -> Column:
    """1 where a condition comes true, -1 where it ceases to be."""
    return now.cast("long") - before.cast("long")


def node_counts(at: Callable[[str], Column]) -> dict[str, Column]:
    """What a node counts for, by its marks."""
    real, called = at("real") > 0, (at("callers") > 0) & ~short_name(F.col("id")).isin(*BUILTINS)
    return {
        "entity_count": real, "phantom_count": ~real & (at("ends") > 0), "called": called, "crowded": called & (at("callers") > OVER), "needing": at("need") > 0,
        "dead": (at("need") > 0) & (at("ins") == 0), "functions": at("sized") > 0, "oversized": at("large") > 0,
    }


def fold(store: Store, batch_id: int, edges: DataFrame, entities: DataFrame | None = None) -> None:
    """Applies a batch of signed edges and entities, once: an id that is not over the last one's is passed over. Ids count up, as micro-batches' do."""
    version = store.latest()
    if int(store.properties(version).get("batch", -1)) >= batch_id:
        return
    keys = ["repo", "src_id", "tgt_id"]
    more = edges.select(*keys, "n", F.when(F.col("kind") == "calls", F.col("n")).otherwise(0).alias("calls"))
    marks = [F.sum("n").cast("long").alias("real"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).cast("long").alias(c) for c in ("need", "large", "sized")]]
    known = entities.groupBy("repo", "id").agg(*marks) if entities is not None else store.spark.createDataFrame([], "repo string, id string, real long, need long, large long, sized long")
    known = cut(known)
    repos = sorted(r["repo"] for r in more.select("repo").unionByName(known.select("repo")).distinct().toLocalIterator())

    edge = cut(folded(state(store, "edge_state", EDGES, repos), more, keys, ("n", "calls")))
    change = edge.select(*keys, turned(F.col("n") > 0, F.col("was_n") > 0).alias("edge"), turned(F.col("calls") > 0, F.col("was_calls") > 0).alias("call")).filter("edge != 0 or call != 0")
    crosses = top_module(F.col("src_id")) != top_module(F.col("tgt_id"))
    edge_sums = change.groupBy("repo").agg(F.sum("edge").alias("relation_count"), F.sum("call").alias("calls"), F.sum(F.when(crosses, F.col("call")).otherwise(0)).alias("crossing"))

    # Both ends of an edge have it; one that leads to itself has it once.
    ends = change.select("repo", F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("id"), "tgt_id", "edge", "call")
    here = F.col("id") == F.col("tgt_id")
    ends = ends.select("repo", "id", F.col("edge").alias("ends"), F.when(here, F.col("edge")).otherwise(0).alias("ins"), F.when(here, F.col("call")).otherwise(0).alias("callers"))
    moved = known.unionByName(ends, allowMissingColumns=True)
    node = cut(folded(state(store, "node_state", NODES, repos), moved, ["repo", "id"], MARKS))
    now, before = node_counts(F.col), node_counts(lambda c: F.col(f"was_{c}"))
    node_sums = node.groupBy("repo").agg(*[F.sum(turned(now[c], before[c])).alias(c) for c in now])

    sums = edge_sums.unionByName(node_sums, allowMissingColumns=True).groupBy("repo").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in METRICS])
    total = folded(state(store, "metric_state", SUMS, repos), sums, ["repo"], METRICS).select("repo", *METRICS)
    tables = {"edge_state": edge.filter("n != 0 or calls != 0").select(*keys, "n", "calls"), "node_state": node.filter(" or ".join(f"{c} != 0" for c in MARKS)).select("repo", "id", *MARKS), "metric_state": total}
    store.commit(tables, touched=repos, properties={"batch": str(batch_id)}, base=version)


def kept_metrics(store: Store) -> DataFrame:
    """repo, the sums, and from them mc, fi, dc and fs."""
    sums = store.read("metric_state")
    shares = {"mc": ("crossing", "calls"), "fi": ("crowded", "called"), "dc": ("dead", "needing"), "fs": ("oversized", "functions")}
    return sums.select("repo", *METRICS, *[ratio(F.col(part), F.col(of)).alias(d) for d, (part, of) in shares.items()])


def entity_marks(entities: DataFrame, needed: Column, over: int = 50) -> DataFrame:
    """Entities as fold wants them, without n. needed: whether one should have a caller."""
    sized = F.col("kind").isin("function", "method")
    return entities.select("repo", "id", needed.alias("need"), (sized & (F.col("line_end") - F.col("line_start") > over)).alias("large"), sized.alias("sized"))
