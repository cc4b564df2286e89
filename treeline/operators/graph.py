"""The code graph as two tables, entities(repo, id, kind, ...) and relations(repo, src_id, tgt_id, kind, ..., seq)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.scores import call_weight
from treeline.operators.common import cut
from treeline.operators.patterns import contained


def collapse_edges(relations: DataFrame) -> DataFrame:
    """One edge for each (repo, src_id, tgt_id): the last writer by seq gives kind, weight and file."""
    last = F.max_by(F.struct("kind", "weight", "file_path"), F.struct("seq", "kind"))
    return relations.groupBy("repo", "src_id", "tgt_id").agg(last.alias("e")).select("repo", "src_id", "tgt_id", "e.kind", "e.weight", "e.file_path")


def endpoints(relations: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src_id", "tgt_id")).alias("id")
    return relations.select("repo", ends, "file_path")


def phantoms(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Endpoints that are no entity, with the files whose relations name them. Ids are told apart first, each once, so that files are gathered for the phantoms alone."""
    ends = endpoints(cut(relations.select("repo", "src_id", "tgt_id", "file_path")))
    missing = cut(ends.select("repo", "id").distinct().join(entities.select("repo", "id"), ["repo", "id"], "left_anti"))
    return ends.join(missing, ["repo", "id"]).groupBy("repo", "id").agg(F.array_sort(F.collect_set("file_path")).alias("responsible_files"))


def prunable_phantoms(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Phantoms without a real neighbour."""
    real = entities.select("repo", "id").distinct()
    both = relations.select("repo", F.col("src_id").alias("id"), F.col("tgt_id").alias("other")).unionByName(relations.select("repo", F.col("tgt_id").alias("id"), F.col("src_id").alias("other")))
    held = both.join(real.withColumnRenamed("id", "other"), ["repo", "other"], "left_semi").select("repo", "id")
    missing = endpoints(relations).select("repo", "id").distinct().join(real, ["repo", "id"], "left_anti")
    return missing.join(held, ["repo", "id"], "left_anti")


def anchored(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of which at least one end is an entity."""
    ids = entities.select("repo", "id").distinct().withColumn("there", F.lit(True))
    marked = relations.join(ids.withColumnsRenamed({"id": "src_id", "there": "s"}), ["repo", "src_id"], "left").join(ids.withColumnsRenamed({"id": "tgt_id", "there": "t"}), ["repo", "tgt_id"], "left")
    return marked.filter("s or t").drop("s", "t")


def remove_files(entities: DataFrame, relations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what files(repo, file_path) gave. An edge goes with its own file."""
    return entities.join(files, ["repo", "file_path"], "left_anti"), relations.join(files, ["repo", "file_path"], "left_anti")


def redirect_reexports(relations: DataFrame, reexports: DataFrame) -> DataFrame:
    """Edges with both ends moved from phantom_id to real_id, chains followed; an edge that is there already stays as it is, loops go.

    Chains halve in each round, to the end however long they are; what goes round in a circle is no re-export.
    """
    chain = cut(reexports.select("repo", "phantom_id", "real_id").filter("phantom_id != real_id").dropDuplicates(["repo", "phantom_id"]))
    longest = chain.count()
    while True:
        step = chain.select("repo", F.col("phantom_id").alias("real_id"), F.col("real_id").alias("next"))
        further = chain.join(step, ["repo", "real_id"], "left")
        if longest == 0:  # what still goes on has gone round
            chain = further.filter("next is null").select("repo", "phantom_id", "real_id")
            break
        if further.filter("next is not null").isEmpty():
            break
        chain = cut(further.select("repo", "phantom_id", F.coalesce("next", "real_id").alias("real_id")).filter("phantom_id != real_id"))
        longest //= 2
    moved = relations
    for end in ("src_id", "tgt_id"):
        to = chain.select("repo", F.col("phantom_id").alias(end), F.col("real_id").alias(f"new_{end}"))
        moved = moved.join(to, ["repo", end], "left")
    moved = moved.withColumn("moved", F.col("new_src_id").isNotNull() | F.col("new_tgt_id").isNotNull())
    moved = moved.withColumns({e: F.coalesce(f"new_{e}", e) for e in ("src_id", "tgt_id")}).drop("new_src_id", "new_tgt_id").filter("src_id != tgt_id")
    first = F.min_by(F.struct("kind", "weight", "file_path", "moved"), F.struct("moved", "seq", "kind"))
    return moved.groupBy("repo", "src_id", "tgt_id").agg(first.alias("e")).select("repo", "src_id", "tgt_id", "e.*")


def merge_dynamic(relations: DataFrame, trace: DataFrame, entities: DataFrame, replace: bool = True) -> DataFrame:
    """Relations with traced calls(repo, edge, times) as dynamic ones; `edge` reads caller->callee.

    Dynamic edges need one real end; malformed ones are left out. With replace, earlier dynamic edges go first.
    """
    kept = relations.filter("origin != 'dynamic'") if replace else relations
    parts = F.split("edge", "->", 2)
    good = trace.filter(F.size(parts) == 2).select("repo", F.trim(parts[0]).alias("src_id"), F.trim(parts[1]).alias("tgt_id"), "times").filter("src_id != '' and tgt_id != ''")
    new = anchored(good, entities).select("repo", "src_id", "tgt_id", F.lit("calls").alias("kind"), call_weight(F.col("times")).alias("weight"), F.lit("__dynamic__").alias("file_path"), F.lit("dynamic").alias("origin"))
    return kept.select(new.columns).unionByName(new)


def merge_stats(relations: DataFrame, trace: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts of a replacing merge: removed, added, skipped."""
    old = relations.agg(F.count_if(F.col("origin") == "dynamic").alias("removed"))
    new = merge_dynamic(relations.limit(0), trace, entities).agg(F.count("*").alias("added"))
    return old.join(new).join(trace.agg(F.count("*").alias("all"))).select("removed", "added", (F.col("all") - F.col("added")).alias("skipped"))


def graph_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per repo: entities, phantoms, relations and indexed files."""
    real = entities.groupBy("repo").agg(F.countDistinct("id").alias("entity_count"), F.countDistinct("file_path").alias("file_count"))
    ghosts = phantoms(entities, relations).groupBy("repo").agg(F.count("*").alias("phantom_count"))
    edges = relations.groupBy("repo").agg(F.countDistinct("src_id", "tgt_id").alias("relation_count"))
    joined = real.join(ghosts, "repo", "full").join(edges, "repo", "full")
    return joined.select("repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entity_count", "phantom_count", "relation_count", "file_count")])


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """seeds(repo, seed, id) -> repo, seed, id, word, bit: each (repo, seed) is a bit of a long, 64 seeds a word. Words are a task's own, so nothing is numbered in one place."""
    each = cut(seeds.select("repo", "seed").distinct().withColumn("number", F.monotonically_increasing_id()))
    return cut(seeds.select("repo", "seed", "id").distinct().join(each, ["repo", "seed"]).select("repo", "seed", "id", F.shiftright("number", 6).alias("word"), F.expr("shiftleft(1L, cast(number & 63 as int))").alias("bit")))


def khop_bits(edges: DataFrame, numbered: DataFrame, depth: int, direction: str = "both", entities: DataFrame | None = None) -> DataFrame:
    """numbered_seeds -> repo, word, id, bits, depth: which seeds of a word first reach an id at a depth.

    Frontiers are bit sets: a row stands for up to 64 seeds at a node, so a hop's rows grow with the nodes and the words, not with
    the seeds that share a node. A hop is a join on (repo, id) each way, one bit_or on (repo, word, id), which tasks begin before they
    shuffle, and one join with what is known. Edges are written once, as they are: what comes twice changes no bit. Phantoms are reported
    and not expanded, where entities are given: they leave the frontier, which is small, and not the edges. Each hop is cut, so plans
    stay short however deep the walk.
    """
    pairs = cut(edges.select("repo", "src_id", "tgt_id"))
    out, back = (pairs.select("repo", F.col(a).alias("id"), F.col(b).alias("next")) for a, b in (("src_id", "tgt_id"), ("tgt_id", "src_id")))
    ways = {"callees": [out], "callers": [back]}.get(direction, [out, back] if direction == "both" else [out])
    frontier = cut(numbered.groupBy("repo", "word", "id").agg(F.bit_or("bit").alias("bits")))
    known, found = frontier, frontier.withColumn("depth", F.lit(0))
    for hop in range(1, depth + 1):
        live = frontier if entities is None else frontier.join(entities.select("repo", "id"), ["repo", "id"], "left_semi")
        met = reduce(DataFrame.unionByName, [live.join(way, ["repo", "id"]).select("repo", "word", "next", "bits") for way in ways])
        joined = met.groupBy("repo", "word", F.col("next").alias("id")).agg(F.bit_or("bits").alias("met")).join(known, ["repo", "word", "id"], "left")
        frontier = cut(joined.select("repo", "word", "id", F.expr("met & ~coalesce(bits, 0L)").alias("bits")).filter("bits != 0"))
        found = found.unionByName(frontier.withColumn("depth", F.lit(hop)))
        if hop < depth:
            known = cut(known.unionByName(frontier).groupBy("repo", "word", "id").agg(F.bit_or("bits").alias("bits")))
    return found


def khop(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", entities: DataFrame | None = None) -> DataFrame:
    """seeds(repo, seed, id) -> repo, seed, id, depth: what each seed reaches within depth steps, by its first discovery. All seeds walk at once, as bits (khop_bits); their names come back by word."""
    numbered = numbered_seeds(seeds)
    found = khop_bits(edges, numbered, depth, direction, entities)
    names = numbered.select("repo", "seed", "word", "bit").distinct()
    return found.join(names, ["repo", "word"]).filter("bits & bit != 0").select("repo", "seed", "id", "depth")


def with_kind(reached: DataFrame, entities: DataFrame) -> DataFrame:
    """Reached ids with their entity's kind, `external` for phantoms."""
    return reached.join(entities.select("repo", "id", "kind"), ["repo", "id"], "left").withColumn("kind", F.coalesce("kind", F.lit("external")))


def induced_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, seed, src_id, tgt_id, kind: edges with both ends reached from one seed, each once."""
    ids = reached.select("repo", "seed", "id")
    starts = ids.withColumnRenamed("id", "src_id").join(edges.select("repo", "src_id", "tgt_id", "kind").distinct(), ["repo", "src_id"])
    return starts.join(ids.withColumnRenamed("id", "tgt_id"), ["repo", "seed", "tgt_id"], "left_semi").select("repo", "seed", "src_id", "tgt_id", "kind")


def among(relations: DataFrame, reached: DataFrame) -> DataFrame:
    """Relations with both ends reached, from whatever seed: what there is to collapse of a neighbourhood."""
    ids = cut(reached.select("repo", "id").distinct())
    for end in ("tgt_id", "src_id"):
        relations = relations.join(ids.withColumnRenamed("id", end), ["repo", end], "left_semi")
    return relations


def lookup(entities: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols(repo, symbol), however many -> entities whose id is it, ends with .it, or whose name contains it: repo, symbol, id.

    Ids meet by equality, on exploded dotted tails; names run through automata of the symbols.
    """
    asked = cut(symbols.select("repo", "symbol").filter("symbol != ''").distinct())
    parts = F.split("id", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    by_id = entities.select("repo", "id", F.explode(F.array_distinct(tails)).alias("symbol")).join(asked, ["repo", "symbol"])
    by_name = contained(entities.select("repo", "id", "name"), "name", asked.select(F.col("symbol").alias("pattern"))).withColumnRenamed("pattern", "symbol").join(asked, ["repo", "symbol"])
    return by_id.select("repo", "symbol", "id").unionByName(by_name.select("repo", "symbol", "id")).distinct()


def prefix_expand(hits: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """hits(repo, id) plus, for hits without edges, every entity under them: repo, seed, id. Prefixes meet by equality, on exploded parents."""
    lonely = hits.join(endpoints(edges).select("repo", "id").distinct(), ["repo", "id"], "left_anti")
    parts = F.split("id", r"\.")
    parents = entities.select("repo", F.col("id").alias("child"), F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ".")))).alias("id"))
    under = lonely.join(parents, ["repo", "id"]).select("repo", F.col("id").alias("seed"), F.col("child").alias("id"))
    return hits.select("repo", F.col("id").alias("seed"), "id").unionByName(under)


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(repo, src, tgt) -> repo, node, component: strongly connected components of more than one node, named by their least node.

    The least label flows along the edges and against them, to a fixpoint: nodes that one label reaches both ways are a
    component. Of the rest, edges whose ends have the same two labels go round again, until none are left; each round
    ends at least one component of each part.
    """
    left, done = cut(edges.select("repo", "src", "tgt").filter("src != tgt").distinct()), None
    while done is None or not left.isEmpty():
        labels = spread(left)
        found = labels.filter("label = back").select("repo", "node", "label")
        done = found if done is None else done.unionByName(found)
        rest = labels.filter("label != back")
        ends = left.join(rest.withColumnsRenamed({"node": "src", "label": "ls", "back": "bs"}), ["repo", "src"]).join(rest.withColumnsRenamed({"node": "tgt", "label": "lt", "back": "bt"}), ["repo", "tgt"])
        left = cut(ends.filter("ls = lt and bs = bt").select("repo", "src", "tgt"))
    named = done.groupBy("repo", "label").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return done.join(named, ["repo", "label"]).select("repo", "node", "component")


def spread(edges: DataFrame) -> DataFrame:
    """edges(repo, src, tgt) -> repo, node, label, back: the least label from which each node is reached, and the least that it reaches, its own included.

    Labels are nodes in the order of a hash, so that no order of names makes a path slow. Besides a label each node keeps
    a jump, a node up the way from which its label comes. In a round every node looks where its jump has got to, and takes
    the least of what it and those before it see there: distances to the least label halve, and a ring of n
    nodes takes about twice the logarithm of n rounds. Both ways go in one table.
    """
    ways = cut(edges.select("repo", F.lit(0).alias("way"), "src", "tgt").unionByName(edges.select("repo", F.lit(1).alias("way"), F.col("tgt").alias("src"), F.col("src").alias("tgt"))))
    nodes = ways.select("repo", "way", F.explode(F.array("src", "tgt")).alias("node")).distinct()
    state = cut(nodes.select("repo", "way", "node", F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("node")).alias("label"), F.col("node").alias("jump")))
    while True:
        there = state.select("repo", "way", F.col("node").alias("jump"), F.col("label").alias("j_label"), F.col("jump").alias("j_jump"))
        leapt = state.join(there, ["repo", "way", "jump"]).select("repo", "way", "node", F.struct(F.col("j_label").alias("label"), F.col("j_jump").alias("jump")).alias("got"), F.col("label").alias("was"))
        sent = ways.join(leapt.select("repo", "way", F.col("node").alias("src"), "got"), ["repo", "way", "src"]).select("repo", "way", F.col("tgt").alias("node"), "got")
        new = leapt.unionByName(sent, allowMissingColumns=True).groupBy("repo", "way", "node").agg(F.min("got").alias("got"), F.max("was").alias("was"))
        new = cut(new.select("repo", "way", "node", "got.label", "got.jump", (F.col("got.label") != F.col("was")).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    label, back = (state.filter(F.col("way") == w).select("repo", "node", F.col("label.node").alias(c)) for w, c in ((0, "label"), (1, "back")))
    return cut(label.join(back, ["repo", "node"]))


def reach_sinks(edges: DataFrame, starts: DataFrame, sink: Column, hops: int = 4) -> DataFrame:
    """starts(repo, start) and edges(repo, src_id, tgt_id): the first sink that each start reaches, by hop, then name.

    `sink` is a condition on the column tgt_id. A start leaves the walk once it has found a sink.
    """
    calls = cut(edges.select("repo", "src_id", "tgt_id", sink.alias("is_sink")).distinct())
    known = cut(starts.select("repo", "start", F.col("start").alias("id")).distinct())
    front, found = known, None
    for hop in range(1, hops + 1):
        met = front.join(calls.withColumnRenamed("src_id", "id"), ["repo", "id"]).select("repo", "start", F.col("tgt_id").alias("id"), "is_sink").distinct()
        met = cut(met.join(known, ["repo", "start", "id"], "left_anti"))
        here = met.filter("is_sink").groupBy("repo", "start").agg(F.min("id").alias("sink")).withColumn("hop", F.lit(hop))
        found = here if found is None else found.unionByName(here)
        front = cut(met.join(here, ["repo", "start"], "left_anti").select("repo", "start", "id"))
        known = known.unionByName(front)
    return found
