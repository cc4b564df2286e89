"""N-gram Jaccard join: near-duplicate documents by a blocked sparse product of the document x shingle incidence.

A document's set is its distinct 5-word shingles. Two sets link when 100 * intersection >= 75 * union; a document's
component is what it reaches by links. The links themselves are never listed within a component, as a group of n near
copies has n * n of them:

1. Documents of one set, told by 128 bits, are one node, named by its smallest key; what follows runs on nodes.
2. All sets are ordered alike, frequent shingles last. Linked sets x and y share `needed` = ceil(3 (x + y) / 7)
   shingles, so the first LEAST of these stand among the first n - needed + LEAST of either set. A node puts the first
   n - ceil(0.75 n) + LEAST, which suffices for every size of partner, into the incidence table with their places.
   Columns of one node drop out.
3. Every node meets the smallest node of each of its columns; the pair that shares most columns is verified. These
   links give components, within which nothing more need be compared. Nodes that share many columns with one smallest
   node, linked or not, form a group, as near copies of one text do.
4. A group that is still in several components makes no pairs. The rows outside its largest component are multiplied
   with all its rows in blocks of about BLOCK: a task has two blocks, adds up their overlaps over runs of columns, and
   passes on a spanning forest of the links that it finds. A group of n nodes, m of them outside its largest component,
   deals n * m / BLOCK texts twice; its work is n * m, which no bound on sizes can spare near copies that do not link.
5. Columns that hold several groups are multiplied between groups: shared columns at places that allow a link are
   added up for each pair, pairs below LEAST are discarded, and the rest are verified on whole sets.

Together, 3 to 5 miss no link between two components, whatever the order of shingles. The order comes from one table
of 2 ** bits counters, so that shingles count as frequent from twice the table's mean load on; it saves work and
salts hot columns, but decides nothing.

Defined cases: null, empty and wordless texts have an empty set and link with nothing, their component is their own
id; texts of under five words have one shingle, the whole sequence; repeated rows are in one component; component ids
pass over null doc_ids; an empty table gives an empty result; columns other than doc_id and text are never read.
Words and shingles are told by 64-bit hashes: unequal ones that meet count as equal.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import keyed, packed, rolled, small_batches, steps, word_hashes, written
from treeline.llm.counters import BITS, Counters, bucket_of, summed
from treeline.llm.graph import components

SHINGLE = 5
#: Common columns at allowed places that a pair must have, where its sizes demand as many common shingles.
LEAST = 3
#: A column of more rows than this is salted into groups of about so many.
TOGETHER = 2000
#: Rows of a block, and columns of one step of the product.
BLOCK, STEP = 400, 16_384

#: Bytes of UTF-8 with A-Z lower-cased.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingler:
    def __init__(self, n: int = SHINGLE):
        self.n = n

    def of_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text, in UTF-8, as sorted hashes."""
        h, offsets = word_hashes([t.translate(LOWER) for t in texts])
        every, sets = rolled(h, self.n), []
        for a, b in itertools.pairwise(offsets.tolist()):
            if 0 < b - a < self.n:
                sets.append(rolled(h[a:b], b - a, 0x27D4EB2F165667C5 + 2 * (b - a)))
                continue
            found = np.sort(every[a : max(a, b - self.n + 1)])
            new = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        return sets


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def unpacked(column: pa.Array, press: zstandard.ZstdDecompressor) -> list[bytes]:
    return [press.decompress(d) for d in column.to_pylist()]


def set_name(shingles: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two signed longs that name a set; none for the empty one."""
    if not len(shingles):
        return None, None
    name = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63)


def prefix_length(n: int) -> int:
    """Enough for every partner's size: n - ceil(0.75 n) + LEAST, where a set has as many."""
    return min(n, n - -(-3 * n // 4) + LEAST)


def document_sets(rows: DataFrame, bits: int) -> DataFrame:
    """key, doc_id, text -> key, doc_id, hi, lo, n of each document; besides, of each task, part, n and counts: how often buckets of shingles were met."""
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        shingler, met = Shingler(), Counters(bits)
        for batch in batches:
            for lo, size in steps(batch.column("text")):
                part = batch.slice(lo, size)
                sets = shingler.of_all(utf8(part.column("text").to_pylist()))
                met.add(np.concatenate(sets))
                names = [set_name(s) for s in sets]
                columns = [part.column("key"), part.column("doc_id"), [x[0] for x in names], [x[1] for x in names], [len(s) for s in sets], [None] * size, [None] * size]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        for part, n, counts in met.parts():
            columns = [[None]] * 4 + [[n], [part], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return rows.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, hi long, lo long, n long, part int, counts binary")


def border_of(mean: float) -> float:
    """What a bucket counts from which on its shingles are frequent: twice the mean load."""
    return 2 * mean + 2


def ranks_of(sums: np.ndarray, mean: float) -> np.ndarray:
    """The rank of each bucket, eight to a doubling, 0 up to the border."""
    ranks = np.zeros(len(sums), dtype=np.uint8)
    often = sums > border_of(mean)
    ranks[often] = np.clip(1 + 8 * np.log2(sums[often] / border_of(mean)), 1, 255)
    return ranks


def incidence(texts: DataFrame, ranks: np.ndarray, border: float, together: int) -> DataFrame:
    """node, packed -> shingle, salt, node, n, place: each node's prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)
    bits = len(ranks).bit_length() - 1
    groups = np.ceil(np.minimum(border * 2 ** (np.arange(256) / 8) / together, 1e6)).astype(np.int64)
    groups[0] = 1
    out = pa.schema([("shingle", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batches):
        shingler, press, rank_of = Shingler(), zstandard.ZstdDecompressor(), shared.value
        for batch in batches:
            for lo, size in steps(batch.column("packed"), 400_000):
                part = batch.slice(lo, size)
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for node, s in zip(part.column("node").to_pylist(), shingler.of_all(unpacked(part.column("packed"), press)), strict=True):
                    own = rank_of[bucket_of(s, bits)]
                    first = np.argsort(own, kind="stable")[: prefix_length(len(s))]
                    prefix, many = s[first].view(np.int64), groups[own[first]]
                    salts = np.where(many > 1, 1 + ((node * 0x9E3779B97F4A7C15 >> 20) & 0x7FFFFFFFFFFF) % many, 0)
                    for c, x in zip(columns, (prefix, salts, np.full(len(prefix), node), np.full(len(prefix), len(s)), np.arange(len(prefix))), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(f.type.to_pandas_dtype(), copy=False)) for x, f in zip(columns, out, strict=True)], schema=out)

    return texts.select("node", "packed").mapInArrow(run, "shingle long, salt int, node long, n int, place int")


def needed(x: Column, y: Column) -> Column:
    """Common shingles without which sets of x and y cannot link, in whole numbers: ceil(3 (x + y) / 7)."""
    return F.ceil(3 * (x + y) / 7)


def may_link(nx: Column, x: Column, ny: Column, y: Column) -> Column:
    """Whether a column at place x of a set of nx and at place y of one of ny can be among the first LEAST of a link's common ones."""
    least = needed(nx, ny) - F.least(F.lit(LEAST), needed(nx, ny)) + 1
    return (4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) & (nx - x >= least) & (ny - y >= least)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes that link; texts(node, packed) has every node once."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.bool_())])

    def run(batches):
        shingler, press = Shingler(), zstandard.ZstdDecompressor()
        for batch in batches:
            for lo, size in steps(batch.column("packed_a"), 200_000):
                part = batch.slice(lo, size)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                # Each node's set is worked out once a step, however many pairs hold it.
                packed_of = dict(zip(a + b, part.column("packed_a").to_pylist() + part.column("packed_b").to_pylist(), strict=True))
                sets = dict(zip(packed_of, shingler.of_all([press.decompress(d) for d in packed_of.values()]), strict=True))
                links = []
                for x, y in zip(a, b, strict=True):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    links.append(100 * shared >= 75 * (len(sets[x]) + len(sets[y]) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(links, pa.bool_())], schema=out)

    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b")
    return both.mapInArrow(run, "a long, b long, links boolean").filter("links").select("a", "b")


def star_pairs(shared: DataFrame) -> DataFrame:
    """For each node of shared columns, the column minimum b that it meets most often; whether it does so in two fifths of its prefix; whether a link's places allow it."""
    own = F.struct("node", "n", "place")
    local = shared.withColumn("least", F.min(own).over(Window.partitionBy("shingle", "salt")))
    salted = local.filter("salt > 0 and node = least.node").withColumn("least", F.min(own).over(Window.partitionBy("shingle")))
    met = local.unionByName(salted).filter("node != least.node")
    fits = may_link(F.col("n"), F.col("place"), F.col("least.n"), F.col("least.place"))
    counted = met.groupBy(F.col("node").alias("a"), F.col("least.node").alias("b")).agg(F.count("*").alias("times"), F.bool_or(fits).alias("fits"), F.min("n").alias("n"))
    best = counted.groupBy("a").agg(F.max_by(F.struct("b", "times", "n", "fits"), F.struct("times", "b")).alias("m")).select("a", "m.*")
    prefix = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * 3 / 4) + LEAST)
    return best.select("a", "b", (5 * F.col("times") >= 2 * prefix).alias("strong"), "fits")


def grouped(stars: DataFrame, links: DataFrame, first: DataFrame) -> DataFrame:
    """node, group, component of all nodes in strong stars or links. first: node, component."""
    found = components(stars.filter("strong").select("a", "b").unionByName(links)).withColumnRenamed("component", "group")
    return written(found.join(first, "node", "left").select("node", "group", F.coalesce("component", "node").alias("component")), "groups")


def split_groups(groups: DataFrame) -> DataFrame:
    """node, group, outside, nodes, few: nodes of groups in several components; outside: not in the largest of them; few: how many are."""
    counted = groups.groupBy("group", "component").agg(F.count("*").alias("n"))
    sums = counted.groupBy("group").agg(F.count("*").alias("parts"), F.sum("n").alias("nodes"), F.max(F.struct("n", "component")).alias("main"))
    sums = sums.filter((F.col("parts") > 1) & (F.col("nodes") > 2)).select("group", "nodes", (F.col("nodes") - F.col("main.n")).alias("few"), F.col("main.component").alias("main"))
    return written(groups.join(written(sums, "group-sizes"), "group").select("node", "group", (F.col("component") != F.col("main")).alias("outside"), "nodes", "few"), "split-groups")


def product_links(few: np.ndarray, few_sets: list[np.ndarray], nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of nodes, by adding up products of their incidence, STEP columns at a time."""
    rows = [*few_sets, *sets]
    sizes = np.array([len(s) for s in rows], dtype=np.int64)
    shingles, counts = np.unique(np.concatenate(rows), return_counts=True)
    kept, m = shingles[counts > 1], len(few_sets)
    overlap = np.zeros((m, len(sets)), dtype=np.int64)
    places = [np.searchsorted(kept, s[np.isin(s, kept, assume_unique=True)]) for s in rows]
    for lo in range(0, len(kept), STEP):
        part = np.zeros((len(rows), min(STEP, len(kept) - lo)), dtype=np.float32)
        for row, at in enumerate(places):
            part[row, at[(at >= lo) & (at < lo + STEP)] - lo] = 1.0
        overlap += (part[:m] @ part[m:].T).astype(np.int64)
    linked = 100 * overlap >= 75 * (sizes[:m, None] + sizes[None, m:] - overlap)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    forest = []
    for i, j in np.argwhere(linked).tolist():
        x, y = int(few[i]), int(nodes[j])
        if (a := find(x)) != (b := find(y)):
            root[a] = b
            forest.append((x, y))
    return forest


def group_links(split: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """split_groups' rows -> links a, b that join up all linked nodes of each group."""
    sized = split.withColumns({"blocks": F.ceil(F.col("nodes") / block), "rows": F.ceil(F.col("few") / block)})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    wide = sized.select("node", "group", F.lit(False).alias("row"), upto("rows").alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("j"))
    high = sized.filter("outside").select("node", "group", F.lit(True).alias("row"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows")).alias("i"), upto("blocks").alias("j"))
    tasks = wide.unionByName(high).join(texts, "node")

    def multiply(table: pa.Table) -> pa.Table:
        shingler, press = Shingler(), zstandard.ZstdDecompressor()
        row = table.column("row").to_numpy()
        node, sets = table.column("node").to_numpy(), []
        for chunk in table.column("packed").chunks:
            for lo, size in steps(chunk, 400_000):
                sets += shingler.of_all(unpacked(chunk.slice(lo, size), press))
        side = lambda at: (node[at], [sets[k] for k in np.flatnonzero(at)])
        found = product_links(*side(row), *side(~row)) if row.any() and not row.all() else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return tasks.groupBy("group", "i", "j").applyInArrow(multiply, "a long, b long")


def contested(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of columns with several groups, with the node's group and component and the column's main group."""
    rows = shared.join(groups, "node", "left").select("shingle", "node", "n", "place", F.coalesce("group", "node").alias("group"), F.coalesce("component", "node").alias("component"))
    rows = written(rows, "incidence-groups")
    counted = rows.groupBy("shingle", "group").agg(F.count("*").alias("rows"))
    columns = counted.groupBy("shingle").agg(F.count("*").alias("parts"), F.max_by("group", F.struct("rows", "group")).alias("main"))
    # Written, so that the join meets two plain tables and can split a hot column.
    columns = written(columns.filter("parts > 1").select("shingle", "main"), "columns")
    return written(rows.join(columns, "shingle"), "contested")


def crossing_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of nodes of different groups and components whose shared columns allow a link."""
    few = rows.filter("group != main").select(F.col("shingle").alias("column"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("component").alias("cx"), F.col("group").alias("gx"))
    many = rows.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("component").alias("cy"), F.col("group").alias("gy"), (F.col("group") == F.col("main")).alias("in_main"))
    near = (F.col("gx") != F.col("gy")) & (F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"))
    pairs = few.join(many, (F.col("column") == F.col("shingle")) & near)
    counted = pairs.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.count("*").alias("times"), F.min(needed(F.col("nx"), F.col("ny"))).alias("needed"))
    return counted.filter(F.col("times") >= F.least(F.lit(LEAST), F.col("needed"))).select("a", "b")


def near_duplicates(docs: DataFrame, bits: int = BITS, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> key, doc_id, n_shingles, component_id; key is unique, rows of a component share component_id.

    bits, together and block steer the work and never the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, _ = keyed(docs)
    sets = written(document_sets(rows, bits), "sets")
    documents = sets.filter("part is null")
    counted = sets.filter("part is not null").select("part", "n", "counts")
    ranks = summed(counted, bits, ranks_of, np.uint8)
    border = border_of((counted.agg(F.sum("n")).first()[0] or 0) / (1 << bits))
    named = written(documents.filter("hi is not null").groupBy("hi", "lo").agg(F.min("key").alias("node")), "nodes")
    texts = written(packed(rows).join(named.select(F.col("node").alias("key")), "key").select(F.col("key").alias("node"), "packed"), "node-texts")
    shared = shared_columns(incidence(texts, ranks, border, together))
    stars = written(star_pairs(shared), "stars")
    links = written(verified(stars.filter("fits").select("a", "b"), texts), "star-links")
    first = written(components(links), "components")
    groups = grouped(stars, links, first)
    late = verified(written(crossing_pairs(contested(shared, groups)), "pairs"), texts)
    split = split_groups(groups)
    if not split.isEmpty():
        late = late.unionByName(group_links(split, texts, block))
    joined = merged(spark, first, late)
    nodes = documents.select("key", "doc_id", "hi", "lo", "n").join(named, ["hi", "lo"], "left")
    placed = written(nodes.join(joined, "node", "left").select("key", "doc_id", "n", F.coalesce("component", "node").alias("component")), "placed")
    # Written, so that the join below meets two plain tables and can split a large component.
    least = written(placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "component", "left").select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def shared_columns(rows: DataFrame) -> DataFrame:
    """incidence's rows without the columns of one node; of salted columns all rows stay."""
    column = Window.partitionBy("shingle", "salt")
    met = rows.withColumn("lo", F.min("node").over(column)).withColumn("hi", F.max("node").over(column))
    return written(met.filter("lo != hi or salt > 0").drop("lo", "hi"), "incidence")


def merged(spark: SparkSession, first: DataFrame, late: DataFrame) -> DataFrame:
    """node, component after the late links a, b between components."""
    up = first.select(F.col("node").alias("j"), "component")
    ends = late.join(up.withColumnsRenamed({"j": "a", "component": "ca"}), "a", "left").join(up.withColumnsRenamed({"j": "b", "component": "cb"}), "b", "left")
    late = written(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b"), "late-links")
    if late.isEmpty():
        return first
    return written(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)), "components")
