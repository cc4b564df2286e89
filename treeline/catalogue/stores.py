"""Queries on what is kept: versions of a store, metrics by deltas, inverted lists of vectors and what retrieval finds with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.catalogue.graph import TOPK
from treeline.operators import inverted, vectors
from treeline.operators.common import cut, shared_dir
from treeline.plans import retrieve
from treeline.plans.bindings import REPO, Tables, with_tables
from treeline.sources.snapshots import Store
from treeline.streaming import deltas

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def new_store(t: Tables) -> Store:
    return Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")


@query(with_tables("now_h old_h ent", "old AS (SELECT * FROM old_h), now AS (SELECT * FROM now_h), d AS (SELECT rel_path FROM old WHERE rel_path LIKE 'src1%')") + """
SELECT 0 AS version, 'docs' AS repo, rel_path, sha256 FROM old UNION ALL SELECT 1, 'docs', rel_path, sha256 FROM now
UNION ALL SELECT 1, split_part(id,'.',1), file_path, id FROM ent UNION ALL SELECT 2, 'docs', rel_path, sha256 FROM now UNION ALL SELECT 2, split_part(id,'.',1), file_path, id FROM ent WHERE split_part(id,'.',1)<>'FRANCE'""")
def store_versions(t: Tables) -> DataFrame:
    """Three commits, each read as its version was: earlier hashes; today's, with a repository for each nation; and France emptied."""
    store = new_store(t)
    nations = t.entities().select(F.substring_index("id", ".", 1).alias("repo"), F.col("file_path").alias("rel_path"), F.col("id").alias("sha256"))
    store.commit({"hashes": t.earlier_hashes()})
    store.commit({"hashes": t.hashes().unionByName(nations)})
    store.commit({"hashes": nations.limit(0)}, touched=["FRANCE"])
    rows = [store.read("hashes", v).select(F.lit(v).alias("version"), "repo", "rel_path", "sha256") for v in store.versions()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


LEFT = "left_edges AS (SELECT DISTINCT src_id, tgt_id, kind FROM rel WHERE seq%3<>0 OR seq%6=0 OR kind<>'calls'), c AS (SELECT * FROM left_edges WHERE kind='calls'), deg AS (SELECT tgt_id, count(*) AS n FROM c GROUP BY 1), ents AS (SELECT * FROM ent WHERE key%5<>0 OR key IS NULL), ends AS (SELECT src_id AS id FROM left_edges UNION SELECT tgt_id FROM left_edges)"
KEPT_SQL = """SELECT split_part('tpc','.',1) AS repo, (SELECT count(*) FROM ents) AS entity_count, (SELECT count(*) FROM ends WHERE id NOT IN (SELECT id FROM ents)) AS phantom_count,
 (SELECT count(*) FROM (SELECT DISTINCT src_id, tgt_id FROM left_edges)) AS relation_count, (SELECT count(*) FROM c) AS calls, (SELECT count(*) FROM c WHERE split_part(src_id,'.',1)<>split_part(tgt_id,'.',1)) AS crossing,
 (SELECT count(*) FROM deg) AS called, (SELECT count(*) FROM deg WHERE n>5) AS crowded, (SELECT count(*) FROM ents WHERE name LIKE '\\_s%' ESCAPE '\\') AS needing,
 (SELECT count(*) FROM ents WHERE name LIKE '\\_s%' ESCAPE '\\' AND id NOT IN (SELECT tgt_id FROM left_edges)) AS dead, (SELECT count(*) FROM ents WHERE kind='function') AS functions, (SELECT count(*) FROM ents WHERE kind='function' AND line_end-line_start>50) AS oversized"""
KEYED = "ent AS (SELECT n AS id, 'module' AS kind, n AS name, 1 AS line_start, 1 AS line_end, NULL AS key FROM nat UNION ALL SELECT id,'function',name,1,line_end,key FROM cust UNION ALL SELECT id,'function',name,1,line_end,key FROM supp)"


@query(with_tables("rel nat cust supp", f"{KEYED}, {LEFT}, k AS ({KEPT_SQL})") + "SELECT *, crossing/greatest(calls,1)::DOUBLE AS mc, crowded/greatest(called,1)::DOUBLE AS fi, dead/greatest(needing,1)::DOUBLE AS dc, oversized/greatest(functions,1)::DOUBLE AS fs FROM k")
def metrics_by_deltas(t: Tables) -> DataFrame:
    """All relations and entities come; every third call and every fifth entity go; half of these calls come back, in a batch that is sent twice."""
    store, edges = new_store(t), cut(t.relations().select("repo", "src_id", "tgt_id", "kind", "seq"))
    marks = deltas.entity_marks(t.entities(), F.col("name").startswith("_s"))
    number = F.regexp_extract("id", r"\.[_a-z]+([0-9]+)$", 1)
    some = marks.filter(F.when(number != "", number.cast("long") % 5 == 0).otherwise(False)).withColumn("n", F.lit(-1))
    third = edges.filter("kind = 'calls' and seq % 3 = 0")
    deltas.fold(store, 0, edges.withColumn("n", F.lit(1)), marks.withColumn("n", F.lit(1)))
    deltas.fold(store, 1, third.withColumn("n", F.lit(-1)), some)
    for _ in range(2):
        deltas.fold(store, 2, third.filter("seq % 6 = 0").withColumn("n", F.lit(1)))
    return deltas.kept_metrics(store)


def embedded(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(t: Tables) -> DataFrame:
    return embedded(t).filter("id % 50 = 0").withColumnRenamed("id", "qid")


@query(f"WITH {TOPK} SELECT qid, id, round(score,6) AS score, rank FROM hits")
def vector_topk_indexed(t: Tables) -> DataFrame:
    """The exact search of inverted lists."""
    return inverted.search(inverted.built(embedded(t)), asked(t), 10, exact=True).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS listed, count(DISTINCT vec_id) AS vectors, count(*) FILTER (WHERE vec_id%50=0) AS queries, true AS recalled FROM embeddings")
def vector_index_recall(t: Tables) -> DataFrame:
    """What the lists hold, and whether the nearest lists give nine of ten of the true neighbours of vectors whose id is divisible by 50."""
    index, wanted = inverted.built(embedded(t)), vectors.topk(embedded(t), asked(t), 10).select("qid", "id")
    found = inverted.search(index, asked(t), 10).select("qid", "id").withColumn("found", F.lit(1))
    recall = wanted.join(found, ["qid", "id"], "left").agg((F.coalesce(F.sum("found"), F.lit(0)) >= 0.9 * F.count("*")).alias("recalled"), F.countDistinct("qid").alias("queries"))
    return index.lists.select(F.explode("keys").alias("id")).agg(F.count("*").alias("listed"), F.countDistinct("id").alias("vectors")).join(recall)


HITS = TOPK.replace("WHERE q.vec_id%50=0)", "WHERE q.vec_id%50=0 AND v.vec_id%2={odd})").replace("hits AS", "hits{odd} AS")


@query(f"WITH {HITS.format(odd=0)}, {HITS.format(odd=1)}, e AS (SELECT * FROM hits0 WHERE 'e'||id IN (SELECT 'e'||vec_id FROM embeddings)) SELECT qid, count(*) AS hits, string_agg(name, ', ' ORDER BY score DESC, name) AS first_entities FROM (SELECT qid, score, 'e'||id AS name FROM e UNION ALL SELECT qid, score, NULL FROM hits1) GROUP BY qid")
def retrieve_hits(t: Tables) -> DataFrame:
    """Vectors of even ids are entities, those of odd ones chunks: what each query finds, and its entities as the context lists them."""
    name = F.concat(F.when(F.col("id") % 2 == 0, "e").otherwise("c"), F.col("id").cast("string"))
    rows = embedded(t).select(F.lit(REPO).alias("repo"), name.alias("name"), F.col("id").alias("key"), "vec", F.when(F.col("id") % 2 == 0, "entity").otherwise("chunk").alias("owner"))
    entities = rows.filter("owner = 'entity'").select("repo", F.col("name").alias("id"), F.lit("function").alias("kind"), "key")
    chunks = rows.filter("owner = 'chunk'").select("repo", F.col("name").alias("id"), F.concat(F.lit("text of "), "name").alias("content"), "key")
    none = t.relations().limit(0)
    found = retrieve.retrieve_with_graph(rows.select(F.col("key").alias("id"), "owner", "vec"), asked(t), entities, none, chunks, 10)
    names = F.array_join(F.regexp_extract_all("context", F.lit(r"\b(e[0-9]+)\b"), F.lit(1)), ", ")
    return found.select("qid", "hits", names.alias("first_entities"))
