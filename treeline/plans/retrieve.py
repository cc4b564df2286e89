"""Retrieval: embed, find, dedupe, hydrate, look around, and write the context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import graph, inverted, vectors
from treeline.operators.common import cut
from treeline.sources.reports import RELATIONS, context

#: Characters of a piece, which is embedded whole.
CHARS = 1000
#: A piece ends after white space where it can.
PIECE = rf"(?s).{{1,{CHARS - 1}}}(?:\s|\z)|.{{1,{CHARS}}}"


def pieces(chunks: DataFrame) -> DataFrame:
    """chunks(repo, id, content) of any length -> repo, id#n, content: each character is in one piece of at most CHARS; blank ones are left out."""
    cuts = chunks.select("repo", "id", F.posexplode(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))).alias("at", "content"))
    return cuts.filter(F.regexp_replace("content", r"\s+", "") != "").select("repo", F.concat("id", F.lit("#"), (F.col("at") + 1).cast("string")).alias("id"), "content")


def retrieve(queries: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, k: int = 10, depth: int = 1, embed_texts: Callable | None = None, exact: bool = True) -> DataFrame:
    """queries(qid, text), entities(repo, id, kind, description), chunks(repo, id, content) -> qid, hits, context: as retrieve_with_graph, after embedding.

    Chunks are cut into pieces first, so that all of a text can be found.
    """
    key = lambda owner: F.xxhash64(F.lit(owner), "repo", "id").alias("key")
    parts, ents = pieces(chunks).select("*", key("chunk")), entities.select("*", key("entity"))

    def vecs(rows: DataFrame, text: str, owner: str) -> DataFrame:
        named = rows.select(F.lit("").alias("repo"), F.col("key").cast("string").alias("id"), F.lit(owner).alias("owner"), F.col(text).alias("text"))
        return vectors.embed(named, embed_texts, chars=None).select(F.col("id").cast("long").alias("id"), "owner", "vec")

    asked = vecs(queries.withColumn("key", F.col("qid")), "text", "query").select(F.col("id").alias("qid"), "vec")
    return retrieve_with_graph(vecs(parts, "content", "chunk").unionByName(vecs(ents, "description", "entity")), asked, ents, relations, parts, k, depth, exact)


def retrieve_with_graph(vectors_: DataFrame, query_vectors: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, k: int = 10, depth: int = 1, exact: bool = True) -> DataFrame:
    """qid, hits, context of each query that finds anything: entities and chunks nearest to it, the relations around the entities, and all that written.

    vectors_(id long, owner, vec), entities(repo, id, kind, key), chunks(repo, id, content, key): key names a row in vectors_.
    All vectors have one dimension. An exact search meets every vector once, block by block (vectors.topk); without `exact` vectors are
    listed by cells (operators.inverted) and only the nearest lists are searched.
    """
    vectors_, asked = cut(vectors_), cut(query_vectors)

    def hit(owner: str) -> DataFrame:
        own = vectors_.filter(F.col("owner") == owner).select("id", "vec")
        # Entities are described in a few words, so that many share a vector.
        nearest = vectors.topk_of_few if owner == "entity" else vectors.topk
        found = nearest(own, asked, k) if exact else inverted.search(inverted.built(own), asked, k)
        return cut(vectors.dedupe_hits(found))

    e = cut(hit("entity").join(entities.withColumnRenamed("id", "entity").withColumnRenamed("key", "id"), "id").select("qid", "repo", F.col("entity").alias("id"), "kind", "score"))
    near = hit("chunk")
    c = near.join(chunks.withColumnRenamed("id", "chunk").withColumnRenamed("key", "id"), "id").select("qid", F.col("chunk").alias("id"), "content", "score")
    seeds = graph.prefix_expand(e.select("repo", "id").distinct(), entities, relations)
    reached = graph.khop(relations, seeds, depth, "both", entities)
    around = graph.induced_edges(reached, relations).select("repo", "seed", "src_id", "tgt_id", "kind").distinct()
    # The context has a query's first RELATIONS; those are among the first of its seeds, so no hub is multiplied by its queries.
    order = Window.partitionBy("repo", "seed").orderBy("src_id", "tgt_id", "kind")
    around = around.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= RELATIONS).drop("n")
    r = e.select("qid", "repo", F.col("id").alias("seed")).join(around, ["repo", "seed"]).select("qid", "src_id", "tgt_id", "kind").distinct()
    hits = e.select("qid").unionByName(near.select("qid")).groupBy("qid").agg(F.count("*").alias("hits"))
    return hits.join(context(e, r, c, entity_cap=k), "qid")


def retrieve_rounds(follow_ups: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, k: int = 5, embed_texts: Callable | None = None, questions: DataFrame | None = None) -> DataFrame:
    """follow_ups(question, round, text) -> question, sub_questions, covered, coverage, context: rounds that found anything, their share, and their contexts in order.

    questions(question), as often as one likes: those that have no follow-up get a row too, with the coverage 1.
    """
    asked = follow_ups.withColumn("qid", F.xxhash64("question", "round", "text"))
    found = retrieve(asked.select("qid", "text").dropDuplicates(["qid"]), entities, relations, chunks, k, embed_texts=embed_texts)
    rows = asked.join(found.select("qid", "hits", "context"), "qid", "left").withColumn("n", F.lit(1))
    if questions is not None:
        rows = rows.unionByName(questions.select("question", F.lit(0).alias("n")), allowMissingColumns=True)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("round", "text", "context")))), lambda x: F.concat(F.lit("## Follow-up: "), F.coalesce(x["text"], F.lit("")), F.lit("\n"), x["context"])), "\n\n")
    per = rows.groupBy("question").agg(F.sum("n").alias("sub_questions"), F.count("hits").alias("covered"), told.alias("context"))
    return per.select("question", "sub_questions", "covered", F.when(F.col("sub_questions") == 0, 1.0).otherwise(F.col("covered") / F.col("sub_questions")).alias("coverage"), "context")
