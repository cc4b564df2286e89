"""Sinks: query contexts and audit reports as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Relations of a query that its context shows.
RELATIONS = 20


def capped_text(rows: DataFrame, by: list[str], order: list[str], text: str, cap: int, name: str) -> DataFrame:
    """For each group, its first `cap` texts as lines."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text]), "\n").alias(name))


def context(entities: DataFrame, relations: DataFrame, chunks: DataFrame, entity_cap: int = 10, relation_cap: int = RELATIONS, chunk_cap: int = 5, chars: int = 500) -> DataFrame:
    """qid, context from entities(qid, id, kind, score), relations(qid, src_id, tgt_id, kind), chunks(qid, id, content, score)."""
    e = capped_text(entities.withColumn("t", F.concat_ws(" ", "kind", "id")), ["qid"], [F.col("score").desc(), "id"], "t", entity_cap, "e")
    r = capped_text(relations.withColumn("t", F.concat(F.col("src_id"), F.lit(" -"), F.col("kind"), F.lit("-> "), F.col("tgt_id"))), ["qid"], ["src_id", "tgt_id", "kind"], "t", relation_cap, "r")
    c = capped_text(chunks.withColumn("t", F.substring("content", 1, chars)), ["qid"], [F.col("score").desc(), "id"], "t", chunk_cap, "c")
    rows = e.join(r, "qid", "full").join(c, "qid", "full")
    return rows.select("qid", F.concat_ws("\n\n", F.concat(F.lit("Entities:\n"), F.col("e")), F.concat(F.lit("Relations:\n"), F.col("r")), F.concat(F.lit("Chunks:\n"), F.col("c"))).alias("context"))


def findings_report(findings: DataFrame, limit: int = 20) -> DataFrame:
    """One row a table: number of findings and the first `limit` of them as text."""
    line = F.concat(F.lit("["), F.col("verdict"), F.lit("] "), F.col("id"), F.lit(" "), F.coalesce("summary", F.lit("")))
    text = capped_text(findings.withColumn("t", line), ["table"], ["verdict", "id"], "t", limit, "report")
    return findings.groupBy("table").agg(F.count("*").alias("total")).join(text, "table")


def delta_report(delta: DataFrame) -> DataFrame:
    """change, total and the ids, from a delta with id."""
    return delta.groupBy("change").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list("id")), "\n").alias("report"))
