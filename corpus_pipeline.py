"""From documents to stored token ids: language, near duplicates, benchmark leaks, mixing, output.

Each stage takes (spark, docs, sf_dir) and decides on all that the one before it kept. All but the last return the
columns of documents. `run` writes each stage's result and reads it again for the next.

Defined cases: documents whose text is null, empty or without a letter have no language and go in the first stage;
nulls in other columns are kept as they are (a null source is a source of its own). Rows are told apart even where
doc_ids repeat or are null: of equal texts the first row stays, and of rows that tie in the mix any may be taken. Other
columns than the five are dropped. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontaminate, jaccard, langid, mixing, tokens
from treeline.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document stays if its language is known and at least this likely.
LEAST_SCORE = 0.35

#: No SQL can state the learned language model or the tokenizer; tests compare with plain Python instead.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `row`, a unique long: doc_id where ids are neither null nor repeated, else a number, written once."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not at least LEAST_SCORE likely."""
    known = langid.identify(docs, langid.train(docs), carry=COLUMNS[1:])
    return known.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by doc_id, of each group of near duplicates."""
    rows = numbered(docs.select(*COLUMNS))
    groups = jaccard.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark; a document that mostly consists of them goes."""
    cleaned = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("lang", "source", "n_chars"))
    n_chars = F.length("text").cast("long")
    return cleaned.filter(~F.col("dropped")).withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = numbered(docs.select(*COLUMNS))
    mixed = mixing.mix(rows.select(F.col("row").alias("doc_id"), "text", "source")).filter("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return rows.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the mix as token ids; returns what the files hold of each document."""
    import public_tokenizers

    return tokens.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontamination),
    ("mix_sources", mixing_sources),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
