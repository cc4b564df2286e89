"""Shared by the operators: cut points for loops, work dealt over tasks, and lists that are parameters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list (rules, globs, names asked for) that is matched by a pattern and not by equality.
LISTED = 10_000

#: What one step of Python work in a task takes at most, in rows and in bytes of its widest column.
STEP_ROWS, STEP_BYTES = 256, 1 << 20

#: What one Arrow batch of wide rows holds at most, in bytes.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, spark.checkpoint.dir. Only in local mode, where all is one process, it may be unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read from there: plans stay short, lost executors cost nothing that is done, and readers keep sizes, columns and compression."""
    at = f"{shared_dir(df.sparkSession)}/treeline-cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys over as many partitions as a shuffle has.

    A small input file is one split and may stand for hours of work a row in Python. The number is given, so that adaptive
    execution, which sees bytes and not work, does not join the partitions up again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches bounded by bytes, a row at least, so that a task's Python holds few wide rows at once; a setting that asks for less already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= most:
        spark.conf.set(key, str(most))


def stepped(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most `rows` rows and about `most` bytes of text, a row at least: what Python makes of one is let go before the next."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type)]
        sizes = [0] * batch.num_rows
        for column in wide:
            sizes = [a + b for a, b in zip(sizes, pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist(), strict=True)]
        lo = total = 0
        for i, n in enumerate(sizes):
            if i > lo and (total + n > most or i - lo >= rows):
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        if lo < batch.num_rows:
            yield batch.slice(lo)


def by_repo(*tables: DataFrame) -> list[str]:
    """The key by which tables of several repositories are kept apart: none where a table has no such column and so holds for all."""
    return ["repo"] if all("repo" in t.columns for t in tables) else []


def by_policy(rows: DataFrame, policies: DataFrame | None, what: str, default: tuple[str, ...]) -> DataFrame:
    """rows with the patterns of their repository in the column `what`: those of policies(repo, what), the default where it has none."""
    own = F.array(*[F.lit(d) for d in default])
    if policies is None:
        return rows.withColumn(what, own)
    # one row a repository: of several policies of one repository the least is taken
    each = policies.groupBy("repo").agg(F.min(F.when(F.size(what) > 0, F.col(what))).alias(what))
    return rows.join(each, "repo", "left").withColumn(what, F.coalesce(what, own))


def listed(df: DataFrame, most: int = LISTED) -> DataFrame:
    """A list that goes to every task. It is a parameter, not data: over `most` rows it is refused."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a list of over {most} rows cannot be matched by patterns; join it by equality")
    return F.broadcast(df)
