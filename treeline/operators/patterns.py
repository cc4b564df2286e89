"""Many patterns in one pass: Aho-Corasick automata over bounded parts of a table of patterns.

Patterns are dealt by hash into parts of about PART characters. A part is broadcast, at most a few times PART characters;
each Python worker builds its automaton once and runs every text through it, so a pass over the texts finds all
patterns of a part, however many they are. A table of patterns of any size is so many parts, each a pass. Patterns longer than
HEAD stand in the automaton by their first HEAD characters and are compared whole where these are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.common import cut

#: Characters of patterns in one part, about, and of one pattern in the automaton.
PART, HEAD = 1_000_000, 1_000


@lru_cache(maxsize=1)
def automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    """By the first HEAD characters of each pattern: these, whether they are a pattern, and the longer ones that begin so."""
    entries: dict[str, tuple[str, list[str], list[str]]] = {}
    for p in patterns:
        head, own, longer = entries.setdefault(p[:HEAD], (p[:HEAD], [], []))
        (longer if len(p) > HEAD else own).append(p)
    machine = ahocorasick.Automaton()
    for head, entry in entries.items():
        machine.add_word(head, entry)
    machine.make_automaton()
    return machine


def found_in(machine: ahocorasick.Automaton, text: str) -> set[str]:
    """The patterns that stand somewhere in a text."""
    found: set[str] = set()
    if len(machine) and text:
        for end, (head, own, longer) in machine.iter(text):
            found.update(own)
            found.update(p for p in longer if p not in found and text.startswith(p, end + 1 - len(head)))
    return found


def contained(texts: DataFrame, text: str, patterns: DataFrame, part: int = PART) -> DataFrame:
    """texts(..., text), patterns(pattern) -> the columns of texts but `text`, and pattern: a row for each pattern that a text contains, once. Null and empty texts and patterns meet nothing."""
    wanted = cut(patterns.select(F.col("pattern").cast("string").alias("pattern")).filter("pattern != ''").distinct().withColumn("hash", F.xxhash64("pattern")))
    total = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part))
    keys = [c for c in texts.columns if c != text]
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys), "pattern string"])
    spark, found = texts.sparkSession, None
    for n in range(parts):
        own: Broadcast = spark.sparkContext.broadcast(tuple(sorted(r["pattern"] for r in wanted.filter(F.pmod("hash", F.lit(parts)) == n).select("pattern").toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch], own: Broadcast = own) -> Iterator[pa.RecordBatch]:
            machine = automaton(own.value)
            for batch in batches:
                at, met = [], []
                for i, content in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    hits = sorted(found_in(machine, content))
                    at += [i] * len(hits)
                    met += hits
                rows = batch.select(batch.schema.names[:-1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(met, pa.string())], names=[*rows.schema.names, "pattern"])

        hits = texts.select(*keys, F.col(text).alias("_text")).filter("_text != ''").mapInArrow(run, schema)
        hits = cut(hits) if parts > 1 else hits  # else a plan would hold as many passes as there are parts
        found = hits if found is None else found.unionByName(hits)
    return found
